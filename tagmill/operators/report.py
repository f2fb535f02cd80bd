"""Figures about results, and the files that show them."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.config import Settings
from tagmill.operators.labels import valid_names

# Names and lower bounds of the confidence ranges.
RANGES = ((">=95", 95), ("90-94", 90), ("80-89", 80), ("50-79", 50), ("<50", None))


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * n / total, 1)).otherwise(0.0)


def totals(results: DataFrame, categories: list[str]) -> DataFrame:
    valid = F.size(valid_names(F.col("label"), categories)) > 0
    status = F.coalesce("parse_status", F.lit(""))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid).alias("success"),
        F.count_if(~valid).alias("failed"),
        F.count_if(F.col("is_low_confidence") == "yes").alias("low_conf"),
        F.count_if(F.contains(status, F.lit("fuzzy_corrected"))).alias("fuzzy_corrected"),
        F.count_if(F.contains(status, F.lit("post_validate"))).alias("post_validated"),
    )


def confidence_histogram(results: DataFrame) -> DataFrame:
    """range, n, pct: a row for every range, also empty ones."""
    conf = F.coalesce(F.col("confidence").cast("int"), F.lit(0))
    counts, above = [], F.lit(False)
    for name, low in RANGES:
        here = ~above & ((conf >= low) if low is not None else F.lit(True))
        counts.append(F.struct(F.lit(name).alias("range"), F.count_if(here).alias("n")))
        above = above | ((conf >= low) if low is not None else F.lit(False))
    one = results.agg(F.array(*counts).alias("all"), F.count(F.lit(1)).alias("total"))
    return one.select(F.explode("all").alias("x"), "total").select("x.range", "x.n", percent(F.col("x.n"), F.col("total")).alias("pct"))


def names_per_item(results: DataFrame, categories: list[str]) -> DataFrame:
    """n_labels, n, pct."""
    sized = results.groupBy(F.size(valid_names(F.col("label"), categories)).alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))
    return sized.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def label_distribution(results: DataFrame, categories: list[str], order: str = "ord") -> DataFrame:
    """label, n, pct of all items, first (where the label was first seen): at most a row per category."""
    named = results.select(order, F.posexplode_outer(valid_names(F.col("label"), categories)).alias("_p", "_label"))
    counts = named.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "_p")).alias("first"))
    # every item is counted once, under its first name or under none
    total = results.agg(F.count(F.lit(1)).alias("total"))
    return counts.filter("_label IS NOT NULL").crossJoin(F.broadcast(total)).select(F.col("_label").alias("label"), "n", percent(F.col("n"), F.col("total")).alias("pct"), "first")


def low_confidence(results: DataFrame) -> DataFrame:
    return results.filter(F.col("is_low_confidence") == "yes")


def run_stats(answers: DataFrame) -> DataFrame:
    """Sums over the answers' own columns: a task that runs twice doesn't count twice."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return answers.agg(
        whole("prompt_tokens").alias("prompt_tokens"),
        whole("completion_tokens").alias("completion_tokens"),
        whole("total_tokens").alias("total_tokens"),
        whole("counted_retries").alias("total_retries"),
        whole("n_429").alias("total_429s"),
        whole("n_timeouts").alias("total_timeouts"),
        whole("n_other_errors").alias("total_other_errors"),
        F.round(F.coalesce(F.sum("backoff_seconds"), F.lit(0.0)), 2).alias("total_backoff_seconds"),
    )


def most_retried(answers: DataFrame, text: str = "key_text", order: str = "ord") -> DataFrame:
    """The item with the most retries, the first of several; empty text where none was retried."""
    n = F.coalesce(F.col("n_retries"), F.lit(0))
    best = F.max_by(F.col(text), F.struct(n, -F.col(order)))
    return answers.agg(F.coalesce(F.max(n), F.lit(0)).alias("max_retries_count"), F.coalesce(F.when(F.max(n) > 0, best), F.lit("")).alias("max_retries_item")).select("max_retries_item", "max_retries_count")


def markdown(results: DataFrame, settings: Settings, now: datetime | None = None, order: str = "ord") -> str:
    """The report. Lists of single items stream from sorted partitions; all else is a few rows."""
    cats = settings.category_list
    t = totals(results, cats).first()
    if not t["total"]:
        return "# Classification Report\n\nNo data.\n"
    share = lambda n: f"{n} ({100 * n / t['total']:.1f}%)"
    text, context = settings.text_column, settings.context_column or "context"
    out = ["# Classification Report", "", f"Generated: {(now or datetime.now()):%Y-%m-%d %H:%M:%S}"]

    def section(title: str, heads: list[str], rows) -> None:
        out.extend(["", f"## {title}", "", "| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)])
        out.extend("| " + " | ".join(map(str, r)) + " |" for r in rows)

    section(
        "Summary",
        ["Metric", "Value"],
        [
            ("Unique items (deduplicated)", t["total"]),
            ("Classified (valid labels)", share(t["success"])),
            (f"Low confidence (max < {settings.threshold})", share(t["low_conf"])),
            ("Failed / unclassified", share(t["failed"])),
            ("Fuzzy corrections", t["fuzzy_corrected"]),
            ("Post-validation fixes", t["post_validated"]),
        ],
    )
    pct = lambda rows: [(r[0], r[1], f"{r[2]:.1f}%") for r in rows]
    section("Confidence Distribution", ["Range", "Count", "%"], pct(confidence_histogram(results).collect()))
    section("Multi-label Statistics", ["Label count", "Items", "%"], pct(names_per_item(results, cats).orderBy("n_labels").collect()))
    section("Label Distribution (by deduplicated item)", ["Label", "Items", "%"], pct(label_distribution(results, cats, order).orderBy(F.desc("n"), "first").select("label", "n", "pct").collect()))
    cut = lambda c, n: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n)
    low = low_confidence(results).orderBy("confidence", order)
    low = low.select(cut("key_text", 60), cut("key_context", 30), F.replace(cut("label", 40), F.lit("|"), F.lit("/")), "confidence", F.replace(cut("parse_status", 40), F.lit("|"), F.lit("/")))
    if t["low_conf"]:
        section("Low Confidence / Anomalous Items", [text, context, "label", "confidence", "parse_status"], low.toLocalIterator())
    if t["fuzzy_corrected"]:
        fuzzy = results.filter(F.contains("parse_status", F.lit("fuzzy_corrected"))).orderBy(order)
        section("Fuzzy Correction Log", [text, "parse_status"], fuzzy.select(cut("key_text", 60), "parse_status").toLocalIterator())
    return "\n".join(out) + "\n"


def summary(results: DataFrame, answers: DataFrame, settings: Settings, seconds: float, now: datetime | None = None, order: str = "ord") -> dict:
    t, s, most = totals(results, settings.category_list).first(), run_stats(answers).first().asDict(), most_retried(answers, order=order).first()
    return {
        "generated_at": (now or datetime.now()).isoformat(),
        "model": settings.model_name,
        "api_base_url": settings.api_base,
        "threshold": settings.threshold,
        "total": t["total"],
        "success": t["success"],
        "failed": t["failed"],
        "duration_seconds": round(seconds, 2),
        "tokens": {k: s[k] for k in ("prompt_tokens", "completion_tokens", "total_tokens")},
        "retries": {k: v for k, v in s.items() if k.startswith("total_") and k != "total_tokens"} | {"max_retries_program": most["max_retries_item"], "max_retries_count": most["max_retries_count"]},
    }


def write_report(results: DataFrame, answers: DataFrame, settings: Settings, folder: str | Path, seconds: float, order: str = "ord") -> None:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "classification_report.md").write_text(markdown(results, settings, order=order), encoding="utf-8")
    made = summary(results, answers, settings, seconds, order=order)
    (folder / "run_summary.json").write_text(json.dumps(made, ensure_ascii=False, indent=2), encoding="utf-8")
