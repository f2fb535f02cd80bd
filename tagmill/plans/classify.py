"""A classification run: scan, dedup, resume, call in committed chunks, parse, validate, write, report."""

from __future__ import annotations

import contextlib
import hashlib
import logging
import time
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.backends import Backend, called, http
from tagmill.config import Settings
from tagmill.functions.text import duration_text
from tagmill.identity import KEYS
from tagmill.operators import dedup, labels, merge, report
from tagmill.operators.failures import is_failed
from tagmill.operators.parse import parse
from tagmill.operators.throttle import CycleBudget, Plan
from tagmill.schemas import COMPARE_COLUMNS, PROCESSING_ERROR, RESULT_COLUMNS
from tagmill.sources.files import output_format, read_table, write_csv, write_table
from tagmill.sources.ledger import Ledger, drift
from tagmill.stopping import StopSignal

log = logging.getLogger("tagmill")


class Exclusive(ValueError):
    pass


def classify(items: DataFrame, backend: Backend, settings: Settings) -> DataFrame:
    """items (keys, ord) with the answer and the result columns: one plan, one call per row."""
    made = parse(backend(items), settings.category_list, settings.threshold)
    return made.withColumn("tokens_used", F.col("total_tokens"))


def commit_in_chunks(items: DataFrame, backend: Backend, settings: Settings, ledger: Ledger, plan: Plan, budget: CycleBudget | None = None, stop: Callable[[], bool] = lambda: False, sleep=time.sleep) -> int:
    """Classifies what the ledger lacks, a chunk a commit; returns the number of rows committed.

    Chunks are cut by a hash of the item, so each is a filter on the items and no chunk is collected. A stop
    loses nothing, calls under way are committed; a crash loses the chunk that was under way. Every chunk's limiters begin empty, so where calls are limited a
    chunk begins a window's length after the one before ended."""
    n = items.count()
    size = max(1, plan.chunk)
    parts = max(1, -(-n // size))
    budget = budget or CycleBudget(plan.cycle_seconds, plan.cycle_calls, ledger.metadata_of("cycle.json"))
    done, began, ended = 0, time.time(), None
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64(*KEYS), F.lit(parts)) == k)
        while True:  # a chunk above the cycle's budget goes in pieces
            if stop():
                log.info("stopped between chunks; %d rows are committed", done)
                return done
            if plan.cycle_calls and (free := budget.free()) < 1:
                log.info("cycle %d is used up; waiting for the next", budget.state["cycle"])
                sleep(budget.wait())
                continue
            some = part.orderBy(*KEYS).limit(free) if plan.cycle_calls else part
            if plan.per_task and ended is not None and (rest := plan.seconds - (time.time() - ended)) > 0:
                sleep(rest)
            seq = ledger.next_seq()
            count = some.count() if plan.cycle_calls else 0
            cycle = budget.reserve(count)
            if plan.cycle_calls:
                ledger.write_metadata_of("cycle.json", budget.state)
            ledger.append(called(classify(some, backend, settings)), seq)
            ended = time.time()
            new = ledger.read().filter(F.col("seq") == seq)
            got = new.agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_failed("label")).alias("ok")).first()
            done += got["n"]
            rate = done / max(1e-9, time.time() - began)
            log.info("%d of %d items (%.1f%%), %.1f a second, about %s left", done, n, 100 * done / max(1, n), rate, duration_text((n - done) / rate if rate else 0))
            if plan.cycle_calls:
                budget.settle(count, got["ok"], cycle)
                ledger.write_metadata_of("cycle.json", budget.state)
                if got["n"]:
                    part = merge.resume_todo(part, new)
                    if not part.isEmpty():
                        continue
            break
    return done


def prepared(spark: SparkSession, settings: Settings, path: str, first: int | None = None, random: int | None = None, seed: int | None = None, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All rows of the input, and its distinct items (keys, ord, the extra columns that are there)."""
    required = [settings.text_column, *([settings.context_column] if settings.context_column else [])]
    rows = read_table(spark, path, required)
    unique = dedup.keep_first(rows, settings.text_column, settings.context_column)
    kept = unique.select(*KEYS, "ord", *(c for c in extra if c in rows.columns))
    return rows, dedup.sample(kept, first, random, seed=seed)


def named(results: DataFrame, settings: Settings, more: tuple[str, ...] = ()) -> DataFrame:
    """With the input's own column names, in the order of the files."""
    keys = [F.col("key_text").alias(settings.text_column), *([F.col("key_context").alias(settings.context_column)] if settings.context_column else [])]
    return results.select(*keys, *more, "ord")


def run_folder(settings: Settings, first: int | None, random: int | None, input_csv: str | None, now: datetime) -> Path:
    if input_csv:
        tag = f"rerun_{Path(input_csv).stem}"
    elif first is not None:
        tag = f"test_first{first}"
    else:
        tag = f"test_random{random}" if random is not None else "full"
    return Path(settings.output_dir) / f"run_{now:%Y%m%d_%H%M%S}_{tag}"


def meta_of(settings: Settings) -> dict:
    return {
        "threshold": settings.threshold,
        "concurrency": settings.workers,
        "model": settings.model_name,
        "base_url": settings.api_base,
        "prompt_hash": hashlib.md5(settings.system_prompt.encode()).hexdigest()[:8],
    }


def dry_run(items: DataFrame, settings: Settings, ledger: Ledger | None) -> dict:
    """What a run would do; no call."""
    n = items.count()
    out = {"items": n, "estimated_tokens": n * settings.tokens_per_call, "plan": Plan.of(settings).describe()}
    if ledger is not None:
        have = ledger.successes()
        out |= {"existing": have.count(), "remaining": merge.resume_todo(items, have).count()}
    return out


def run(spark: SparkSession, settings: Settings, backend: Backend | None = None, first: int | None = None, random: int | None = None, input_csv: str | None = None, resume: bool = False, fresh: bool = False, dry: bool = False, seed: int | None = None, stop: Callable[[], bool] = lambda: False) -> dict:
    """Returns the paths written, or a dry run's figures.

    resume works on the ledger <output>/ledger, fresh empties it first; otherwise the run has a ledger of its own."""
    if input_csv and (first is not None or random is not None):
        raise Exclusive("an input file to compare with can't be combined with a sample")
    if input_csv and resume:
        raise Exclusive("an input file to compare with can't be combined with resuming")
    if not dry:
        settings.validate()
    began, now = time.time(), datetime.now()
    source = input_csv or settings.input_path
    _, items = prepared(spark, settings, source, first, random, seed, extra=("label",) if input_csv else ())
    shared = Ledger(spark, Path(settings.output_dir) / "ledger") if resume else None
    if dry:
        return dry_run(items, settings, shared)
    folder = run_folder(settings, first, random, input_csv, now)
    folder.mkdir(parents=True, exist_ok=True)
    ledger = shared or Ledger(spark, folder / "ledger")
    if resume:
        if fresh:
            ledger.drop()
        for change in drift(ledger.metadata(), meta_of(settings)):
            log.warning("the ledger is of another setting: %s; start fresh to redo it", change)
        ledger.set_metadata(meta_of(settings))
    with logged_to(folder / "run.log"):
        log.info("run folder %s; model %s at %s; %s", folder, settings.model_name, settings.api_base, Plan.of(settings).describe())
        return run_in(spark, settings, backend, folder, items, ledger, source, resume, bool(input_csv), stop, began)


def run_in(spark: SparkSession, settings: Settings, backend: Backend | None, folder: Path, items: DataFrame, ledger: Ledger, source: str, resume: bool, compare: bool, stop: Callable[[], bool], began: float) -> dict:
    # the snapshot of items cuts the input's lineage: a random sample must be the same in every later stage
    items.write.parquet(str(folder / "items"))
    items = spark.read.parquet(str(folder / "items"))
    write_csv(named(items, settings), folder / "unique_items.csv", order="ord")
    existing = ledger.successes()
    todo = merge.resume_todo(items, existing)
    plan = Plan.of(settings)
    with StopSignal(spark, stop) as signal:
        commit_in_chunks(todo, backend or http(settings, plan, signal=signal), settings, ledger, plan, stop=stop)
    everything = ledger.results().join(items.select(*KEYS, "ord"), KEYS)
    everything = everything.unionByName(cancelled(items, everything), allowMissingColumns=True)
    checked = labels.post_validate(everything, settings.category_list)
    checked.write.parquet(str(folder / "results"))
    checked = spark.read.parquet(str(folder / "results"))
    paths = write_outputs(checked, items, settings, folder, source, compare=compare and "label" in items.columns)
    if resume:
        # history first, so that what this run says of an item comes last; failed rows of other runs go
        ledger.replace(merge.with_history(checked.filter("seq IS NOT NULL"), ledger.successes()))
        everything = ledger.results().withColumn("ord", F.struct("seq", *KEYS))
        write_csv(named(everything, settings, RESULT_COLUMNS), Path(settings.output_dir) / "classification_result_accumulated.csv", order="ord")
        if output_format(settings.output_format, source) == "xlsx":
            paths["xlsx"] = write_table(named(everything, settings, RESULT_COLUMNS), folder / "classification_result", "xlsx", order="ord")
    report.write_report(checked, answers_of(checked), settings, folder, time.time() - began)
    return {"folder": str(folder), **paths}


def cancelled(items: DataFrame, results: DataFrame) -> DataFrame:
    """Result rows of items that a stopped run never called; they are reported, but never committed."""
    rows = merge.resume_todo(items.select(*KEYS, "ord"), results)
    values = {"label": PROCESSING_ERROR, "confidence_detail": "graceful shutdown", "is_low_confidence": "yes", "parse_status": "cancelled"}
    return rows.withColumns({k: F.lit(v) for k, v in values.items()} | {"confidence": F.lit(0)})


@contextlib.contextmanager
def logged_to(path: Path):
    """What is logged meanwhile also goes to a file."""
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    before = log.level
    log.addHandler(handler)
    log.setLevel(min(logging.INFO, before or logging.INFO))
    try:
        yield
    finally:
        log.removeHandler(handler)
        log.setLevel(before)
        handler.close()


def answers_of(results: DataFrame) -> DataFrame:
    return results.withColumn("total_tokens", F.col("tokens_used"))


def write_outputs(results: DataFrame, items: DataFrame, settings: Settings, folder: Path, source: str, compare: bool) -> dict:
    paths = {"csv": str(folder / "classification_result.csv")}
    columns = RESULT_COLUMNS
    if compare:
        results, columns = merge.compare(results, items), (*RESULT_COLUMNS, *COMPARE_COLUMNS)
        differ = results.filter(F.col("compare_is_match") == "no")
        totals = merge.compare_summary(results).first()
        log.info("%d of %d match (%.1f%%)", totals["matched"], totals["total"], totals["match_pct"])
        if totals["differ"]:
            paths["diff"] = str(folder / "classification_diff.csv")
            write_csv(named(differ, settings, ("compare_old_label", "label", "confidence", "parse_status")), paths["diff"], order="ord")
    write_csv(named(results, settings, columns), paths["csv"], order="ord")
    wrong = labels.audit(results)
    if not wrong.isEmpty():
        paths["audit"] = str(folder / "post_validation.csv")
        write_csv(named(wrong, settings, ("raw_label", "invalid_names", "confidence_detail")), paths["audit"], order="ord")
    if output_format(settings.output_format, source) == "xlsx":
        paths["xlsx"] = write_table(named(results, settings, columns), folder / "classification_result", "xlsx", order="ord")
    return paths
