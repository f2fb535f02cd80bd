"""Retrying failed results until nothing more succeeds."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.backends import Backend, http
from tagmill.config import Settings
from tagmill.identity import KEYS, with_keys
from tagmill.operators import dedup, failures, labels, merge
from tagmill.operators.throttle import Plan
from tagmill.plans.classify import commit_in_chunks, named
from tagmill.schemas import RESULT_COLUMNS
from tagmill.sources.files import file_format, read_table, write_csv, write_table
from tagmill.sources.ledger import Ledger
from tagmill.stopping import StopSignal

log = logging.getLogger("tagmill")


def counts(rows: DataFrame) -> dict[str, int]:
    """The most frequent type first."""
    return {r["failure_type"]: r["n"] for r in failures.ranked(failures.breakdown(rows)).orderBy("place").collect()}  # six types at most


def round_of(failed: DataFrame, streak: DataFrame, backend: Backend, settings: Settings, ledger: Ledger, plan: Plan, stop: Callable[[], bool]) -> DataFrame | None:
    """Results of the items that are worth another try, or None where there are none."""
    tried = dedup.keep_first(failures.eligible(failed, streak), "key_text", "key_context").select(*KEYS, "ord")
    if tried.isEmpty():
        return None
    commit_in_chunks(tried, backend, settings, ledger, plan, stop=stop)
    got = ledger.results().join(tried.select(*KEYS, "ord"), KEYS)
    return labels.post_validate(got, settings.category_list).drop("raw_label", "invalid_names")


def retry(spark: SparkSession, settings: Settings, source: str | Path, backend: Backend | None = None, max_rounds: int = 3, dry: bool = False, stop: Callable[[], bool] = lambda: False) -> dict:
    """Reads results of any supported format, retries the failed ones, writes the file back after every round.

    Every round's state is written and read again: calls aren't repeated and lineage doesn't grow."""
    source = str(source)
    rows = with_keys(read_table(spark, source, [settings.text_column, *([settings.context_column] if settings.context_column else [])]), settings.text_column, settings.context_column)
    lacking = [c for c in RESULT_COLUMNS if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in lacking}).select(*KEYS, "ord", *RESULT_COLUMNS)
    good, bad = merge.split(rows)
    if dry:
        return {"failures": bad.count(), "breakdown": counts(bad)}
    settings.validate()
    plan = Plan.of(settings)
    streak = spark.createDataFrame([], "key_text string, key_context string, streak long")
    base = Path(source).parent / f"run_{datetime.now():%Y%m%d_%H%M%S_%f}_retry"
    history: list[dict] = []
    for number in range(1, max_rounds + 1):
        folder = Path(f"{base}_round{number}")
        before = counts(bad)
        if not before:
            break
        with StopSignal(spark, stop) as signal:
            outcome = round_of(bad, streak, backend or http(settings, plan, signal=signal), settings, Ledger(spark, folder / "ledger"), plan, stop)
        if outcome is None:
            break
        keep = [*KEYS, "ord", *RESULT_COLUMNS]
        text = outcome.select(*KEYS, "ord", *(F.col(c).cast("string") for c in RESULT_COLUMNS))
        text.write.parquet(str(folder / "outcome"))
        text = spark.read.parquet(str(folder / "outcome"))
        new_good, new_bad = merge.retry_merge(good, bad, text)
        for name, df in (("good", new_good.select(*keep)), ("bad", new_bad.select(*keep)), ("streak", failures.next_streaks(streak, text))):
            df.write.parquet(str(folder / name))
        good, bad, streak = (spark.read.parquet(str(folder / name)) for name in ("good", "bad", "streak"))
        write_back(good, bad, settings, source)
        recovered = text.filter(~failures.is_failed("label")).count()
        history.append({"round": number, "recovered": recovered, "before": before, "after": counts(bad)})
        log.info("round %d: %d recovered, failures %s, then %s", number, recovered, before, history[-1]["after"])
        if not recovered or stop():
            break
    given_up = failures.with_streak(bad, streak).filter(failures.exhausted()).count()
    return {"rounds": history, "failures": bad.count(), "exhausted": given_up}


def write_back(good: DataFrame, bad: DataFrame, settings: Settings, path: str) -> None:
    """Successes, then failures, each in their order; the file is replaced as a whole."""
    rows = named(merge.written_order(good, bad), settings, RESULT_COLUMNS)
    if file_format(path) == "xlsx":
        write_table(rows, path, "xlsx", order="ord")
    else:
        write_csv(rows, path, order="ord")
