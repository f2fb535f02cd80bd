"""Which results failed, how, and how often in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.text import strip
from tagmill.identity import KEYS
from tagmill.schemas import API_ERROR, FAILURES, PARSE_ERROR, TRANSIENT, UNCLASSIFIED, UNMATCHED

#: Semantic failures in a row after which an item isn't tried again.
STREAK_LIMIT = 2


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unmatched(label: Column) -> Column:
    return F.exists(F.split(label, r"\|"), lambda s: strip(s).startswith(UNMATCHED))


def is_failed(label: str | Column) -> Column:
    """Of the label alone; a null label counts as failed."""
    text = strip(F.coalesce(_col(label), F.lit("")))
    return (text == "") | text.isin(*FAILURES) | _unmatched(text)


def category(label: str | Column, detail: str | Column) -> Column:
    """transient (worth another try as it is) or semantic."""
    return F.when(F.coalesce(_col(label).isin(*TRANSIENT) | F.contains(_col(detail), F.lit(API_ERROR)), F.lit(False)), "transient").otherwise("semantic")


def failure_type(label: str | Column) -> Column:
    text = F.coalesce(_col(label), F.lit(""))
    return F.when(text.isin(*TRANSIENT, PARSE_ERROR, UNCLASSIFIED), text).when(_unmatched(text), "unmatched").otherwise("other")


def breakdown(rows: DataFrame) -> DataFrame:
    """failure_type, n of failed rows."""
    return rows.filter(is_failed("label")).groupBy(failure_type("label").alias("failure_type")).agg(F.count(F.lit(1)).alias("n"))


def ranked(breakdown_: DataFrame) -> DataFrame:
    """A breakdown (six types at most) with the place of each: the most frequent first, ties by name."""
    return breakdown_.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "failure_type")))


def convergence(before: DataFrame, after: DataFrame) -> DataFrame:
    """failure_type, n_before, n_after of the types whose number changed; the arguments are breakdowns."""
    a, b = before.withColumnRenamed("n", "n_before"), after.withColumnRenamed("n", "n_after")
    return a.join(b, "failure_type", "full_outer").na.fill(0, ["n_before", "n_after"]).filter("n_before <> n_after")


def streaks(attempts: DataFrame) -> DataFrame:
    """Keys and streak: semantic failures since an item's last attempt that wasn't one.

    attempts: keys, round, label, confidence_detail. Gaps and islands: one shuffle on the keys."""
    marked = attempts.withColumn("semantic", is_failed("label") & (category("label", "confidence_detail") == "semantic"))
    last_other = F.max(F.when(~F.col("semantic"), F.col("round"))).over(Window.partitionBy(*KEYS))
    counted = marked.withColumn("since", last_other)
    return counted.groupBy(*KEYS).agg(F.count_if(F.col("semantic") & (F.col("since").isNull() | (F.col("round") > F.col("since")))).alias("streak"))


def next_streaks(streak: DataFrame, results: DataFrame) -> DataFrame:
    """The streaks after a round; items without a result in it keep theirs."""
    again = is_failed("label") & (category("label", "confidence_detail") == "semantic")
    now = results.select(*KEYS, again.alias("again"))
    both = streak.join(now, KEYS, "full_outer").select(*KEYS, F.coalesce("streak", F.lit(0)).alias("streak"), "again")
    return both.select(*KEYS, F.when(F.col("again"), F.col("streak") + 1).when(~F.col("again"), 0).otherwise(F.col("streak")).cast("long").alias("streak")).filter("streak > 0")


def with_streak(failures: DataFrame, streak: DataFrame) -> DataFrame:
    return failures.join(streak, KEYS, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def exhausted() -> Column:
    """Of rows with a streak: no further try makes sense."""
    return (category("label", "confidence_detail") == "semantic") & (F.col("streak") >= STREAK_LIMIT)


def eligible(failures: DataFrame, streak: DataFrame) -> DataFrame:
    return with_streak(failures, streak).filter(~exhausted()).drop("streak")
