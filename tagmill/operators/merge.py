"""How results of different runs are put together. All joins are on the identity keys, which are never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.identity import KEYS
from tagmill.operators.failures import is_failed


def resume_hits(items: DataFrame, existing: DataFrame) -> DataFrame:
    """The existing results of items that have one."""
    return existing.join(items.select(*KEYS), KEYS, "left_semi")


def resume_todo(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items without a result."""
    return items.join(existing.select(*KEYS), KEYS, "left_anti")


def with_history(results: DataFrame, existing: DataFrame) -> DataFrame:
    """This run's results, and earlier ones of items that it didn't have."""
    return results.unionByName(existing.join(results.select(*KEYS), KEYS, "left_anti"), allowMissingColumns=True)


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures."""
    failed = is_failed("label")
    return results.filter(~failed), results.filter(failed)


def retry_merge(successes: DataFrame, failures: DataFrame, outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures after a round, whose results are outcome. Failures not tried stay as they were."""
    good, bad = split(outcome)
    untouched = failures.join(outcome.select(*KEYS).distinct(), KEYS, "left_anti")
    return successes.unionByName(good, allowMissingColumns=True), untouched.unionByName(bad, allowMissingColumns=True)


def written_order(successes: DataFrame, failures: DataFrame, order: str = "ord") -> DataFrame:
    """Both with `ord`: successes first."""
    rows = successes.withColumn("_part", F.lit(0)).unionByName(failures.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("ord", F.struct("_part", F.col(order) if order in rows.columns else F.monotonically_increasing_id())).drop("_part")


def same_labels(old: Column, new: Column) -> Column:
    """Whether two labels name the same set; an empty one equals only an empty one."""
    names = lambda c: F.array_sort(F.array_distinct(F.split(c, r"\|")))
    return F.when((old != "") & (new != ""), names(old) == names(new)).otherwise(old == new)


def compare(results: DataFrame, old: DataFrame, old_label: str = "label") -> DataFrame:
    """results with compare_old_label and compare_is_match. old: keys and a label, one row per item."""
    before = old.select(*KEYS, F.coalesce(old[old_label].cast("string"), F.lit("")).alias("compare_old_label"))
    both = results.join(before, KEYS, "left").withColumn("compare_old_label", F.coalesce("compare_old_label", F.lit("")))
    return both.withColumn("compare_is_match", F.when(same_labels(F.col("compare_old_label"), F.coalesce("label", F.lit(""))), "yes").otherwise("no"))


def compare_summary(compared: DataFrame) -> DataFrame:
    n, same = F.count(F.lit(1)), F.count_if(F.col("compare_is_match") == "yes")
    return compared.agg(n.alias("total"), same.alias("matched"), (n - same).alias("differ"), F.when(n > 0, F.round(100.0 * same / n, 1)).otherwise(0.0).alias("match_pct"))
