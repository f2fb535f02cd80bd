"""First row of each item, and samples of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.identity import KEYS, with_keys


def keep_first(df: DataFrame, text: str, context: str = "", order: str = "ord") -> DataFrame:
    """The row with the smallest `order` of each item, all columns plus the keys.

    row_number() = 1 becomes a group limit before the shuffle, so a text that a third of all rows share sends one row a task."""
    first = Window.partitionBy(*KEYS).orderBy(order)
    return with_keys(df, text, context).withColumn("_i", F.row_number().over(first)).filter("_i = 1").drop("_i")


def summary(df: DataFrame, text: str, context: str = "") -> DataFrame:
    """n_rows, n_unique, n_duplicates."""
    groups = with_keys(df, text, context).groupBy(*KEYS).count()
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique"))


def head(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return df.orderBy(order).limit(n)


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Exactly min(n, rows) rows, without replacement."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)


def sample(df: DataFrame, first: int | None = None, random: int | None = None, order: str = "ord", seed: int | None = None) -> DataFrame:
    if first is not None:
        return head(df, first, order)
    return random_rows(df, random, seed) if random is not None else df
