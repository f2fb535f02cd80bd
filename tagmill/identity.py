"""Which rows are the same item: equal text and, where a context column is set, equal context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["key_text", "key_context"]


def cell(df: DataFrame, name: str) -> Column:
    """The value as text; null and NaN are empty. Neither trimmed nor folded."""
    kind = dict(df.dtypes)[name]
    value = F.when(~F.isnan(df[name]), df[name]) if kind in ("double", "float") else df[name]
    return F.coalesce(value.cast("string"), F.lit(""))


def with_keys(df: DataFrame, text: str, context: str = "") -> DataFrame:
    return df.withColumns({"key_text": cell(df, text), "key_context": cell(df, context) if context else F.lit("")})
