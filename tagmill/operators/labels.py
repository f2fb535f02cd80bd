"""Label strings against the closed list: names joined by |."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions.text import fuzzy_names, strip
from tagmill.schemas import FAILURES, UNCLASSIFIED


def _list(categories: list[str]) -> Column:
    return F.array(*map(F.lit, categories)).cast("array<string>")


def validate_name(df: DataFrame, name: str, categories: list[str]) -> DataFrame:
    """df with validated (the category or the name as it is) and exact (whether it is one, blanks around it aside)."""
    cats, own = _list(categories), F.col(name)
    exact = F.when(F.array_contains(cats, own), own).when(F.array_contains(cats, strip(own)), strip(own))
    close = fuzzy_names(categories)(F.array(F.when(exact.isNull(), own)))
    step = df.withColumn("_close", close)
    return step.select(*(df[c] for c in df.columns), F.coalesce(exact, F.get("_close", F.lit(0)), own).alias("validated"), exact.isNotNull().alias("exact"))


def valid_names(label: Column, categories: list[str]) -> Column:
    """Distinct known names of a label, in order."""
    names = F.transform(F.split(F.coalesce(label, F.lit("")), r"\|"), strip)
    return F.array_distinct(F.filter(names, lambda x: F.array_contains(_list(categories), x)))


def post_validate(results: DataFrame, categories: list[str]) -> DataFrame:
    """results with labels cut down to known names; raw_label and invalid_names are null where nothing was wrong."""
    label = F.coalesce(F.col("label"), F.lit(""))
    names = F.transform(F.split(label, r"\|"), strip)
    bad = F.filter(names, lambda x: ~F.array_contains(_list(categories), x))
    step = results.withColumn("_bad", F.when((label == "") | label.isin(*FAILURES), F.array().cast("array<string>")).otherwise(bad)).withColumn("_good", valid_names(label, categories))
    wrong, some = F.size("_bad") > 0, F.size("_good") > 0
    listed = F.array_join("_bad", ", ")
    status = F.coalesce(F.col("parse_status"), F.lit(""))
    return step.withColumns(
        {
            "raw_label": F.when(wrong, F.col("label")),
            "invalid_names": F.when(wrong, F.array_join("_bad", "|")),
            "label": F.when(wrong & some, F.array_join("_good", "|")).when(wrong, F.lit(UNCLASSIFIED)).otherwise(F.col("label")),
            "is_low_confidence": F.when(wrong & ~some, F.lit("yes")).otherwise(F.col("is_low_confidence")),
            "parse_status": F.when(wrong & some, F.concat(status, F.lit("; post_validate removed: "), listed)).when(wrong, F.concat(status, F.lit("; post_validate all_invalid: "), listed)).otherwise(F.col("parse_status")),
        }
    ).drop("_bad", "_good")


def audit(validated: DataFrame) -> DataFrame:
    """Of post_validate's rows those whose label had unknown names."""
    return validated.filter(F.col("raw_label").isNotNull())
