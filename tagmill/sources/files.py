"""Tables in files: CSV and Excel, in and out. Values are read as text; what counts as missing is a parameter."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCEL = (".xlsx", ".xlsm")


class MissingColumns(ValueError):
    pass


def file_format(path: str | Path) -> str:
    return "xlsx" if str(path).lower().endswith(EXCEL) else "csv"


def output_format(wanted: str, input_path: str | Path) -> str:
    return file_format(input_path) if wanted == "auto" else wanted


def read_table(spark: SparkSession, path: str | Path, required: Iterable[str] = (), na_values: Iterable[str] = ()) -> DataFrame:
    """All columns as text, and `ord`, which follows the order of a single file's rows."""
    path = str(path)
    if file_format(path) == "xlsx":
        df = _read_excel(spark, path)
    else:
        # a quoted field may hold line ends and doubled quotes; the reader strips a byte order mark
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    if absent := [c for c in required if c not in df.columns]:
        raise MissingColumns(f"{path} has no column {', '.join(absent)}; it has {', '.join(df.columns)}")
    if na := list(na_values):
        df = df.select(*(F.when(~df[c].isin(na), df[c]).alias(c) for c in df.columns))
    return df.withColumn("ord", F.monotonically_increasing_id())


def _read_excel(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    try:
        first = pd.read_excel(path, dtype=str)
    except ImportError as e:
        raise RuntimeError("reading Excel files needs openpyxl") from e
    return spark.createDataFrame(first.astype(object).where(first.notna(), None), schema=", ".join(f"`{c}` string" for c in first.columns))


def write_csv(df: DataFrame, path: str | Path, order: str | None = None) -> int:
    """One CSV file with a header and a byte order mark, for people; rows stream through the driver, a partition at a time.

    For large results write the DataFrame itself: df.write.csv(folder)."""
    if order:
        df = df.orderBy(order)
    columns = [c for c in df.columns if c != order]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    beside, n = f"{path}.tmp", 0
    with open(beside, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for row in df.select(*columns).toLocalIterator():
            out.writerow(["" if x is None else x for x in row])
            n += 1
    os.replace(beside, path)  # readers see the old file or the new one
    return n


def write_table(df: DataFrame, path: str | Path, fmt: str, order: str | None = None) -> str:
    """The suffix follows the format."""
    target = str(Path(path).with_suffix(".xlsx" if fmt == "xlsx" else ".csv"))
    if fmt != "xlsx":
        write_csv(df, target, order)
        return target
    rows = df.orderBy(order).drop(order) if order else df
    try:
        rows.toPandas().to_excel(target, index=False)
    except ImportError as e:
        raise RuntimeError("writing Excel files needs openpyxl") from e
    return target
