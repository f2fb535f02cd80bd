"""The ledger: an append-only table of results, the ground truth of what has been called.

A chunk of results is committed as one Parquet append before anything reads it, so a crash loses a chunk at most and a
rerun repeats no committed call. Rewriting makes a new version in a folder of its own; then a pointer file with the next number is renamed into place, and the newest one counts."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.identity import KEYS
from tagmill.operators.failures import is_failed
from tagmill.schemas import LEDGER


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each item."""
    last = Window.partitionBy(*KEYS).orderBy(F.desc("seq"))
    return rows.withColumn("_i", F.row_number().over(last)).filter("_i = 1").drop("_i")


class Ledger:
    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, str(path).rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the whole files of this name, the newest last."""
        where, fs = self._fs(self.path)
        if not fs.exists(where):
            return []
        there = (status.getPath().getName() for status in fs.listStatus(where))
        return sorted(int(x.removeprefix(f"{name}.")) for x in there if x.startswith(f"{name}.") and x.removeprefix(f"{name}.").isdigit())

    def _read(self, name: str) -> dict | None:
        numbers = self._numbers(name)
        if not numbers:
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}.{numbers[-1]}").collect()))

    def _write(self, name: str, value: dict) -> None:
        """A new file with the next number, renamed into place when it is whole; only then the older ones go.

        Whenever this stops, the newest whole file is there."""
        numbers = self._numbers(name)
        beside, fs = self._fs(f"{self.path}/{name}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not fs.rename(beside, self._fs(f"{self.path}/{name}.{numbers[-1] + 1 if numbers else 1}")[0]):
            raise OSError(f"{self.path}/{name} can't be renamed into place")
        for n in numbers:
            fs.delete(self._fs(f"{self.path}/{name}.{n}")[0], False)

    @property
    def version(self) -> str:
        return (self._read("current.json") or {}).get("version", "v0")

    def append(self, rows: DataFrame, seq: int | None = None) -> None:
        """Commits a chunk. Chunks without a number of their own follow all earlier ones."""
        number = self.next_seq() if seq is None else seq
        rows.select(*(F.lit(number).cast("long").alias("seq") if f.name == "seq" else (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER)).write.mode("append").parquet(f"{self.path}/{self.version}")

    def next_seq(self) -> int:
        return (self.read().agg(F.max("seq")).first()[0] or 0) + 1

    def read(self) -> DataFrame:
        """All rows; a ledger that isn't there is empty."""
        path = f"{self.path}/{self.version}"
        where, fs = self._fs(path)
        return self.spark.read.schema(LEDGER).parquet(path) if fs.exists(where) else self.spark.createDataFrame([], LEDGER)

    def results(self) -> DataFrame:
        return latest(self.read())

    def successes(self) -> DataFrame:
        """By item, the last result that didn't fail."""
        return latest(self.read().filter(~is_failed("label")))

    def replace(self, rows: DataFrame) -> None:
        """Rewrites the ledger as rows, then makes the new version current."""
        name = f"v{uuid.uuid4().hex}"
        old = self.version
        rows.select(*(F.col(f.name).cast(f.dataType) for f in LEDGER)).write.parquet(f"{self.path}/{name}")
        self._write("current.json", {"version": name})
        where, fs = self._fs(f"{self.path}/{old}")
        fs.delete(where, True)

    def drop(self) -> None:
        where, fs = self._fs(self.path)
        fs.delete(where, True)

    def metadata(self) -> dict | None:
        return self._read("meta.json")

    def metadata_of(self, name: str) -> dict | None:
        return self._read(name)

    def write_metadata_of(self, name: str, value: dict) -> None:
        self._fs(self.path)[1].mkdirs(self._fs(self.path)[0])
        self._write(name, value)

    def set_metadata(self, value: dict) -> None:
        self._fs(self.path)[1].mkdirs(self._fs(self.path)[0])
        self._write("meta.json", value)


def drift(old: dict | None, new: dict) -> list[str]:
    """What a resumed run does differently from the one before."""
    keys = ("threshold", "model", "base_url", "prompt_hash")
    return [f"{k} was {old[k]}, is {new[k]}" for k in keys if old and old.get(k) is not None and old[k] != new[k]]
