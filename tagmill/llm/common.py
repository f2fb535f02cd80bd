"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that end a word where words are runs of anything but ASCII white space; bytes.split() splits on just these.
BLANK = rb"\x20\x09-\x0D"
#: As a regular expression for the JVM.
BLANK_WORD = r"[^\x20\x09-\x0D]+"

_written: list[str] = []


#: Rows and bytes of an Arrow batch, and Spark's own defaults: whole texts are large, and an executor's workers share what
#: its heap leaves.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(8 << 20), "67108864b")}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once; what a session has set itself stays."""
    for key, (most, default) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, most)


class Shared:
    """A broadcast of objects of this package's own classes: they travel by value, so executors need no copy of it.

    A worker loads one once, for all its tasks."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.held, "loaded"):
            self.held.loaded = cloudpickle.loads(self.held.value)
        return self.held.loaded


def release() -> None:
    """Gives freed memory back to the system: workers are used again and share what an executor's heap leaves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(col, UPPER, UPPER.lower())


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where one process is both is one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tagmill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _written:
            remove(spark, path)


def stage(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors, is computed once.

    Not lz4_raw: its reader takes the bytes asked for as the size of the whole page, and a filter on a column reads
    dictionaries in pieces of 8 KB, so that larger ones can't be read back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
