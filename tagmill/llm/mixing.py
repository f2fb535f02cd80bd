"""Mixing sources to target weights, to the word, by distributed prefix sums.

Weights go to the sources in code-point order (null last), repeating. The budget is shared by weight; a source's target
stops at `most` times its size and the excess is shared anew among the others, until none is above. Each document
gets a key that is random by hash and the same in every run; the keys of a source are cut into ranges, as many as its rows
need, so that no task sorts more than a range of even the largest source. Running sums inside the ranges, plus the sums
of the ranges before in the same block of ranges, plus those of the blocks before give each document's place in its source,
so no task adds up more than a block of ranges, or the blocks of a source. Whole epochs of the source come first, then documents
in key order up to the exact budget; the one document that the budget cuts counts in part.

Only ids, sizes and keys are shuffled, never texts. Sources are a table like any other and may be many.

Defined results: null or blank text has size 0; documents of size 0 are returned and taken 0 times; a source without words
has target 0; null sources are one source; rows that repeat an id are documents of their own, in an order that is fixed
where they differ; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import BLANK_WORD, stage, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 20
#: Rows that a range of keys holds on average.
RANGE_ROWS = 4_000
#: Ranges whose sums one task adds up in their order.
BLOCK_RANGES = 4_096


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, source, size and key of each document."""
    return docs.select(
        docs.doc_id,
        docs.source.cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs.text.cast("string"), F.lit(BLANK_WORD)), F.lit(0)).cast("long").alias("size"),
        # with the text, so that rows that share an id, or have none, are in many ranges
        F.pmod(F.xxhash64(F.lit(SEED), docs.doc_id, docs.text.cast("string")), F.lit(1 << 62)).alias("key"),
        F.xxhash64(docs.text.cast("string")).alias("tie"),
    )


def ranked_sources(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """A row per source: rows, source_size, weight by rank.

    The rank comes from range-sorted partitions and their counts, so no task holds all sources."""
    sums = stage(rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")), "mix-sources")
    parted = stage(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranks")
    within = parted.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    before = parted.groupBy("part").count()
    # one row per partition of the range sort: its number is bounded by spark.sql.shuffle.partitions
    starts = before.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"))
    place = (F.col("start") + F.col("i")) % len(weights) + 1
    return within.join(F.broadcast(starts), "part").select("source", "rows", "source_size", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float = 1.0, most: float = MOST) -> DataFrame:
    """Adds target: the budget (share times all sizes) by weight, none above most times its source."""
    cap = F.lit(float(most)) * F.col("source_size")
    level = None
    while True:  # each round at least one more source is full; a level is words per unit of weight
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not got["weight"]:
            break
        new = (share * (got["all"] or 0) - (got["full"] or 0.0)) / got["weight"]
        if level is not None and new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level if level is not None else 0.0)).cast("double"))


def ranges_ahead(ranged: DataFrame) -> DataFrame:
    """s, r (source and range) and the sum of sizes in all ranges of the source before it."""
    block = F.floor(F.col("range") / F.lit(float(BLOCK_RANGES))).cast("long")
    sums = stage(ranged.groupBy("source", "range").agg(F.sum("size").alias("of_range")).withColumn("block", block), "mix-ranges")
    blocks = sums.groupBy("source", "block").agg(F.sum("of_range").alias("of_block"))
    before = lambda name, line: F.sum(name).over(line) - F.col(name)
    whole = blocks.select(F.col("source").alias("of"), F.col("block").alias("b"), before("of_block", Window.partitionBy("source").orderBy("block")).alias("whole"))
    inner = sums.select("source", "range", "block", before("of_range", Window.partitionBy("source", "block").orderBy("range")).alias("part"))
    both = inner.join(whole, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    return both.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("whole") + F.col("part")).alias("ahead"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    rows = stage(measured(docs), "mix-rows")
    sources = stage(targets(ranked_sources(rows, weights), share, most), "mix-targets")
    per = sources.select(F.col("source").alias("of"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("rows") / range_rows)).alias("ranges"))
    # a hash join: the sources of one query are few; beyond Spark's own broadcast limit it is a skew-split sort-merge join
    known = rows.join(per, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranged = known.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 62)) * F.col("ranges")).cast("long"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ranges_ahead(ranged)
    placed = ranged.withColumn("upto", F.sum("size").over(inside)).join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    start = F.col("ahead") + F.col("upto") - F.col("size")
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
