"""Approximate nearest neighbours by largest inner product: inverted lists, scanned dimension by dimension.

Vectors x are lifted to the unit sphere, (x, sqrt(M^2 - |x|^2)) / M with M the largest norm, where the largest inner
product is the least distance, and turned by one random rotation. Centroids come from a bounded sample (k-means on
about SAMPLE rows; every row is indexed); their number grows as the root of the number of distinct vectors. How many lists
a query probes is measured: rows of the sample search the sample, and the share of lists that holds TARGET of their true
neighbours is taken, plus as many lists as it takes to meet REACH times k vectors.

The k-th best distance within the sample, exact, bounds a query's search from the start. Scan of a list, by a number of
queries together: its rotated vectors stand in blocks of columns. After each block the distances so far, d of D columns,
estimate the whole; a candidate is abandoned when its estimate exceeds the k-th best distance known by more than the
estimate's error allows (the hypothesis test of adaptive sampling, EPSILON). Survivors are scored exactly, in double
precision, on the original vectors.

Equal vectors form one class that carries its k + 1 smallest ids: more can't be among k neighbours, so copies, however
many, add no work, and equal queries are searched once. Lists longer than LIST_ROWS and more queries to a list than
QUERY_ROWS are dealt out in blocks; no task holds more than one block of each.

Defined results: vectors that are null, zero, hold null, NaN or infinite components, or haven't the number of components
that most vectors have, take no part, as rows without id; an id that repeats with another vector counts as another row, with
the same vector once; with at most k candidates all are returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import Shared, small_batches, stage, table

K = 20
SAMPLE = 20_000
MOST_LISTS = 8_192
TARGET, REACH = 0.97, 10
#: Rows of the sample that measure how many lists to probe.
TRIALS = 500
LIST_ROWS, QUERY_ROWS = 4_096, 4_096
EPSILON = 2.1
COLUMNS = 16
#: Queries that are scanned together, the share of pairs below which each is followed by itself, numbers scored at once.
TOGETHER, SPARSE, SCORED = 64, 0.1, 2_000_000
#: Error of distances in single precision.
ROUNDING = 1e-5
ITERATIONS = 8


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    largest: float
    sample: np.ndarray  # lifted and rotated
    probes: int = 1

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each aimed query a distance within which at least k + 1 vectors lie."""
        if len(self.sample) <= k + 1:
            return np.full(len(q), np.inf)
        half = (self.sample * self.sample).sum(1)
        return np.concatenate([np.partition(half - 2 * (part @ self.sample.T), k, 1)[:, k] + (part * part).sum(1) for part in (q[i : i + 256] for i in range(0, len(q), 256))]) + ROUNDING

    def measure(self, originals: np.ndarray, k: int) -> None:
        """Sets probes."""
        some = np.linspace(0, len(originals) - 1, min(TRIALS, len(originals))).astype(int)
        order = np.argsort(self.distances(self.aimed(originals[some])), 1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(some), 0), 1)
        home = np.concatenate([np.argmin(self.distances(self.sample[i : i + 4096]), 1) for i in range(0, len(self.sample), 4096)])
        steps = []
        for j, i in enumerate(some):
            score = originals @ originals[i]
            score[i] = -np.inf
            steps.append(place[j, home[np.argpartition(-score, min(k, len(score) - 1))[:k]]])
        self.probes = int(np.quantile(np.concatenate(steps), TARGET)) + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Of indexed vectors (rows of doubles)."""
        x = x / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32) @ self.rotation

    def aimed(self, q: np.ndarray) -> np.ndarray:
        q = q / np.sqrt((q * q).sum(1, keepdims=True))
        return np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids * self.centroids).sum(1) - 2 * (x @ self.centroids.T)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    good = good.filter(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    # zeros of either sign are one value, and a repeated row is one candidate
    plain = F.transform("vec", lambda x: x + F.lit(0.0))
    return good.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0)).select("vec_id", plain.alias("vec"))


def matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 1)


def kmeans(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ITERATIONS):
        half = (centres * centres).sum(1) / 2
        near = np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, 1) for k in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        live = n > 0
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[live])[:-1]]))
        centres = centres.copy()
        centres[live] = sums / n[live, None]
    return centres


def build(classes: DataFrame, k: int = K, lists: int | None = None) -> Index | None:
    got = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.max(F.size("vec")).alias("d")).first()
    if not got["n"]:
        return None
    n = got["n"]
    some = classes.filter(F.pmod(F.xxhash64("cls"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / n))) if n > SAMPLE else classes
    x = matrix(some.select("vec").toArrow().column(0).combine_chunks())
    dims = got["d"] + 1
    rotation = np.linalg.qr(np.random.default_rng(1).normal(size=(dims, dims)))[0].astype(np.float32)
    index = Index(rotation, np.zeros((0, dims), np.float32), float(np.sqrt(got["most"])) * (1 + 1e-12), np.zeros((0, dims), np.float32))
    index.sample = index.lifted(x)
    index.centroids = kmeans(index.sample, max(1, min(len(x), lists or int(n**0.5 / 3), MOST_LISTS)))
    index.measure(x, k)
    return index


def squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances, a row per query."""
    return (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)


def scan(x: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) that may be among the k nearest; bound: per query a distance that the k-th can't exceed.

    While most pairs live, a block of columns is one matrix product; once few do, each is followed by itself."""
    (n, dims), m = x.shape, len(q)
    if n <= 2 * k:
        return np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
    bound = np.full(m, np.inf) if bound is None else bound.copy()
    sure, free = np.zeros(0, np.int64), np.flatnonzero(np.isinf(bound))
    if len(free):  # the first candidates set the distance to beat, and the best of them stay whatever the tests say
        known = squared(x[: 4 * k], q[free])
        best = np.argpartition(known, k - 1, 1)[:, :k]
        sure = (free[:, None] * n + best).ravel()
        bound[free] = np.take_along_axis(known, best, 1).max(1) + ROUNDING
    limit = lambda to: bound * (1 + EPSILON / np.sqrt(to)) ** 2 * (to / dims) if to < dims else bound
    rows, part, at = np.arange(n), np.zeros((m, n), np.float32), 0
    while at < dims and np.isfinite(part).mean() > SPARSE:
        to = min(dims, at + COLUMNS)
        part += squared(x[rows, at:to], q[:, at:to])
        part[part > limit(to)[:, None]] = np.inf  # abandoned
        if not at and to < dims:  # candidates whose distance so far is least lower the bound
            best = np.argpartition(part, k - 1, 1)[:, :k]
            bound = np.minimum(bound, ((x[best] - q[:, None]) ** 2).sum(2).max(1) + ROUNDING)
        live = np.isfinite(part).any(0)
        rows, part, at = rows[live], part[:, live], to
        if not len(rows):
            break
    who, place = np.nonzero(np.isfinite(part))
    which, far = rows[place], part[who, place]
    while at < dims:
        to = min(dims, at + COLUMNS)
        diff = x[which, at:to] - q[who, at:to]
        far = far + (diff * diff).sum(1)
        keep = far <= limit(to)[who]
        who, which, far, at = who[keep], which[keep], far[keep], to
    pairs = np.union1d(who * n + which, sure)
    return pairs // n, pairs % n


def search(rows: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. queries: a condition on vec_id that says which rows are queries."""
    spark = rows.sparkSession
    small_batches(spark)
    clean = usable(rows, id_col, vec_col)
    same = Window.partitionBy("vec").orderBy("vec_id")
    few = clean.withColumn("i", F.dense_rank().over(same)).filter(F.col("i") <= k + 1)
    classes = stage(few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.xxhash64("ids").alias("cls"), "vec", "ids"), "ann-classes")
    index = build(classes, k, lists)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = Shared(spark, index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = held.value.lifted(matrix(b.column(1)))
            near = np.argmin(held.value.distances(x), 1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), b.column(0), b.column(1), b.column(2)], names=["list", "cls", "vec", "ids"])

    placed = stage(classes.select("cls", "vec", "ids").mapInArrow(assign, "list int, cls long, vec array<double>, ids array<long>"), "ann-lists")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).toArrow()
    lengths, members = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids), np.int64)
    lengths[sizes.column(0).to_numpy()], members[sizes.column(0).to_numpy()] = sizes.column(1).to_numpy(), sizes.column(2).to_numpy()
    asked = clean.filter(queries).distinct()
    ask = asked.groupBy("vec").agg(F.min("vec_id").alias("q"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = held.value.aimed(matrix(b.column(1)))
            if not len(x):
                continue
            order = np.argsort(held.value.distances(x), 1, kind="stable")
            met = np.cumsum(members[order], 1)
            need = np.maximum(probes or held.value.probes, (met < REACH * (k + 1)).sum(1) + 1)
            use = np.arange(order.shape[1])[None, :] < need[:, None]
            use &= lengths[order] > 0
            who = np.repeat(np.arange(len(x)), use.sum(1))
            # the first lists, which hold enough for an answer, are searched without a bound
            first = met - members[order] < REACH * (k + 1)
            bound = np.where(first, np.inf, held.value.bounds(x, k)[:, None])[use]
            for at in range(0, len(who), 20_000):
                part = pa.array(who[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(order[use][at : at + 20_000].astype(np.int32)), b.column(0).take(part), b.column(1).take(part), pa.array(bound[at : at + 20_000], pa.float64())], names=["list", "q", "vec", "bound"])

    aims = stage(ask.select("q", "vec").mapInArrow(probe, "list int, q long, vec array<double>, bound double"), "ann-probes")
    # a row per list: at most MOST_LISTS
    turns = aims.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("turns"))
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("blocks"))
    plan = F.broadcast(blocks.join(turns, "list"))
    key = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    line = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    stored = placed.join(plan, "list").select("list", key("cls", "blocks").alias("block"), line("turns").alias("turn"), none.cast("long").alias("q"), "cls", "vec", "ids", none.cast("double").alias("bound"))
    wanted = aims.join(plan, "list").select("list", line("blocks").alias("block"), key("q", "turns").alias("turn"), "q", none.cast("long").alias("cls"), "vec", none.cast("array<long>").alias("ids"), "bound")
    dealt = stored.unionByName(wanted).repartition("list", "block", "turn").sortWithinPartitions("list", "block", "turn", F.col("q").asc_nulls_first(), "cls")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ids, original, x = None, [], [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            is_query = np.asarray(b.column(3).is_valid())
            bounds = b.column(7).to_numpy(zero_copy_only=False)
            vecs, q_ids, id_lists = matrix(b.column(5)), b.column(3).to_pylist(), b.column(6).to_pylist()
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip([0, *ends], ends):
                if tuple(keys[lo]) != at:
                    at, parts, ids, x = tuple(keys[lo]), [], [], None
                mid = hi - int(is_query[lo:hi].sum())  # a block's rows come before its queries
                parts.append(vecs[lo:mid])
                ids.extend(id_lists[lo:mid])
                if mid == hi or not ids:
                    continue
                if x is None:
                    original = np.concatenate(parts)
                    x = held.value.lifted(original)
                for of in range(mid, hi, TOGETHER):
                    to = min(hi, of + TOGETHER)
                    who, which = scan(x, held.value.aimed(vecs[of:to]), k + 1, bounds[of:to])
                    step = max(1, SCORED // vecs.shape[1])
                    score = np.concatenate([np.zeros(0), *((original[which[i : i + step]] * vecs[of + who[i : i + step]]).sum(1) for i in range(0, len(who), step))])
                    cuts = np.searchsorted(who, np.arange(to - of + 1))
                    for j in range(to - of):
                        mine, some = score[cuts[j] : cuts[j + 1]], which[cuts[j] : cuts[j + 1]]
                        if not len(mine):
                            continue
                        # whole classes of equal score before the cut, so that ties go by id
                        cut = -np.partition(-mine, min(k, len(mine) - 1))[min(k, len(mine) - 1)]
                        found = sorted((-mine[i], v) for i in np.flatnonzero(mine >= cut) for v in ids[some[i]])[: k + 1]
                        out[0].extend([q_ids[of + j]] * len(found))
                        out[1].extend(v for _, v in found)
                        out[2].extend(-s for s, _ in found)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["q", "vec_id", "score"])

    found = dealt.mapInArrow(find, "q long, vec_id long, score double")
    # a vector stands in one list, but an id may have several vectors: its best counts
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("i", F.row_number().over(top)).filter(F.col("i") <= k + 1).drop("i")
    whole = asked.select(F.col("vec_id").alias("query_id"), "vec").join(ask, "vec").select("query_id", "q")
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = whole.join(best, "q").filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def recall(found: dict[int, list[int]], ids: np.ndarray, x: np.ndarray, k: int = K) -> float:
    """Against brute force, over the queries found."""
    hits = total = 0
    at = {int(v): i for i, v in enumerate(ids)}
    for q, got in found.items():
        score = x @ x[at[q]]
        score[at[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]].tolist())
        hits, total = hits + len(best & set(got)), total + len(best)
    return hits / max(1, total)
