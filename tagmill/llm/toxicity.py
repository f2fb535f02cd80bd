"""Toxicity: logistic regression by FTRL-proximal over hashed words, word beginnings, word pairs and skip-grams.

Per-coordinate learning rates and L1 leave few weights that aren't zero; those alone are broadcast. A feature counts once
per text, however often it stands there, so neither length nor repetition dilutes or inflates a score. Labels are
learnt from at most about TRAIN_ROWS labelled documents and TRAIN_BYTES of their text, chosen by hash, outside the held-out
fold; a row that repeats teaches once. Many tasks make features and count in how many texts each stands; one task learns, in
batches of BATCH texts, and holds the features of the bounded sample only. Scores are computed over whole texts.

Defined results: null and empty texts have the score of the bias alone; rows without a label (or with a null one) teach
nothing; without any label all scores are 0; a null doc_id is in the fold of the empty text; repeated rows are scored each;
columns other than id and text are never read for a score. `scored` packs a row's columns in one, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import crc_mod, release, small_batches, stage, table
from tagmill.llm.wordhash import PLAIN_WORDS, Hasher, chunks, grams, utf8

BITS = 20
TRAIN_ROWS = 20_000
TRAIN_BYTES = 32 << 20
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Bytes of the word beginnings that count as features of their own: forms of a word that were never seen share them.
HEADS = (4, 5, 6, 7, 8, 10)
EPOCHS = 4
#: Texts whose gradients are taken at the same weights.
BATCH = 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 0.1
#: A text moves |z| by less than 1 an epoch while the weight is 0: what stands in fewer texts can't pass L1.
MIN_TEXTS = int(L1 // EPOCHS) + 1


def features(hasher: Hasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text of each, with repetitions."""
    words, counts, heads = hasher.words(texts, HEADS)
    owner = np.repeat(np.arange(len(counts)), counts)
    made = [(h, owner[at]) for h, at in heads]
    made += [grams(words, counts, 1), grams(words, counts, 2), grams(words, counts, 2, 2), grams(words, counts, 2, 3)]
    return np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h, _ in made]), np.concatenate([o for _, o in made])


def distinct_features(hasher: Hasher, texts: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text its features, once each, in order."""
    for _, part in chunks(texts):
        at, owner = features(hasher, part)
        pairs = np.unique((owner << BITS) | at)
        ends = np.searchsorted(pairs >> BITS, np.arange(1, len(part)))
        yield from (x.astype(np.int32) for x in np.split(pairs & ((1 << BITS) - 1), ends))


class Ftrl:
    """FTRL-proximal; coordinate 0 past the features is the bias and is not shrunk by L1."""

    def __init__(self, dims: int):
        self.z, self.n = np.zeros(dims + 1), np.zeros(dims + 1)
        self.l1 = np.full(dims + 1, L1)
        self.l1[dims] = 0.0

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, which: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> None:
        """A batch: its coordinates `at`, once each; entries are at[which] in the text `owner`."""
        w = self.weights(at)
        margin = np.bincount(owner, w[which], len(labels))
        g = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels)[owner]
        n = self.n[at]
        more = n + np.bincount(which, g * g, len(at))
        self.z[at] += np.bincount(which, g, len(at)) - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def batch_of(rows: list[np.ndarray], labels: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What Ftrl.learn takes, made once for all epochs."""
    part = [np.append(x, np.int32(1 << BITS)) for x in rows]
    at, which = np.unique(np.concatenate(part), return_inverse=True)
    return at, which.astype(np.int32), np.repeat(np.arange(len(part), dtype=np.int8), [len(x) for x in part]), np.array(labels)


def fit(rows: Iterator[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the features that matter, the bias last. rows: distinct features and label of each text."""
    made, held = [], []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            made.append(batch_of(*map(list, zip(*held, strict=True))))
            held = []
    if held:
        made.append(batch_of(*map(list, zip(*held, strict=True))))
    model = Ftrl(1 << BITS)
    for _ in range(EPOCHS if made else 0):
        for batch in made:
            model.learn(*batch)
    w = model.weights(slice(None))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, folds: int, held_out: int) -> DataFrame:
    """doc_id, text, label of the rows that teach, within the bounds."""
    usable = labels.select("doc_id", F.col(label).cast("double").alias("label")).filter(F.col("label").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out)).distinct()
    n = usable.count()
    share = lambda part: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * part)
    part = min(1.0, rows / max(1, n))
    # broadcast: about `rows` pairs of numbers at most
    known = lambda part: F.broadcast(usable.filter(share(part)) if part < 1 else usable)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = texts.join(known(part), "doc_id").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part *= min(1.0, most_bytes / max(1, size))
    return texts.join(known(part), "doc_id").distinct()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[np.ndarray, np.ndarray]:
    """Fits on about `rows` labelled documents of the other folds; labels may be any table of doc_id and label."""
    small_batches(docs.sparkSession)
    chosen = labelled(docs, labels, label, rows, most_bytes, folds, held_out)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PLAIN_WORDS)
        for b in batches:
            rows = list(distinct_features(hasher, utf8(b.column(0))))
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))], names=["place", "tie", "label", "at"])
        release()

    # the order of learning must not depend on how rows arrive; hashes of ids mix the sources
    keyed = chosen.select("text", F.xxhash64("doc_id", F.lit(1)).alias("place"), F.xxhash64("text").alias("tie"), "label")
    made = stage(keyed.mapInArrow(extract, "place long, tie long, label double, at array<int>"), "toxicity-features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BITS, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(), minlength=1 << BITS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["at", "n"])

    # at most 2^BITS numbers
    often = made.select("at").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TEXTS).select("at").toArrow()
    mask = np.zeros(1 << BITS, bool)
    mask[often.column(0).to_numpy()] = True
    keep = docs.sparkSession.sparkContext.broadcast(mask)

    def rows_of(values: pa.ListArray) -> Iterator[np.ndarray]:
        ends, at = values.offsets.to_numpy(), values.values.to_numpy()
        return (at[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x[keep.value[x]] for x in rows_of(b.column(3))]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))], names=["place", "tie", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = fit(row for b in batches for row in zip(rows_of(b.column(1)), b.column(0).to_pylist(), strict=True))
        release()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "weight"])

    ordered = made.mapInArrow(sift, made.schema).repartition(1).sortWithinPartitions("place", "tie", "label").select("label", "at")
    model = ordered.mapInArrow(learn, "at long, weight double").toArrow()
    return model.column(0).to_numpy(), model.column(1).to_numpy()


def scores(model: tuple[np.ndarray, np.ndarray], texts: list[bytes]) -> np.ndarray:
    at, weight = model
    dense = np.zeros((1 << BITS) + 1)
    dense[at] = weight
    hasher, out = Hasher(PLAIN_WORDS), np.full(len(texts), dense[-1])
    if not len(at):
        return np.zeros(len(texts))
    for first, part in chunks(texts):
        found, owner = features(hasher, part)
        live = dense[found] != 0
        pairs = np.unique((owner[live] << BITS) | found[live])
        out[first : first + len(part)] += np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], len(part))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def scorer(spark, model: tuple[np.ndarray, np.ndarray]):
    """A function of a text column: its score."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = pa.array(scores(held.value, utf8(text)), pa.float64())
        release()
        return out

    return score


def score_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """The columns in keep and the score."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.select(*keep, score(F.col("text").cast("string")).alias(into))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (all columns of docs, as one struct) and score."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.select(F.struct(*docs.columns).alias("row"), score(F.col("text").cast("string")).alias("score"))


def predicted(score: Column) -> Column:
    return F.when(score >= THRESHOLD, 1).otherwise(0).cast("int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
