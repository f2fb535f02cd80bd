"""MinHash near-dedup with HyperMinHash sketches: compressed registers, banding, estimation, exact confirmation.

A document's set is that of its word n-grams (64-bit hashes; of shorter texts the whole sequence). The first 9 bits of a
hash choose one of 512 registers; a register keeps of its smallest remaining value the number of leading zeros (4 bits)
and the next 4 bits: a byte. Empty registers of small sets borrow from others in an order of their own, so that a band is never
one member that many texts share. Six registers make a band: two sets that are 0.8 alike share at least one of the 42 bands
but for about 3 in a million.

  1. Documents with the same set form a class (128-bit fingerprint and size); one of its rows stands for it from here on,
     so copies, however many, cost a row each and no pair.
  2. Band keys are grouped by their smallest class, never expanded: each class of a band is a candidate with that one only.
  3. Candidates whose sketches' Jaccard estimate, corrected for chance equality of compressed registers, lies five standard
     deviations below the bound are dropped; the others are confirmed on their full sets.
  4. Links join classes to components: least label of the neighbours, then pointer jumping; links are then drawn between the
     roots, until none is left. Of each class one candidate is confirmed first, the others only where components are still apart.
  5. Where a band still holds more than one component, classes of different ones that stand side by side in a random order
     are confirmed too, and components joined anew, a few times: most of what belongs together is together after that.
  6. In bands that are still divided, classes that aren't with the smallest are compared with all others, in blocks of
     bounded size inside tasks; only pairs that pass the estimate leave a task, each once, and are confirmed. So no pair that
     shares a band goes untested unless it is already in one component.

Hot groups are split at every step: partial aggregation for copies and bands, salted centres for confirmation, blocks for 6;
tables that are joined on hot keys (bands, components, copies) are written first, so that adaptive execution can split the join.

The input is written once, with a number for each row; all later steps read that table, so a number means one row. Texts and
sketches are filtered where they lie, by a bit map of the numbers that pairs name, before any join: only those travel.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; ids may repeat or be null: rows
are told apart by their place in the input, a component's id is the smallest id in it (null where all are null), and `kept`
says that the row's own id is it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import release, small_batches, stage, table
from tagmill.llm.wordhash import BLANK_WORDS, Hasher, chunks, grams, splitmix, utf8

REGISTERS, MANTISSA = 512, 4
BAND, BANDS = 6, 42
EMPTY, MOST_ZEROS = 0xFF, 14
#: Registers of different values agree by chance about so often: same leading zeros (1/3), same mantissa.
CHANCE = 1 / 3 / (1 << MANTISSA)
DEVIATIONS = 5.0
SALT_ROWS, BLOCK_ROWS, ORDER_ROWS = 64, 512, 4096
#: Words of 64 bits that a bit map of rows has at most; it is exact for some 64 million rows, but for colliding words.
MAP_WORDS = 1 << 20
#: Rounds that compare neighbours of a band before the rest is compared in blocks.
TURNS = 3
WORDS = 5
PERCENT = 80


def sets_of(hasher: Hasher, texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the texts, sorted within each; their counts per text."""
    words, counts = hasher.words(texts)
    h, owner = grams(words, counts, n)
    short = np.repeat(counts < n, counts)
    if short.any():
        some = np.where(counts < n, counts, 0)
        for k in range(1, n):
            mine = np.repeat(some, counts) == k
            if mine.any():
                a, o = grams(words[mine], np.where(some == k, k, 0), k)
                h, owner = np.concatenate([h, a]), np.concatenate([owner, o])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.bincount(owner, minlength=len(texts))


def registers_of(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sketches of sets that are sorted within each text: an array (texts, REGISTERS)."""
    out = np.full((len(counts), REGISTERS), EMPTY, np.uint8)
    owner = np.repeat(np.arange(len(counts)), counts)
    bucket = (h >> np.uint64(55)).astype(np.int64)
    place = owner * REGISTERS + bucket
    first = np.flatnonzero(np.diff(place, prepend=-1))  # sorted: the first of a bucket is its smallest
    rest = (h[first] & np.uint64((1 << 55) - 1)).astype(np.float64)
    bits = rest.view(np.uint64)
    zeros = 54 - ((bits >> np.uint64(52)).astype(np.int64) - 1023)
    mantissa = ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    out.reshape(-1)[place[first]] = np.clip(zeros, 0, MOST_ZEROS) << MANTISSA | mantissa
    return out


def prints(h: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """Order-free 64-bit fingerprints of the sets."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(splitmix(h + np.uint64(seed)))])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, na, nb, bound: float) -> np.ndarray:
    """Whether sketches (rows of a and b) may belong to sets (of na and nb members) at least bound alike.

    Used registers are a sample of the union without replacement: of small sets it is nearly all, and the estimate nearly exact."""
    used = (a != EMPTY) | (b != EMPTY)
    m = np.maximum(used.sum(-1), 1)
    seen = ((a == b) & used).sum(-1) / m
    estimate = (seen - CHANCE) / (1 - CHANCE)
    union = np.maximum((na + nb) / (1 + bound), m)
    margin = DEVIATIONS * np.sqrt((bound * (1 - bound) * (1 - m / union) + (1 - bound) * CHANCE) / m) + 1.5 / m
    sizes = np.minimum(na, nb) >= bound * np.maximum(na, nb) * (1 - 1e-9)
    return sizes & (estimate >= bound - margin)


#: For each register of a band an order of all registers, and the inverse: where a register is empty, the first in its order that isn't lends its value.
ORDER = np.argsort(splitmix(np.arange(BANDS * BAND * REGISTERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS * BAND, REGISTERS), 1).astype(np.int16)
RANK = np.argsort(ORDER, 1).astype(np.int16)


def densified(sketch: np.ndarray) -> np.ndarray:
    """The registers of the bands, none empty unless all are. Two sets' registers still agree as often as the sets are alike."""
    full = sketch != EMPTY
    held, out = full.sum(1), sketch[:, : BANDS * BAND].copy()
    gaps = (out == EMPTY).any(1) & (held > 0)
    many = np.flatnonzero(gaps & (held >= REGISTERS // 3))
    for at in range(0, len(many), 512):
        rows = many[at : at + 512]
        part = out[rows]
        for turn in range(64):
            i, j = np.nonzero(part == EMPTY)
            if not len(i):
                break
            part[i, j] = sketch[rows[i], ORDER[j, turn]]
        out[rows] = part
    for row in np.flatnonzero(gaps & (out == EMPTY).any(1)):
        own, empty = np.flatnonzero(full[row]), np.flatnonzero(out[row] == EMPTY)
        out[row, empty] = sketch[row, own[np.argmin(RANK[np.ix_(empty, own)], 1)]]
    return out


def keys_of(sketch: np.ndarray) -> np.ndarray:
    """Keys of the bands of sketches: an array (texts, BANDS)."""
    dense = densified(sketch).reshape(-1, BANDS, BAND)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(splitmix(np.arange(1, BANDS + 1, dtype=np.uint64)), dense.shape[:2]).copy()
        for k in range(BAND):
            key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + dense[:, :, k].astype(np.uint64))
    return key.view(np.int64)


def band_keys():
    """A function of a sketch: the keys of its bands."""

    @F.arrow_udf("array<bigint>")
    def keys(sketch: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, REGISTERS)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(keys_of(rows).ravel(), pa.int64()))

    return keys


def sketched(rows: DataFrame, words: int) -> DataFrame:
    """rid, doc_id, n, p1, p2, sketch: a row per stored document (rid, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BLANK_WORDS)
        for batch in batches:
            texts = utf8(batch.column(2))
            for first, part in chunks(texts):
                h, counts = sets_of(hasher, part, words)
                own = batch.slice(first, len(part))
                sketch = registers_of(h, counts)
                made = [pa.array(counts, pa.int64()), pa.array(prints(h, counts, 11)), pa.array(prints(h, counts, 12)), pa.array([x.tobytes() for x in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own.columns[:2], *made], names=["rid", "doc_id", "n", "p1", "p2", "sketch"])
        release()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, n long, p1 long, p2 long, sketch binary")


def stored(docs: DataFrame, columns: list[str]) -> DataFrame:
    """rid and the columns, as one struct `row`: written once, so that every reading means the same row by a number.

    Numbers made anew in another plan would mean others: plans read and merge partitions as their columns' sizes suggest."""
    return stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(docs[c] for c in dict.fromkeys(columns))).alias("row")), "near-documents", "zstd")


def texts_of(store: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return store.select("rid", F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].cast("string").alias("text"))


def sketches_agree(bound: float):
    @F.arrow_udf("boolean")
    def agree(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, REGISTERS) for v in (a, b))
        return pa.array(likely(x, y, na.to_numpy(), nb.to_numpy(), bound), pa.bool_())

    return agree


def among(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The rows whose key is in a pair (a, b), and few others, without moving a row: a bit map of the pairs' numbers is broadcast.

    Its size is bounded. With more rows than it has bits, words are shared, and more rows pass that no pair needs."""
    word = lambda n: F.pmod(F.xxhash64(F.shiftright(n, 6)), F.lit(MAP_WORDS).cast("long"))
    bit = lambda n: n.bitwiseAND(63).cast("int")
    of = lambda n: pairs.groupBy(word(F.col(n)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(n)))).alias("bits"))
    bits = of("a").union(of("b")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = (word(F.col(key)) == F.col("word")) & (F.getbit("bits", bit(F.col(key))) == 1)
    return rows.join(F.broadcast(bits), held, "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. a may be in any number of pairs."""
    texts = among(texts, "cls", pairs)
    spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    other = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts").cast("long")).cast("int").alias("salt"), "b")
    centre = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    text = texts.select(F.col("cls").alias("of"), "text")
    rows = other.join(text, F.col("b") == F.col("of")).drop("of").unionByName(centre.join(text, F.col("a") == F.col("of")).drop("of"))
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, mine = Hasher(BLANK_WORDS), None, np.zeros(0, np.uint64)
        for batch in batches:
            found = ([], [])
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            texts = utf8(batch.column(3))
            for first, part in chunks(texts):
                h, counts = sets_of(hasher, part, words)
                for k, own in enumerate(np.split(h, np.cumsum(counts)[:-1]), first):
                    if b[k] is None:
                        held, mine = (a[k], salt[k]), own.copy()
                        continue
                    if held != (a[k], salt[k]):
                        raise RuntimeError("a pair came before its centre")
                    small, large = sorted((mine, own), key=len)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        found[0].append(a[k])
                        found[1].append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
        release()

    return dealt.select("a", "salt", "b", "text").mapInArrow(run, "a long, b long")


def followed(at: DataFrame, by: DataFrame) -> DataFrame:
    """at (v, root) with the roots that by (v, root) has for its roots."""
    up = by.select(F.col("v").alias("x"), F.col("root").alias("higher"))
    return at.join(up, F.col("root") == F.col("x"), "left").select("v", F.coalesce("higher", "root").alias("root"))


def between(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components, with their roots (ra, rb); what at (v, root) lacks is its own root."""
    x, y = (at.select(F.col("v").alias(v), F.col("root").alias(root)) for v, root in (("x", "rx"), ("y", "ry")))
    ends = pairs.join(x, F.col("a") == F.col("x"), "left").join(y, F.col("b") == F.col("y"), "left")
    return ends.select("a", "b", F.coalesce("rx", "a").alias("ra"), F.coalesce("ry", "b").alias("rb")).filter("ra <> rb")


def components(links: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """v, root (the smallest vertex of its component) for all vertices of links (a, b) and of at, the components found before.

    Each turn every vertex takes its smallest neighbour, those are followed to roots, and links are drawn between the roots instead: none is
    left inside a component, and of several between two of them one. So a link is looked up once by each end, not again in every turn."""
    if at is not None:
        links = drawn(links, at)
    while not links.isEmpty():
        near = links.select(F.col("a").alias("v"), F.col("b").alias("root")).union(links.select("b", "a"))
        step = stage(near.groupBy("v").agg(F.least("v", F.min("root")).alias("root")), "near-roots")
        while True:
            inner = step.filter("v <> root")
            if inner.select("root").join(inner.select(F.col("v").alias("x")), F.col("root") == F.col("x"), "left_semi").isEmpty():
                break
            step = stage(followed(step, step), "near-roots")
        at = step if at is None else stage(followed(at, step).union(step.join(at.select("v"), "v", "left_anti")), "near-roots")
        links = drawn(links, step)
    return links.select(F.col("a").alias("v"), F.col("b").alias("root")) if at is None else at


def drawn(links: DataFrame, at: DataFrame) -> DataFrame:
    """Links (a, b) between the roots of different components."""
    return stage(between(links, at).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "near-edges")


def divided(banded: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (band, least, cls, root) and, of bands that hold several components and more than a pair, (band, lo, hi, main, m).

    Both are written: a join with an aggregate that still runs can't be split where a band is hot."""
    own = stage(banded.join(at.withColumnRenamed("v", "cls"), "cls", "left").select("band", "least", "cls", F.coalesce("root", "cls").alias("root")), "near-own")
    main = F.max(F.when(F.col("cls") == F.col("least"), F.col("root")))
    size = own.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), main.alias("main"), F.count(F.lit(1)).alias("m"))
    return own, stage(size.filter("lo < hi AND m > 2").select("band", "main", "m"), "near-divided")


def neighbours(own: DataFrame, size: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different components that stand side by side in a band's random order of this turn: as many as rows at most."""
    salted = own.join(size, "band").withColumn("place", F.xxhash64("cls", F.lit(turn))).withColumn("salt", F.pmod("place", F.ceil(F.col("m") / ORDER_ROWS)))
    line = Window.partitionBy("band", "salt").orderBy("place")
    beside = salted.select("cls", "root", F.lag("cls").over(line).alias("x"), F.lag("root").over(line).alias("other"))
    return beside.filter("root <> other").select(F.least("cls", "x").alias("a"), F.greatest("cls", "x").alias("b")).distinct()


def leftovers(own: DataFrame, size: DataFrame, sketches: DataFrame, bound: float) -> DataFrame:
    """Pairs (a, b) of bands that hold several components, sketches likely alike, a and b in different components."""
    # only where a class is apart from the band's smallest and is not alone with it is anything untested
    rows = stage(own.filter("cls <> least").join(size, "band").select("band", "cls", "root", (F.col("root") != F.col("main")).alias("apart")), "near-rest")
    apart = rows.groupBy("band").agg(F.count(F.lit(1)).alias("all"), F.count_if("apart").alias("few"))
    apart = stage(apart.filter("few > 0 AND all > 1").select("band", F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("few") / BLOCK_ROWS).cast("int").alias("turns")), "near-apart")
    rows = rows.join(apart, "band").join(sketches, "cls").select("band", "cls", "root", "apart", "sketch", "n", "blocks", "turns")
    key = lambda n: F.pmod(F.xxhash64("cls"), n.cast("long")).cast("int")
    line = lambda n: F.sequence(F.lit(0), n - 1)
    all_ = rows.select("band", key(F.col("blocks")).alias("block"), F.explode(line(F.col("turns"))).alias("turn"), F.lit(False).alias("apart"), "cls", "root", "sketch", "n")
    few = rows.filter("apart").select("band", F.explode(line(F.col("blocks"))).alias("block"), key(F.col("turns")).alias("turn"), "apart", "cls", "root", "sketch", "n")
    dealt = all_.union(few).repartition("band", "block", "turn").sortWithinPartitions("band", "block", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            keys = np.stack([now.column(i).to_numpy() for i in range(3)])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            begin = int(cut[-1]) if len(cut) else 0
            if begin:
                yield pairs_of(now.slice(0, begin), cut[:-1])
            rest = now.slice(begin).combine_chunks().to_batches()[0]
        if rest is not None and rest.num_rows:
            yield pairs_of(pa.Table.from_batches([rest]), np.zeros(0, np.int64))
        release()

    def pairs_of(rows: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
        apart, cls, root = (rows.column(i).to_numpy() for i in (3, 4, 5))
        sketch = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(-1, REGISTERS)
        n, band, keys = rows.column(7).to_numpy(), rows.column(0).to_numpy(), keys_of(sketch)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip([0, *cut], [*cut, rows.num_rows], strict=True):
            span = np.arange(lo, hi)
            ys = span[~apart[lo:hi]]
            for x in span[apart[lo:hi]]:
                other = ys[root[ys] != root[x]]
                # a pair leaves from the first band that it shares, and from no other
                other = other[band[x] == keys[x, np.argmax(keys[x] == keys[other], 1)]] if len(other) else other
                other = other[likely(sketch[x], sketch[other], n[x], n[other], bound)] if len(other) else other
                a.append(np.minimum(cls[x], cls[other]))
                b.append(np.maximum(cls[x], cls[other]))
        got = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """rid, doc_id, n, component_id, first (whether the row is the one of its component to keep)."""
    small_batches(docs.sparkSession)
    return components_of(texts_of(stored(docs, [id_col, text_col]), id_col, text_col), words, percent)


def components_of(store: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """near_duplicates of stored documents (rid, doc_id, text)."""
    bound = percent / 100
    rows = stage(sketched(store, words), "near-rows")
    some = rows.filter("n > 0")
    # of a class: its representative, and the row to keep if none of its component has a smaller id
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    rep = F.min(F.struct("rid", "sketch"))
    classes = stage(some.groupBy("p1", "p2", "n").agg(rep.alias("rep"), least.alias("label")).select("p1", "p2", "n", F.col("rep.rid").alias("cls"), "label", F.col("rep.sketch").alias("sketch")), "near-classes")
    keys = band_keys()
    bands = classes.select("cls", keys("sketch").alias("bands")).select("cls", F.explode("bands").alias("band"))
    several = stage(bands.groupBy("band").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", "least"), "near-several")
    banded = stage(bands.join(several, "band"), "near-bands")
    star = stage(banded.filter("cls <> least").groupBy(F.col("least").alias("a"), F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "near-candidates")
    agree = sketches_agree(bound)
    # sketches and texts of the classes that any band shares, once, for all rounds
    sketches = stage(among(classes.select("cls", "sketch", "n"), "cls", star), "near-sketches")
    texts = stage(among(store, "rid", star).select(F.col("rid").alias("cls"), "text"), "near-texts", "zstd")

    def estimated(pairs: DataFrame) -> DataFrame:
        some = among(sketches, "cls", pairs)
        x, y = some.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), some.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        return stage(pairs.join(x, "a").join(y, "b").filter(agree("sa", "sb", "na", "nb")).select("a", "b"), "near-likely")

    def linked(pairs: DataFrame) -> DataFrame:
        return stage(confirm(pairs, texts, words, percent), "near-links")

    # one candidate of each class first: its links are a forest. Of the others only those are tested that may still join components
    first = stage(star.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"), "near-candidates")
    at, tested = components(linked(estimated(first))), star.select("a", "b")
    others = stage(between(star.select("a", "b").join(first, ["a", "b"], "left_anti"), at).select("a", "b"), "near-candidates")
    at = components(linked(estimated(others)), at)
    own, size = divided(banded, at)
    for turn in range(TURNS):
        pairs = stage(neighbours(own, size, turn).join(tested, ["a", "b"], "left_anti"), "near-candidates")
        if pairs.isEmpty():
            break
        tested = tested.union(pairs)
        extra = linked(estimated(pairs))
        if not extra.isEmpty():
            at = components(extra, at)
            own, size = divided(banded, at)
    more = stage(leftovers(own, size, sketches, bound).join(tested, ["a", "b"], "left_anti"), "near-leftovers")
    if not more.isEmpty():
        at = components(linked(more), at)
    roots = stage(classes.select("p1", "p2", "n", "cls", "label").join(at.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "near-classes")
    # of each component its smallest id, and the first row with that id; written, so that a large component's join can be split
    names = stage(roots.groupBy("root").agg(F.min("label").alias("kept")), "near-names")
    known = stage(roots.join(names, "root").select("p1", "p2", "n", F.col("kept.doc_id").alias("component_id"), F.col("kept.rid").alias("best")), "near-known")
    linked = some.drop("sketch").join(known, ["p1", "p2", "n"]).select("rid", "doc_id", "n", "component_id", (F.col("rid") == F.col("best")).alias("first"))
    alone = rows.filter("n = 0").select("rid", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, one of each component."""
    small_batches(docs.sparkSession)
    store = stored(docs, docs.columns)
    gone = components_of(texts_of(store, id_col, text_col), words, percent).filter("NOT first").select(F.col("rid").alias("gone"))
    return store.join(gone, F.col("rid") == F.col("gone"), "left_anti").select("row.*")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + least(4, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM sh p JOIN sh q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.doc_id WHERE reach.r < link.b
), low AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.r, d.doc_id) AS component_id, coalesce(low.r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
