"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: every run of `window` consecutive words, or all words of a shorter
item. Patterns of one length m share tables over blocks of B = min(3, m) words: the shift table says how far the
search may jump when a block ends at a position (m - B + 1 where no pattern holds the block, 0 where one ends with
it), buckets keyed by the last block and the first one select patterns, and direct comparison of all m words, as text,
confirms an occurrence. In clean text the search looks at about one word in eight. Words are 64-bit hashes in numpy arrays,
and the positions of many texts, in segments of SEGMENT words, jump at once.

The benchmark is the query set: it reaches the executors in blocks whose tables take about `table_bytes`, however large it
is. One block is the usual case: a single pass over the documents, which are never shuffled. With more, the documents are
written once with a number for each row, each further block is a pass of its own that holds its own tables only and keeps
the documents that it hits, and these hits are joined at the end. A single item of more words makes a larger block.

Defined results: words are lower-cased A-Z, runs of digits, a-z and non-ASCII characters; null and empty texts have no
words, are hit nowhere and match nothing; repeated document rows each get their row; items with one id count as one,
items with a null id contribute hits but aren't listed; no benchmark, no hits. Input columns other than id and text are
ignored by find_overlaps and kept, whatever their names, by decontaminate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tagmill.llm.common import Shared, ascii_lower, release, small_batches, stage, table
from tagmill.llm.wordhash import PLAIN_WORDS, Hasher, chunks, splitmix, utf8

WINDOW = 10
#: What the tables of a block of the benchmark take, about.
TABLE_BYTES = 64 << 20
#: A word of the benchmark takes so many bytes in the tables, at most about.
WORD_BYTES = 64
#: Words of a text that one cursor searches.
SEGMENT = 64
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    # 0x20 is the only blank that PLAIN_WORDS leaves, so split() splits on nothing else
    return text.encode("utf-8", "replace").translate(PLAIN_WORDS).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    m = min(window, len(words))
    for i in range(len(words) - m + 1 if m else 0):
        yield tuple(words[i : i + m])


def block_hash(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the blocks of `size` words that start at the positions."""
    out = np.full(len(first), np.uint64(size))
    with np.errstate(over="ignore"):
        for k in range(size):
            out = splitmix(out * MULTIPLY + words[first + k])
    return out


@dataclass
class Words:
    """Words of texts: their hashes, and where in the bytes of all texts they stand."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # by text

    @classmethod
    def of(cls, hasher: Hasher, texts: list[bytes]) -> Words:
        hashes, counts = hasher.words(texts)
        data, starts, ends = hasher.last
        return cls(data, hashes, starts, ends, counts)

    @classmethod
    def of_all(cls, texts: list[bytes]) -> Words:
        parts = [cls.of(Hasher(PLAIN_WORDS), part) for _, part in chunks(texts)] or [cls.of(Hasher(PLAIN_WORDS), [])]
        before = np.cumsum([0, *(len(p.data) for p in parts)])
        moved = lambda name: np.concatenate([getattr(p, name) + at for p, at in zip(parts, before, strict=False)])
        joined = lambda name: np.concatenate([getattr(p, name) for p in parts])
        return cls(joined("data"), joined("hashes"), moved("starts"), moved("ends"), joined("counts"))

    def text(self, first: int, n: int) -> list[bytes]:
        return self.data[self.starts[first] : self.ends[first + n - 1]].tobytes().split()


class WuManber:
    """The tables for patterns of one length m: windows that start at some words of the benchmark."""

    def __init__(self, m: int, words: Words, starts: np.ndarray, items: np.ndarray):
        """items: of each start the number of its item."""
        self.m, self.block, self.words = m, (b := min(3, m)), words
        self.most = m - b + 1
        bits = max(10, int(4 * len(starts)).bit_length())
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.most, np.int32 if self.most > 255 else np.uint8)
        for end in range(b, m + 1):  # towards the end the jumps get smaller, and the smallest stays
            self.shift[block_hash(words.hashes, starts + (end - b), b) >> self.drop] = m - end
        last, first = block_hash(words.hashes, starts + (m - b), b), block_hash(words.hashes, starts, b)
        with np.errstate(over="ignore"):
            key = splitmix(last * MULTIPLY + first)
        # equal windows become one pattern with several items
        order = np.lexsort((block_hash(words.hashes, starts, m), key))
        whole = block_hash(words.hashes, starts[order], m)
        new = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]) | (key[order][1:] != key[order][:-1])]))
        self.key, self.start = key[order][new], starts[order][new].astype(np.int32 if len(words.hashes) < 1 << 31 else np.int64)
        self.ends, self.items = np.append(new, len(order)).astype(np.int32), items[order].astype(np.int32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.shift, self.key, self.start, self.ends, self.items))

    def search(self, text: Words) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the first word among those of all texts, items) of each occurrence."""
        m, b, begins = self.m, self.block, np.concatenate([[0], np.cumsum(text.counts)[:-1]])
        spans = text.counts - m + 1
        live = np.flatnonzero(spans > 0)
        # cursors stand where a window may end; each searches SEGMENT places of one text
        pieces = -(-spans[live] // SEGMENT)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(begins[live] + m, pieces) + nth * SEGMENT
        stop = np.minimum(at + SEGMENT, np.repeat(begins[live] + text.counts[live] + 1, pieces))
        found = []
        while len(at):
            jump = self.shift[block_hash(text.hashes, at - b, b) >> self.drop].astype(np.int64)
            hit = jump == 0
            found.append(at[hit])
            at = at + jump + hit
            on = at < stop
            at, stop = at[on], stop[on]
        if not found or not len(ends := np.sort(np.concatenate(found))):
            return
        with np.errstate(over="ignore"):
            key = splitmix(block_hash(text.hashes, ends - b, b) * MULTIPLY + block_hash(text.hashes, ends - m, b))
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        for k in np.flatnonzero(hi > lo):
            own = text.text(first := int(ends[k]) - m, m)
            for p in range(lo[k], hi[k]):
                if own == self.words.text(int(self.start[p]), m):
                    yield first, self.items[self.ends[p] : self.ends[p + 1]]


class Tables:
    """A block of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = [i for i, _ in items]
        self.words = words = Words.of_all([(t or "").encode("utf-8", "replace") for _, t in items])
        begins = np.concatenate([[0], np.cumsum(words.counts)[:-1]]) if len(items) else np.zeros(0, np.int64)
        lengths = np.minimum(words.counts, window)
        self.kinds = []
        for m in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == m)
            n = words.counts[own] - m + 1
            starts = np.repeat(begins[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.kinds.append(WuManber(int(m), words, starts, np.repeat(own, n)))

    def nbytes(self) -> int:
        return sum(k.nbytes() for k in self.kinds) + sum(x.nbytes for x in (self.words.data, self.words.hashes, self.words.starts, self.words.ends))

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[int], list[str]]]:
        """Of each text the number of words, merged spans [from, to, ..] and the sorted items."""
        hasher = Hasher(PLAIN_WORDS)
        for _, part in chunks(texts):
            text = Words.of(hasher, part)
            begins = np.concatenate([[0], np.cumsum(text.counts)[:-1]])
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[int]] = {}
            for kind in self.kinds:
                for at, known in kind.search(text):
                    own = int(np.searchsorted(begins, at, "right")) - 1
                    spans.setdefault(own, []).append((at - int(begins[own]), at - int(begins[own]) + kind.m))
                    items.setdefault(own, set()).update(known.tolist())
            for k, n in enumerate(text.counts.tolist()):
                names = {self.names[i] for i in items.get(k, ())} - {None}
                yield n, [x for span in merged(spans.get(k, [])) for x in span], sorted(names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(ascii_lower(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0))


def blocks_of(benchmark: DataFrame, item_col: str, item_text: str, window: int, table_bytes: int) -> Iterator[Tables]:
    """The benchmark's tables, one block after the other."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text].cast("string").alias("text"))
    words = items.agg(F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0))).first()[0]
    n = max(1, math.ceil(words * WORD_BYTES / table_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        got = [(r["item"], r["text"]) for r in part.collect()]
        if got or n == 1:
            yield Tables(got, window)


OVERLAP = StructType().add("n_words", LongType()).add("spans", ArrayType(LongType())).add("items", ArrayType(StringType()))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, row (the columns in keep, as one struct) and overlap: n_words, spans (merged [from, to) in words), items (sorted ids as strings)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row") if keep else F.lit(None).cast("int").alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    blocks = blocks_of(benchmark, item_col, item_text, window, table_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return searched(rows, Shared(spark, first), ["row", "id"])
    store = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "leaks-documents", "zstd")
    hits = []
    while second is not None:
        tables = Shared(spark, second)
        hits.append(stage(searched(store, tables, ["rid"], hits_only=True), "leaks-hits"))
        tables.held.destroy()
        second = next(blocks, None)
    more = hits[0]
    for x in hits[1:]:
        more = more.union(x)
    # a row for each block that hits the document, at most
    more = more.groupBy("rid").agg(F.collect_list("overlap.spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("overlap.items")))).alias("items"))
    both = searched(store, Shared(spark, first), ["rid", "row", "id"]).join(more, "rid", "left")
    none = F.lit([]).cast("array<string>")
    whole = F.struct(
        F.col("overlap.n_words").alias("n_words"),
        F.when(F.col("spans").isNull(), F.col("overlap.spans")).otherwise(joined_spans()(F.concat(F.array("overlap.spans"), F.coalesce("spans", F.array(F.col("overlap.spans")))))).alias("spans"),
        F.array_sort(F.array_union(F.col("overlap.items"), F.coalesce("items", none))).alias("items"),
    )
    return both.select("row", "id", whole.cast(OVERLAP).alias("overlap"))


def joined_spans():
    @F.arrow_udf("array<bigint>")
    def join(values: pa.Array) -> pa.Array:
        return pa.array([[x for span in merged([p for s in lists for p in zip(s[::2], s[1::2], strict=True)]) for x in span] for lists in values.to_pylist()], pa.list_(pa.int64()))

    return join


def searched(rows: DataFrame, tables: Shared, keep: list[str], hits_only: bool = False) -> DataFrame:
    """The columns in keep, and overlap of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = ([*x] for x in zip(*tables.value.search(utf8(batch.column(batch.num_columns - 1))), strict=True)) if batch.num_rows else ([], [], [])
            made = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"])
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*keep, "overlap"])
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out
        release()

    schema = StructType([rows.schema[c] for c in keep]).add("overlap", OVERLAP)
    return rows.select(*keep, "text").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, all columns, that share no window with the benchmark."""
    found = find_overlaps(docs, benchmark, id_col=text_col, text_col=text_col, window=window, keep=tuple(docs.columns)).drop("id")
    return found.filter(F.size("overlap.spans") == 0).select("row.*")


def hit_words():
    """n_hit of spans, natively."""
    ends = F.transform("overlap.spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("overlap.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        (F.size("overlap.spans") > 0).alias("contaminated"),
    )


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """What op3 returns, by looking everywhere; for tests."""
    out = {}
    patterns = [(str(i), p) for i, t in items for p in set(windows_of(words_of(t), window))]
    for doc, text in docs:
        words = words_of(text)
        hit = np.zeros(len(words), bool)
        ids = set()
        for item, p in patterns:
            for at in range(len(words) - len(p) + 1):
                if tuple(words[at : at + len(p)]) == p:
                    hit[at : at + len(p)] = True
                    ids.add(item)
        out[doc] = (len(words), int(hit.sum()), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit.any()))
    return out


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lengths AS (SELECT DISTINCT least(10, len(w)) AS m FROM i WHERE len(w) > 0),
pattern AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lengths WHERE len(w) >= m)
), found AS (SELECT doc_id, spot.m, s, item_id FROM spot JOIN pattern USING (m, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS k FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids.list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
