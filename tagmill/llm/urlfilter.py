"""URL filters: exact rule look-up without joins, by Bloom filter cascades over the corpus's own keys.

A rule is (verdict, host, path). It fits its host and all subdomains where the url's path starts with the rule's; the
longest that fits wins (then that with the longer host). A url's keys are the last 1..L labels of its host, L being the
most labels of any rule, times the prefixes of its path in the lengths that rule paths have; the keys of all urls are the
universe. For each verdict one cascade holds the listed keys: level 1 encodes the listed keys, level 2 the universe's
keys that level 1 wrongly admits, level 3 the listed keys that level 2 wrongly admits, and so on until a level is empty.
A key is listed if the first level that lacks it has an even number, or if it passes all of an odd number of levels.
On the universe this is exact.

Level 1 is sized so that about as many wrong keys pass as there are listed ones (its rate is |listed| / |universe|);
their number is checked and the level is enlarged until it holds, so filters and driver memory are bounded by the rule
list, not by the corpus.

Defined results: host and path of a null url, or one without ://, are empty; an empty host fits no rule; repeated rows
are judged each; no rules, or no urls, give the default verdict for all; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import Shared, ascii_lower, table

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MAX_LEVELS = 64


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64's last steps on h + salt."""
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Bloom:
    def __init__(self, keys: np.ndarray, rate: float, level: int):
        self.level, self.k = level, max(1, math.ceil(-math.log2(rate)))
        self.m = max(64, math.ceil(len(keys) * self.k / math.log(2)))
        self.bits = np.zeros(self.m // 8 + 1, np.uint8)
        for at in self.places(keys):
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def places(self, keys: np.ndarray):
        a, b = mixed(keys, 2 * self.level + 1), mixed(keys, 2 * self.level + 2) | np.uint64(1)
        for j in range(self.k):
            yield ((a + np.uint64(j) * b) % np.uint64(self.m)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for level in self.levels:
            passed = level.has(keys[open_])
            # who fails an even level was admitted by the odd one before it, and rightly
            out[open_[~passed]] = level.level % 2 == 0
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def cascade(first: Bloom, listed: np.ndarray, wrong: np.ndarray) -> Cascade:
    """wrong: hashes of the unlisted keys of the universe that first admits."""
    levels, inside, outside = [first], wrong, listed
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise ValueError("a listed and an unlisted key share their hash")
        levels.append(Bloom(inside, 0.5, len(levels) + 1))
        inside, outside = outside[levels[-1].has(outside)], inside
    return Cascade(levels)


def parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def keys_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Array of the keys of a url, that of the longest possible rule first."""
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    shapes = [(k, n) for k in range(labels, 0, -1) for n in sorted({len(p) for *_, p in rules}, reverse=True)]
    held = F.size(F.split(host, r"\."))
    made = [F.when((host != "") & (held >= k) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n))) for k, n in shapes]
    keys = F.filter(F.array(*made), lambda x: x.isNotNull()) if made else F.array().cast("array<string>")
    # stable in shapes, so of two equally long keys that with the longer host comes first
    ranked = F.transform(keys, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("key")))
    return F.transform(F.array_sort(ranked), lambda x: x.key)


def hashes(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.xxhash64(k))


def tester(tests):
    """For an array of hashes, the number (from 1) of the first of tests' members that holds it, else 0."""

    @F.arrow_udf("array<int>")
    def test(h: pa.Array) -> pa.Array:
        flat = h.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        code = np.zeros(len(flat), np.int32)
        for k, member in enumerate(tests.value, 1):
            code[member.has(flat) & (code == 0)] = k
        lengths = h.value_lengths().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(code, pa.int32()))

    return test


def build(urls: DataFrame, rules: list[tuple[str, str, str]], verdicts: list[str]) -> list[Cascade]:
    """A cascade for each verdict, over the keys of urls (host, path)."""
    spark = urls.sparkSession
    listed = {v: sorted({h + p for w, h, p in rules if w == v}) for v in verdicts}
    every = sorted({k for keys in listed.values() for k in keys})
    at = dict(spark.createDataFrame([(k,) for k in every], "key string").select("key", F.xxhash64("key")).collect()) if every else {}
    hashed = {v: np.array([at[k] for k in keys], np.int64).view(np.uint64) for v, keys in listed.items()}
    keys = urls.select(keys_of(urls.host, urls.path, rules).alias("keys")).withColumn("hashes", hashes(F.col("keys")))
    size = max(1, keys.select(F.explode("hashes").alias("h")).agg(F.approx_count_distinct("h")).first()[0])
    rates = {v: min(0.5, max(1, len(keys)) / size) for v, keys in listed.items()}
    limit = 1000 + 8 * len(every)
    for _ in range(8):
        firsts = [Bloom(hashed[v], rates[v], 1) for v in verdicts]
        test = tester(Shared(spark, [Either(firsts)]))
        admitted = keys.select("keys", "hashes", test("hashes").alias("code")).select(F.explode(F.arrays_zip("keys", "hashes", "code")).alias("x")).filter("x.code > 0").select("x.keys", "x.hashes").distinct()
        found = admitted.limit(limit + 1).collect()
        if len(found) <= limit:
            break
        rates = {v: r / 4 for v, r in rates.items()}
    else:
        raise ValueError("level 1 of a filter cascade admits too many keys")
    out = []
    for v, first in zip(verdicts, firsts, strict=True):
        own = set(listed[v])
        others = np.array([h for k, h in found if k not in own], np.int64).view(np.uint64)
        out.append(cascade(first, hashed[v], others[first.has(others)]))
    return out


@dataclass
class Either:
    members: list

    def has(self, keys: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([m.has(keys) for m in self.members])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The columns in keep, host, path, rule (host and path of the rule that won, or null) and verdict.

    Of two rules for one host and path, the later holds."""
    rules = [(v, h, p) for (h, p), v in {(h, p): v for v, h, p in rules}.items()]
    host, path = parts(pages[url_col])
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    verdicts = sorted({v for v, *_ in rules})
    test = tester(Shared(pages.sparkSession, build(rows, rules, verdicts)))
    keyed = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), rules)).withColumn("code", test(hashes(F.col("keys"))))
    won = keyed.withColumn("won", F.filter(F.arrays_zip("keys", "code"), lambda x: x.code > 0))
    hit = F.size("won") > 0
    verdict = F.element_at(F.array(*map(F.lit, verdicts)), F.element_at("won", 1)["code"])
    return won.select(*keep, "host", "path", F.when(hit, F.element_at("won", 1)["keys"]).alias("rule"), F.when(hit, verdict).otherwise(F.lit(default)).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS row FROM pages
)
SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path,
  arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule,
  coalesce(arg_max(r.verdict, (length(r.host || r.path), length(r.host))), 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.row, p.page_id
"""
