"""Language ID by Bayesian evidence fusion.

The posterior of a language is proportional to four factors: the likelihood of the text (byte trigrams, naive Bayes,
learnt from a bounded sample of rows with a known language), that of the language the markup declares, that of the
address suffix, and a prior from the host. One hypothesis more is that the language is none of the known ones: its text
model is the uniform one. A known language's model is mixed with it (BACKGROUND parts in one), so a trigram never seen
speaks for the unknown by a bounded amount, and other scripts, noise and code are unknown by the sum of their trigrams. Suffix and host factors come from the corpus itself: grouped sums of the text
posteriors, natively, per suffix, per host and per site (the host's last two labels), smoothed down the chain all rows ->
site -> host, so a host with few pages speaks with its site's voice. No evidence is the factor 1.

A row is kept if it holds letters or any declared language, and its best hypothesis is one of the wanted languages with at
least MIN_PROB of the posterior. Where the best hypothesis is the unknown language, lang is null and prob is its posterior.

Defined results: null and empty texts have no text evidence, and without markup they are rejected with language null;
null hosts and urls give no host or suffix evidence; with no labelled row at all every row is rejected; repeated rows are
judged each; an empty table gives an empty result. The result is one struct column named by the caller, so no name clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import ascii_lower, let, release, small_batches, stage, table
from tagmill.llm.wordhash import chunks, utf8

#: About so many texts with a known language teach the text model, in equal parts as far as a language has texts.
TRAIN_ROWS = 8_000
#: Of a language with as many, so many are taken at least, however many languages there are.
LEAST_TEXTS = 20
BITS = 15
MIN_PROB = 0.6
#: Text evidence counts as so many trigrams at most: neighbours in a text aren't independent.
MOST_TRIGRAMS = 120.0
#: Pseudo-counts by which a level of the hierarchy trusts the one above.
TRUST = 20.0
#: How often a declared language is right.
DECLARED_RIGHT = 0.85
#: The uniform model's part in the model of a known language.
BACKGROUND = 0.1
#: Before any evidence a text is of an unknown language so often, at least.
UNKNOWN = 0.01
#: A counting task passes its counts on when it holds so many languages.
MOST_HELD = 64

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams with a letter in the middle, and the text of each; a blank stands before and after a text."""
    data = np.frombuffer(b" " + b"  ".join(texts).translate(LOWER) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 2)
    a, b, c = data[:-2].astype(np.uint32), data[1:-1].astype(np.uint32), data[2:].astype(np.uint32)
    live = b != 0x20
    code = ((a << 16 | b << 8 | c) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return code[live].astype(np.int64), owner[: len(a)][live]


def fair_share(sizes: list[int], most: int) -> float:
    """The share that, where no size counts beyond it, makes the sizes sum to `most`; the largest size if they sum to less."""
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > most:
            return most / (len(sizes) - k)
        most -= n
    return max(sizes, default=0)


def train(rows: DataFrame, lang: Column, text: Column, most_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probabilities of trigrams by language, in the last row those of the unknown language.

    Learnt from about most_rows distinct texts, chosen by hash; every language is modelled."""
    small_batches(rows.sparkSession)
    known = rows.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).filter("lang IS NOT NULL AND text <> ''")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    share = max(LEAST_TEXTS, fair_share(list(sizes.values()), most_rows))
    cuts = {x: int((1 << 40) * share / n) for x, n in sizes.items() if n > share}
    if cuts:
        cut = F.element_at(F.create_map(*(F.lit(v) for pair in cuts.items() for v in pair)), F.col("lang"))
        known = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.coalesce(cut, F.lit(1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for first, part in chunks(texts):
                code, owner = trigrams(part)
                names = langs[first : first + len(part)]
                for name in set(names):
                    mine = np.array([x == name for x in names])
                    held[name] = held.get(name, 0) + np.bincount(code[mine[owner]], minlength=1 << BITS)
                if len(held) > MOST_HELD:
                    yield from map(made, held.items())
                    held = {}
        yield from map(made, held.items())

    def made(item: tuple[str, np.ndarray]) -> pa.RecordBatch:
        name, own = item
        at = np.flatnonzero(own)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "code", "n"])

    # copies of a text teach once; at most 2^BITS counts a language reach the driver
    counts = known.distinct().mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    model = np.zeros((len(langs) + 1, 1 << BITS))
    place = {x: i for i, x in enumerate(langs)}
    model[[place[x] for x in counts.column(0).to_pylist()], counts.column(1).to_numpy()] = counts.column(2).to_numpy()
    model /= np.maximum(model.sum(1, keepdims=True), 1)
    model[:-1] *= 1 - BACKGROUND
    model[:-1] += BACKGROUND / (1 << BITS)
    model[-1] = 1 / (1 << BITS)
    return langs, np.log(model)


def text_evidence(spark, model: tuple[list[str], np.ndarray]):
    """A function of a text column: per hypothesis the log-likelihood (less that of the best one), empty without letters."""
    table_ = np.ascontiguousarray(model[1].T.astype(np.float32))
    held = spark.sparkContext.broadcast(table_)

    @F.arrow_udf("array<double>")
    def evidence(text: pa.Array) -> pa.Array:
        weights, out = held.value, []
        for _, part in chunks(utf8(text)):
            code, owner = trigrams(part)
            n = np.bincount(owner, minlength=len(part))
            sums = np.stack([np.bincount(owner, weights[code, k], len(part)).astype(float) for k in range(weights.shape[1])], 1)
            sums *= np.minimum(1.0, MOST_TRIGRAMS / np.maximum(n, 1))[:, None]
            sums -= sums.max(1, keepdims=True)
            out += [list(map(float, row)) if k else [] for row, k in zip(sums, n, strict=True)]
        release()
        return pa.array(out, pa.list_(pa.float64()))

    return evidence


def softmax(logs: Column) -> Column:
    def scaled(x: Column) -> Column:
        powers = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(p, lambda v: v / s)))

    return let(logs, scaled)


def summed(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Per key the sums of the text posteriors by language, as an array."""
    sums = rows.groupBy(*keys).agg(*(F.sum(F.col("posterior")[k]).alias(f"sum{k}") for k in range(n)))
    return sums.select(*keys, F.array(*(F.col(f"sum{k}") for k in range(n))).alias(name))


def smooth(counts: Column, above: Column) -> Column:
    """(counts + TRUST * above) / (their sum)."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v) + F.lit(TRUST)
    return F.zip_with(counts, above, lambda c, a: (c + a * F.lit(TRUST)) / total)


def site_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text: Column, host: Column, declared: Column | None = None, suffix: Column | None = None, wanted: tuple[str, ...] | None = None, into: str = "language") -> DataFrame:
    """rows plus the struct column `into`: lang, prob, kept. wanted: None for all languages of the model."""
    langs, n = model[0], len(model[0]) + 1  # hypotheses; the last is the unknown language
    schema = "struct<lang:string,prob:double,kept:boolean>"
    if not langs:
        return rows.withColumn(into, F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"), F.lit(False).alias("kept")).cast(schema))
    flat = F.lit([math.log(1 / n)] * n)
    own = rows.select(
        F.struct(*rows.columns).alias("row"),
        text_evidence(rows.sparkSession, model)(text.cast("string")).alias("text_logs"),
        ascii_lower(host.cast("string")).alias("host"),
        (F.lower(F.substring_index(F.regexp_replace(declared.cast("string"), "_", "-"), "-", 1)) if declared is not None else F.lit(None).cast("string")).alias("declared"),
        (ascii_lower(suffix.cast("string")) if suffix is not None else F.lit(None).cast("string")).alias("suffix"),
    )
    spoken = F.size("text_logs") > 0
    post = own.filter(spoken).select("host", site_of(F.col("host")).alias("site"), "suffix", softmax(F.col("text_logs")).alias("posterior"))
    # hosts and suffixes are summed once together; the levels above are sums of those sums
    base = post.filter("host IS NOT NULL OR suffix IS NOT NULL").groupBy("host", "site", "suffix").agg(*(F.sum(F.col("posterior")[k]).alias(f"s{k}") for k in range(n)))
    base = stage(base.select("host", "site", "suffix", F.array(*(F.col(f"s{k}") for k in range(n))).alias("posterior")), "language-counts")
    totals = base.agg(*(F.sum(F.col("posterior")[k]) for k in range(n))).first()
    whole = [float(x or 0.0) for x in totals]
    shares = [(x + 1.0) / (sum(whole) + n) for x in whole]
    shares[-1] = max(shares[-1], UNKNOWN)
    over = F.lit([x / sum(shares) for x in shares])
    hosts = summed(base.filter("host IS NOT NULL"), ["host", "site"], n, "of_host").join(summed(base.filter("site IS NOT NULL"), ["site"], n, "of_site"), "site")
    hosts = hosts.select(F.col("host").alias("h"), smooth(F.col("of_host"), smooth(F.col("of_site"), over)).alias("prior"))
    logs = own.join(hosts, own.host == F.col("h"), "left")
    if suffix is not None:
        suffixes = summed(base.filter("suffix IS NOT NULL"), ["suffix"], n, "of_suffix")
        # P(suffix | language), up to a factor that is the same for all languages
        logs = logs.join(suffixes.select(F.col("suffix").alias("s"), F.zip_with(smooth(F.col("of_suffix"), over), over, lambda p, q: F.log(p / q)).alias("suffix_logs")), F.col("suffix") == F.col("s"), "left")
    else:
        logs = logs.withColumn("suffix_logs", F.lit(None).cast("array<double>"))
    names, places = F.lit(langs), F.sequence(F.lit(1), F.lit(n))
    other = math.log((1 - DECLARED_RIGHT) / (n - 1))
    # a declared language that isn't known speaks for the unknown one
    said = F.coalesce(F.nullif(F.array_position(names, F.col("declared")), F.lit(0)), F.lit(n))
    markup = F.when(F.col("declared").isNotNull() & (F.col("declared") != ""), F.transform(places, lambda k: F.when(k == said, F.lit(math.log(DECLARED_RIGHT))).otherwise(F.lit(other))))
    parts = [F.when(spoken, F.col("text_logs")), F.transform("prior", lambda p: F.log(p)), F.col("suffix_logs"), markup]
    total = F.coalesce(parts[0], flat)
    for part in parts[1:]:
        total = F.zip_with(total, F.coalesce(part, flat), lambda a, b: a + b)
    heard = spoken | markup.isNotNull()
    judged = logs.select("row", heard.alias("heard"), softmax(total).alias("p"))
    best = F.array_max("p")
    spot = F.array_position("p", best).cast("int")
    lang = F.when(F.col("heard") & (spot < n), F.element_at(names, F.least(spot, F.lit(n - 1))))
    prob = F.when(F.col("heard"), best)
    right = lang.isNotNull() if wanted is None else lang.isin(list(wanted))
    return judged.select("row.*", F.struct(lang.alias("lang"), prob.alias("prob"), F.coalesce(F.col("heard") & (best >= MIN_PROB) & right, F.lit(False)).alias("kept")).alias(into))


def page_text(html: Column) -> Column:
    """The page's own words: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def declared_lang(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    return F.when(found != "", found)


def url_host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#:]*)", 1)
    return F.when(found != "", found)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Documents and pages in one corpus: a row each, with doc_id or page_id. A document's source serves as its host."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = train(docs, F.col("lang"), F.col("text"))
    none = F.lit(None)
    rows = docs.select("doc_id", none.cast("long").alias("page_id"), "text", F.col("source").alias("host"), none.cast("string").alias("declared"), none.cast("string").alias("suffix"))
    host = url_host(F.col("url"))
    rows = rows.unionByName(pages.select(none.cast("long").alias("doc_id"), "page_id", page_text(F.col("html")).alias("text"), host.alias("host"), declared_lang(F.col("html")).alias("declared"), suffix_of(host).alias("suffix")))
    found = identify(rows, model, F.col("text"), F.col("host"), F.col("declared"), F.col("suffix"))
    return found.select("doc_id", "page_id", F.col("declared"), F.col("language.lang").alias("lang"), F.col("language.prob").alias("prob"), F.col("language.kept").alias("kept"))
