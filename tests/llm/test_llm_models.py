import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import langid, lm, toxicity
from tagmill.llm.wordhash import BLANK_WORDS, Hasher, grams, powers


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ---- word hashes


def test_words_of_a_chunk_hash_as_alone():
    texts = ["Aé b  c", "", "\t\n", "b", "x" * 1000 + " b"]
    h, n = Hasher(BLANK_WORDS).words([t.encode() for t in texts])
    assert n.tolist() == [3, 0, 0, 1, 2]
    alone = [int(Hasher(BLANK_WORDS).words([w.encode()])[0][0]) for t in texts for w in t.split()]
    assert h.tolist() == alone and h[1] == h[3] == h[5]
    assert powers(3, 5).tolist() == [1, 3, 9, 27, 81]
    g, owner = grams(h, n, 2)
    assert owner.tolist() == [0, 0, 4]


# ---- language model


def brute_base(rows):
    words = {i: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"] for i, t in rows}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    return lm.op2_lm_score(spark, sf_dir).toPandas().set_index("doc_id")


def test_counts_and_base_match_brute_force(spark, sf_dir, scored):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, expected = brute_base(rows)
    assert len(scored) == len(rows) and set(scored.train_tokens) == {n}
    for i, (tokens, known, base) in expected.items():
        r = scored.loc[i]
        assert (r.n_tokens, r.n_known, r.held_out) == (tokens, known, zlib.crc32(str(i).encode()) % 7 == 2)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))


def test_model_beats_unigrams_on_held_out_texts(scored):
    held = scored[scored.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.9


def test_tail_words_join_the_same_counts(spark, sf_dir, scored, monkeypatch):
    # with a short head most words come through the join
    v = lm.vocabulary.__defaults__
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (*v[:3], 2_500, v[4]))
    again = lm.op2_lm_score(spark, sf_dir).toPandas().set_index("doc_id").loc[scored.index]
    assert (again.n_known == scored.n_known).all() and np.allclose(again.base_score, scored.base_score) and np.allclose(again.score, scored.score, rtol=1e-4)


def taught(spark, rows, **more):
    """A vocabulary and the rows of a model of the texts."""
    df = docs(spark, rows)
    v = lm.vocabulary(lm.counted(df.select("text")), **more).prepare()
    return v, lm.train(df, v, spark.sparkContext.broadcast(v))


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b d e " + " ".join(f"w{k}" for k in range(i % 9))) for i in range(40)]
    v, model = taught(spark, rows, min_count=20, tail=4, word_classes=3)
    assert (v.words, v.n_word_classes) == (len([n for n in v.counts if n >= 20]), 3) and v.size.max() > 1
    every, scorer = np.arange(v.symbols), lm.Scorer(v, model)
    for context in (0, 5, v.symbols * (v.symbols + 1) + v.symbols):
        p = np.exp(scorer.log_probabilities(np.full(v.symbols, context), every))
        assert abs(p.sum() - 1) < 1e-5
    # inside a tail class: all seen words and one place for unseen ones
    rank = {w: i for i, w in enumerate(v.head)}
    for c, (n, k) in v.by_tail.items():
        inside = [w for w in v.head[v.words :] if lm.class_of(w, 4) == c]
        total = sum((v.counts[rank[w]] + 1) / 10 ** v.log_tail[c] for w in inside) + 1 / 10 ** v.log_tail[c]
        assert len(inside) == k and abs(total - 1) < 1e-9, (c, n)


def test_scores_match_a_plain_computation(spark, sf_dir, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()]
    kept = {}
    scorer = lm.Scorer
    monkeypatch.setattr(lm, "Scorer", lambda v, m: kept.setdefault("scorer", scorer(v, m)))
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs(spark, rows)).collect()}
    v, m = kept["scorer"].v, kept["scorer"].m
    rank = {w: i for i, w in enumerate(v.head)}
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*lm.tokens_of((t or "").encode()), b"\n"])
    assert v.words == sum(n >= lm.MIN_COUNT for n in counts.values()) > 20 and v.total == counts.total()
    size = Counter(lm.class_of(w) for w in counts if w not in v.head[: v.words])
    tokens = Counter()
    for w, n in counts.items():
        if w not in v.head[: v.words]:
            tokens[lm.class_of(w)] += n

    def log_softmax(x, k):
        return x[k] - max(x) - math.log(sum(math.exp(y - max(x)) for y in x))

    for i, t in rows[:25]:
        near = far = v.symbols
        total = 0.0
        for w in [*lm.tokens_of((t or "").encode())[:400], b"\n"] if len((t or "").split()) <= 400 else []:
            place = rank.get(w, -1)
            symbol = place if 0 <= place < v.words else v.words + lm.class_of(w)
            h = m.r[near].astype(float) @ m.c1 + m.r[far].astype(float) @ m.c2
            cls = next((c for c in range(v.n_word_classes) if v.first[c] <= symbol < v.first[c + 1]), v.n_word_classes + symbol - v.words)
            total += log_softmax([float(np.dot(h, q) + b) for q, b in zip(m.q, m.qb, strict=True)], cls)
            if symbol < v.words:
                span = slice(v.first[cls], v.first[cls + 1])
                total += log_softmax([float(np.dot(h, q) + b) for q, b in zip(m.p[span], m.pb[span], strict=True)], symbol - v.first[cls])
            else:
                c = lm.class_of(w)
                total += math.log((counts[w] + 1) / (tokens[c] + size[c] + 1))
            near, far = symbol, near
        if total:
            assert abs(got[i] - total / math.log(10)) < 1e-3 * max(1, abs(got[i])), i


def test_training_climbs_the_contrast_of_observed_and_drawn(spark):
    rows = [(i, "a b c a b d e " + " ".join(f"w{k}" for k in range(i % 9))) for i in range(40)]
    v = lm.vocabulary(lm.counted(docs(spark, rows).select("text")), min_count=20, tail=4, word_classes=3).prepare()
    start = lm.Model.start(v)
    learner = lm.Learner(v, lm.Model(v, start.rows.astype(np.float64), start.biases.astype(np.float64)), 1)
    rng = np.random.default_rng(2)
    near, far, symbol = rng.integers(0, v.symbols + 1, 50), rng.integers(0, v.symbols + 1, 50), rng.integers(0, v.symbols, 50)
    classes, some, words = learner.noise(symbol)
    assert len(some) > 5 and all(v.class_of[w] == v.class_of[symbol[t]] for t, drawn in zip(some, words.T, strict=True) for w in drawn)

    def objective():
        m, total = learner.m, 0.0
        for t, (a, b, x) in enumerate(zip(near, far, symbol, strict=True)):
            h = m.r[a] @ m.c1 + m.r[b] @ m.c2
            odds = lambda k: h @ m.q[k] + m.qb[k] - learner.shift[k]  # noqa: E731, B023
            of_word = lambda w: h @ m.p[w] + m.pb[w] - learner.word_shift[w]  # noqa: E731, B023
            total -= math.log1p(math.exp(-odds(v.class_of[x])))
            total -= sum(math.log1p(math.exp(odds(k))) for k in classes) * lm.NOISE / lm.DRAWS
            if t in some:
                total -= math.log1p(math.exp(-of_word(x)))
                total -= sum(math.log1p(math.exp(of_word(w))) for w in words[:, list(some).index(t)])
        return total

    def slope(values, *at):
        old = values[at]
        values[at] = old + 1e-4
        up = objective()
        values[at] = old - 1e-4
        down = objective()
        values[at] = old
        return (up - down) / 2e-4

    for name, (at, _, d, bias) in learner.gradients(near, far, symbol, classes, some, words).items():
        for k in rng.integers(0, len(at), 6):
            j = int(rng.integers(0, lm.DIM))
            assert abs(slope(getattr(learner.m, name), at[k], j) - d[k, j]) < 1e-3 * max(1, abs(d[k, j])), (name, at[k], j)
            assert bias is None or abs(slope(getattr(learner.m, name + "b"), at[k]) - bias[k]) < 1e-3 * max(1, abs(bias[k])), (name, at[k])


def test_many_partitions_teach_as_much_as_one(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")

    def gain(parts):
        held = lm.score_texts(df.repartition(parts)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        return held[0] - held[1]

    one, many = gain(1), gain(64)
    assert one > 0 and abs(many - one) < 0.1 * one


def test_averages_of_many_tasks_still_learn(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").repartition(16)
    monkeypatch.setattr(lm.train, "__defaults__", (lm.ROUNDS, 30_000))  # a dozen tasks on a share each
    held = lm.score_texts(df).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.98  # scores are negative: at least 2 % better


def test_order_matters_to_the_model(spark):
    rows = [(i, "alpha beta gamma delta " * 30) for i in range(60)] + [(1000, "alpha beta gamma delta " * 10), (1001, "delta gamma beta alpha " * 10)]
    got = lm.score_texts(docs(spark, rows)).toPandas().set_index("doc_id")
    assert got.score[1000] > got.score[1001] and abs(got.base_score[1000] - got.base_score[1001]) < 1e-9


def test_lm_nulls_empty_repeats_and_no_training(spark):
    rows = [(None, "a"), (1, None), (1, ""), (2, "b b"), (2, "b b")]
    got = lm.score_texts(docs(spark, rows)).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 3]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    untaught = lm.score_texts(docs(spark, [(1, "a b")]), held_out=F.lit(True)).first()
    assert (untaught["train_tokens"], untaught["n_known"]) == (0, 0) and math.isfinite(untaught["score"])
    assert lm.score_texts(docs(spark, [])).count() == 0
    more = docs(spark, [(1, "a b", "x", 3)], "doc_id long, text string, word string, rid int")
    assert lm.score_texts(more).first()["n_tokens"] == 3


# ---- toxicity


def test_toxicity_on_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    got = toxicity.op6_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.values, got[got.toxic == 0].score.values
    assert (pos[:, None] > neg[None, :]).mean() > 0.97
    assert (pos >= 0.3).mean() > 0.85 and (neg >= 0.3).mean() < 0.01


def test_toxicity_reads_text_only_and_learns_outside_the_fold(spark):
    rows = [(i, f"word{i % 7} text {'vile' if i % 3 == 0 else 'mild'} end") for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    a = toxicity.score_documents(docs(spark, rows), docs(spark, labels, "doc_id long, toxic int")).toPandas().set_index("doc_id").score
    assert a[0] > 0.5 > a[1]
    # labels of the held-out fold may say anything
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    b = toxicity.score_documents(docs(spark, rows), docs(spark, wrong, "doc_id long, toxic int")).toPandas().set_index("doc_id").score
    assert (a == b.loc[a.index]).all()
    # ids decide order only
    assert a[0] == a[21]


def features_of(texts):
    return list(toxicity.distinct_features(Hasher(toxicity.PLAIN_WORDS), texts))


def test_rare_toxic_words_have_weights_and_the_cutoff_changes_nothing():
    # toxic texts differ by words alone that stand in three or four of them; a word of each other text stands in it alone
    rng = np.random.default_rng(1)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 12)))
    rows = [(f"the same words {w}".encode(), 1.0) for k in (3, 4) for w in [word() for _ in range(20)] for _ in range(k)]
    rows += [(f"the same words {word()}".encode(), 0.0) for _ in range(900)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    texts, labels = map(list, zip(*rows, strict=True))
    every = features_of(texts)
    held = np.bincount(np.concatenate(every), minlength=1 << toxicity.BITS)
    at, w = toxicity.fit(zip([x[held[x] >= toxicity.MIN_TEXTS] for x in every], labels, strict=True))
    got, y = toxicity.scores((at, w), texts), np.array(labels)
    assert (got[y == 1] >= 0.3).all() and (got[y == 0] < 0.3).all()
    whole, weight = toxicity.fit(zip(every, labels, strict=True))
    assert at.tolist() == whole.tolist() and np.allclose(w, weight)


def brute_ftrl(texts, labels):
    """Weights by feature, with dictionaries, a text at a time."""
    t = toxicity
    rows = [{*map(int, x), 1 << t.BITS} for x in features_of(texts)]
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == 1 << t.BITS else t.L1
        return 0.0 if abs(z[i]) <= l1 else -math.copysign(abs(z[i]) - l1, z[i]) / ((t.BETA + math.sqrt(n[i])) / t.ALPHA + t.L2)

    for _ in range(t.EPOCHS):
        for lo in range(0, len(rows), t.BATCH):
            part = list(zip(rows[lo : lo + t.BATCH], labels[lo : lo + t.BATCH], strict=True))
            w = {i: weight(i) for x, _ in part for i in x}
            pull, squares = Counter(), Counter()
            for x, y in part:
                g = 1 / (1 + math.exp(-sum(w[i] for i in x))) - y
                for i in x:
                    pull[i] += g
                    squares[i] += g * g
            for i in w:
                z[i] += pull[i] - (math.sqrt(n[i] + squares[i]) - math.sqrt(n[i])) / t.ALPHA * w[i]
                n[i] += squares[i]
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["vile" if i % 4 == 0 and rng.random() < 0.9 else "mild", *(f"w{k}" for k in rng.integers(0, 30, 12))])) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    df, known = docs(spark, rows), docs(spark, labels, "doc_id long, toxic int")
    at, w = toxicity.train(df, known)
    order = [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id", F.lit(1))).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    expected = brute_ftrl([rows[i][1].encode() for i in order], [float(labels[i][1]) for i in order])
    assert {int(i): round(x, 9) for i, x in zip(at, w, strict=True)} == {i: round(x, 9) for i, x in expected.items()}
    # and scores are the logistic of the sums
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, known).collect()}
    for (i, _), x in zip(rows[:50], features_of([t.encode() for _, t in rows[:50]]), strict=True):
        assert abs(got[i] - 1 / (1 + math.exp(-sum(expected.get(int(k), 0) for k in x) - expected.get(1 << toxicity.BITS, 0)))) < 1e-9


def test_toxicity_learns_within_its_bounds(spark):
    rows = [(i, "some words " * 50 + str(i)) for i in range(400)]
    labels = docs(spark, [(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    size = lambda **more: toxicity.labelled(docs(spark, rows), labels, **dict(label="toxic", rows=10_000, most_bytes=1 << 30, folds=4, held_out=2) | more).count()
    whole = size()
    assert 60 < size(rows=100) < 140 and whole / 5 < size(most_bytes=whole * 553 // 3) < whole / 2
    # a row that repeats teaches once
    assert toxicity.labelled(docs(spark, rows + rows), labels, "toxic", 10_000, 1 << 30, 4, 2).count() == whole


def test_toxicity_corner_cases(spark):
    rows = [(None, "x"), (1, None), (1, ""), (2, "vile " * 50_000), (2, "vile " * 50_000)]
    none = docs(spark, [], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs(spark, rows), none).collect()} == {0.0}
    some = docs(spark, [(1, None), (2, 1), (None, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs(spark, rows), some).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(docs(spark, []), some).count() == 0
    more = docs(spark, [(1, "x", 0.5, 1)], "doc_id long, text string, score double, label int")
    assert toxicity.score_documents(more, some).columns == ["doc_id", "score"]


# ---- language


def test_language_of_held_out_documents(spark, sf_dir):
    all_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taught = all_.filter("doc_id % 3 <> 0")
    model = langid.train(taught, F.col("lang"), F.col("text"))
    got = langid.identify(all_.filter("doc_id % 3 = 0"), model, F.col("text"), F.col("source")).collect()
    assert sum(r["lang"] == r["language"]["lang"] for r in got) >= 0.98 * len(got)
    assert sum(r["language"]["kept"] for r in got) >= 0.98 * len(got)


def test_pages_agree_with_what_they_declare(spark, sf_dir):
    got = langid.op5_language_id(spark, sf_dir).toPandas()
    pages = got[got.page_id.notna()]
    assert (pages.lang == pages.declared).mean() > 0.97 and got.doc_id.notna().sum() + len(pages) == len(got)


def test_text_alone_agrees_with_what_pages_declare(spark, sf_dir):
    # the declared language is no input here
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("lang"), F.col("text"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", langid.page_text(F.col("html")).alias("text"), langid.declared_lang(F.col("html")).alias("declared"))
    got = langid.identify(pages, model, F.col("text"), F.lit(None)).filter("declared IS NOT NULL").collect()
    assert len(got) > 40 and sum(r["language"]["lang"] == r["declared"] for r in got) >= 0.97 * len(got)


def brute_language(taught, rows):
    """Language (null: unknown) and posterior by row, from text and host, in plain Python; hosts have no dots."""

    def grams_of(text):
        data = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()) + b" "
        for i in range(len(data) - 2):
            a, b, c = data[i : i + 3]
            if b != 32:
                yield ((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BITS)

    counts = {}
    for text, lang in set(taught):
        counts.setdefault(lang, Counter()).update(grams_of(text))
    langs, size = sorted(counts), 1 << langid.BITS
    logs = []
    for text, _ in rows:
        g = list(grams_of(text))
        own = [sum(math.log((1 - langid.BACKGROUND) * counts[x][k] / counts[x].total() + langid.BACKGROUND / size) for k in g) for x in langs] + [-len(g) * math.log(size)]
        logs.append([x * min(1, langid.MOST_TRIGRAMS / max(1, len(g))) for x in own] if g else None)

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    posts = [softmax(x) if x else None for x in logs]
    n = len(langs) + 1
    total = [sum(p[k] for p, (_, h) in zip(posts, rows, strict=True) if p and h is not None) for k in range(n)]
    over = [(x + 1) / (sum(total) + n) for x in total]
    over[-1] = max(over[-1], langid.UNKNOWN)
    over = [x / sum(over) for x in over]
    out = []
    for (_, host), x in zip(rows, logs, strict=True):
        here = [p for p, (_, h) in zip(posts, rows, strict=True) if p and h == host]
        prior = [1 / n] * n
        if host is not None and here:
            prior = over
            for _ in range(2):  # site, then host: here they are the same rows
                prior = [(sum(p[k] for p in here) + langid.TRUST * prior[k]) / (len(here) + langid.TRUST) for k in range(n)]
        p = softmax([(x[k] if x else math.log(1 / n)) + math.log(prior[k]) for k in range(n)])
        best = max(range(n), key=p.__getitem__)
        out.append((None, None, False) if not x else ((langs + [None])[best], p[best], best < n - 1 and p[best] >= langid.MIN_PROB))
    return out


def test_language_matches_brute_force(spark, sf_dir):
    some = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    taught = [(t, x) for t, x, _ in some[:200]]
    rows = [(t, h) for t, _, h in some[200:]] + [("", "src1"), (None, None), ("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", "src1"), ("la", None), ("qxz kjw vvq", "src2"), ("1 2 3", None)]
    model = langid.train(docs(spark, taught, "text string, lang string"), F.col("lang"), F.col("text"))
    got = langid.identify(docs(spark, [(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, host string"), model, F.col("text"), F.col("host")).orderBy("doc_id").collect()
    for r, (lang, prob, kept) in zip(got, brute_language(taught, rows), strict=True):
        own = r["language"]
        assert (own["lang"], own["kept"]) == (lang, kept) and (prob is None or abs(own["prob"] - prob) < 1e-5), (r["doc_id"], own, lang, prob)


def test_other_scripts_noise_and_code_are_of_no_known_language(spark, sf_dir):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("lang"), F.col("text"))
    rng = np.random.default_rng(4)
    noise = " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(30))
    texts = ["\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059", "\u042d\u0442\u043e \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442", noise, "aGVsbG8gd29ybGQ4Y2JhZGZhc2RmYXNkZmFzZGY0MzI0MzI0MjM0" * 4, "xq=zz(kk);jx++;wv&=0x7f;qy->kz();"]
    got = langid.identify(docs(spark, list(enumerate(texts))), model, F.col("text"), F.lit(None)).collect()
    assert [(r["language"]["lang"], r["language"]["kept"]) for r in got] == [(None, False)] * len(texts)


def test_evidence_is_fused(spark):
    texts = {"en": "the cat and the dog were there with that", "de": "der hund und die katze waren da mit dem"}
    taught = docs(spark, [(i, texts[x], x) for i in range(40) for x in texts], "doc_id long, text string, lang string")
    model = langid.train(taught, F.col("lang"), F.col("text"))
    rows = [(i, texts["de"], "www.site.org", None, "de") for i in range(60)] + [(i, texts["en"], "other.com", None, "com") for i in range(100, 160)]
    # no text of their own: host, site, suffix or markup must speak
    rows += [(1000, "", "www.site.org", "de", None), (1001, "", "new.site.org", "en", None), (1002, "1 2 3", None, "en-US", None), (1003, None, None, None, None), (1004, "a", "www.site.org", None, "de"), (1005, texts["en"], "www.site.org", "de", "de"), (1006, "", None, "xx", None)]
    df = docs(spark, rows, "doc_id long, text string, host string, declared string, suffix string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(df, model, F.col("text"), F.col("host"), F.col("declared"), F.col("suffix")).collect()}
    assert got[1000]["lang"] == "de" and got[1000]["prob"] > got[1001]["prob"]
    assert got[1002]["lang"] == "en" and got[1002]["kept"]
    assert (got[1003]["lang"], got[1003]["kept"]) == (None, False) and not got[1006]["kept"]
    assert got[1004]["lang"] == "de" and got[1005]["lang"] == "en"


def test_documents_of_unclear_language_go(spark, monkeypatch):
    import corpus_pipeline

    # a text of both languages' words has about the same evidence for each; the prior of its host, about 55 to 45, decides
    taught = [(i, ("aaaa " if i % 2 else "bbbb ") * (i // 2 + 1), "a" if i % 2 else "b", None) for i in range(200)]
    model = langid.train(docs(spark, taught, "doc_id long, text string, lang string, source string"), F.col("lang"), F.col("text"))
    hosted = [(1000 + i, "aaaa" if i < 55 else "bbbb", None, "h") for i in range(100)]
    df = docs(spark, hosted + [(5000, "aaaa bbbb", None, "h"), (5001, "aaaa", None, "h")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(df, model, F.col("text"), F.col("source")).collect()}
    assert 0.5 < got[5000]["prob"] < 0.6 and not got[5000]["kept"] and got[5001]["kept"]
    monkeypatch.setattr(langid, "train", lambda *_: model)
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, df, "").collect()}
    assert left == {r["doc_id"] for r in df.collect()} - {5000}


def test_copies_teach_a_language_once(spark):
    once = [(i, f"text number {i}", "en") for i in range(20)] + [(20, "copied", "en"), (21, "copied", "de")]
    model = lambda rows: langid.train(docs(spark, rows, "doc_id long, text string, lang string"), F.col("lang"), F.col("text"))
    (names, few), (same, many) = model(once), model(once + [(i, "copied", "en") for i in range(100, 400)])
    assert names == same and np.allclose(few, many)


def test_every_language_is_learnt(spark):
    rows = [(i, f"common words {i}", "many") for i in range(3000)] + [(5000 + i, f"selten {i}", "rare") for i in range(5)]
    rows += [(6000 + i, f"words of {i}", f"l{i}") for i in range(70)]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    names, _ = langid.train(df, F.col("lang"), F.col("text"), most_rows=100)
    assert names == sorted({x for *_, x in rows})
    assert langid.fair_share([5, 1, 100, 100], 46) == 20 and langid.fair_share([3, 4], 10) == 4 and langid.fair_share([], 10) == 0


def test_language_corner_cases(spark):
    df = docs(spark, [(1, "x", None), (1, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(df, F.col("lang"), F.col("text"))
    assert [r["language"]["kept"] for r in langid.identify(df, model, F.col("text"), F.col("lang")).collect()] == [False, False]
    taught = docs(spark, [(1, "x" * 400_000, "a", 1), (2, "y", "b", 2)], "doc_id long, text string, lang string, prior int")
    model = langid.train(taught, F.col("lang"), F.col("text"))
    got = langid.identify(taught, model, F.col("text"), F.col("lang"), wanted=("a",)).collect()
    assert [r["language"]["kept"] for r in sorted(got, key=lambda r: r["doc_id"])] == [True, False] and {r["prior"] for r in got} == {1, 2}
    assert langid.identify(taught.filter("false"), model, F.col("text"), F.col("lang")).count() == 0


def test_page_parts(spark):
    html = "<!DOCTYPE html><HTML class=x lang='fr-FR'><style>p{}</style><script>var t='</p>'</script><p>Bon<br>jour<!-- no --></p>"
    df = docs(spark, [(1, html)]).select(langid.declared_lang(F.col("text")), langid.page_text(F.col("text")), langid.url_host(F.lit("https://a.b.de:80/x")), langid.suffix_of(F.lit("a.b.de")))
    lang, text, host, suffix = df.first()
    assert (lang, text.split(), host, suffix) == ("fr", ["Bon", "jour"], "a.b.de", "de")
