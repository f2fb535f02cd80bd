import random

import numpy as np
import pytest

from tagmill.llm import neardup as m


def test_query_matches_sql(spark, sf_dir, same_as_sql):
    same_as_sql(m.op9_near_dedup(spark, sf_dir), m.OP9_SQL, sf_dir)


def shingles(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return set()
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, n=m.WORDS, percent=m.PERCENT):
    """Component id by row, comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    low = {r: min((d for d in docs if d is not None), default=None) for r, docs in ids.items()}
    return [(doc, len(s), low[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def run(spark, rows, **more):
    return m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more)


def check(spark, rows, **more):
    got = sorted(str((r["doc_id"], r["n"], r["component_id"])) for r in run(spark, rows, **more).collect())
    assert got == sorted(str(x) for x in brute(rows, more.get("words", m.WORDS)))


def edited(rng, words, share):
    return [rng.choice(VOCAB) if rng.random() < share else w for w in words]


VOCAB = [f"w{i}" for i in range(500)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(25):  # groups around the bound, of short and long texts
        base = [rng.choice(VOCAB) for _ in range(rng.choice([1, 3, 5, 8, 12, 30, 100, 300]))]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))) for _ in range(rng.randrange(1, 9))]
    rows = [(i, t) for i, t in enumerate(rows)]
    for words in (4, 5):
        check(spark, rows, words=words)


def test_chain_of_edits_is_one_component(spark):
    rng = random.Random(4)
    words = [rng.choice(VOCAB) for _ in range(150)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join(words)))
        words[rng.randrange(150)] = rng.choice(VOCAB)
    check(spark, rows)
    assert run(spark, rows).filter("first").count() == 1


def test_borderline_group_in_blocks(spark, monkeypatch):
    # blocks, salts and orders of two rows exercise what only large groups would
    monkeypatch.setattr(m, "BLOCK_ROWS", 2)
    monkeypatch.setattr(m, "SALT_ROWS", 2)
    monkeypatch.setattr(m, "ORDER_ROWS", 2)
    rng = random.Random(6)
    base = [rng.choice(VOCAB) for _ in range(200)]
    check(spark, [(i, " ".join(edited(rng, base, 0.018))) for i in range(40)])


def test_without_neighbour_rounds(spark, monkeypatch):
    monkeypatch.setattr(m, "TURNS", 0)
    rng = random.Random(7)
    base = [rng.choice(VOCAB) for _ in range(120)]
    check(spark, [(i, " ".join(edited(rng, base, 0.018))) for i in range(40)])


def test_nulls_ties_repeats_and_empty_texts(spark):
    text = " ".join(VOCAB[:50])
    rows = [(3, text), (3, text), (None, text), (9, text.upper()), (5, None), (6, ""), (7, " \t\n\v"), (None, "x"), (None, "x"), (11, "x y")]
    check(spark, rows)
    got = run(spark, rows).filter("first").collect()
    # one row a component; of rows with its id the first
    assert sorted(str(r["component_id"]) for r in got) == sorted(map(str, [3, 5, 6, 7, None, 11]))


def test_deduplicated_keeps_all_columns(spark):
    text = " ".join(VOCAB[:50])
    df = spark.createDataFrame([(2, text, "a"), (1, text, "b"), (4, None, "c"), (5, "", "d")], "doc_id long, text string, rid string")
    got = m.deduplicated(df)
    assert got.columns == df.columns and sorted(r["rid"] for r in got.collect()) == ["b", "c", "d"]
    assert m.deduplicated(df.filter("false")).count() == 0


def test_long_text_and_large_copy_group(spark):
    long = " ".join(str(i * 7919 % 100_003) for i in range(120_000))
    rows = [(1, long), (2, long + " end")] + [(i, "one two three four five six") for i in range(10, 400)]
    got = {r["doc_id"]: r["component_id"] for r in run(spark, rows).collect()}
    assert got[2] == 1 and {got[i] for i in range(10, 400)} == {10}


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    for size in (20, 300, 5000):
        for j in (0.6, 0.8, 0.95):
            union = rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            both = int(size * j)
            extra = (size - both) // 2
            a, b = np.sort(union[: both + extra]), np.sort(np.concatenate([union[:both], union[both + extra :]]))
            x, y = (m.registers_of(s, np.array([len(s)]))[0] for s in (a, b))
            assert m.likely(x, y, len(a), len(b), j - 0.01 if size > 100 else j - 0.08)


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_bands_find_what_is_alike(size):
    rng = np.random.default_rng(size)
    missed = 0
    for _ in range(300):
        union = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        both = int(len(union) * 0.8)
        a, b = np.sort(union[:-1]) if size == 5 else np.sort(union), np.sort(union[:both] if size != 5 else union)
        k = m.keys_of(np.concatenate([m.registers_of(s, np.array([len(s)])) for s in (a, b)]))
        missed += not (k[0] == k[1]).any()
    assert missed == 0


def test_documents_of_a_join_keep_their_rows(spark):
    # shuffled input, adaptive execution and wide columns that only some readings need
    rng = random.Random(8)
    rows = []
    for k in range(150):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([6, 40, 80]))]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0, 0.01]))) for _ in range(rng.randrange(1, 4))]
    rows = [(i, t) for i, t in enumerate(rows)]
    expected = {c for *_, c in brute(rows)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "20k", "40"), strict=True):
            spark.conf.set(k, v)
        texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        wide = spark.range(len(rows)).select(m.F.col("id").alias("doc_id"), m.F.repeat(m.F.md5(m.F.col("id").cast("string")), 50).alias("wide"), m.F.lit(1).alias("rid")).repartition(5)
        got = m.deduplicated(texts.join(wide, "doc_id")).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(expected) and all(len(r["wide"]) == 1600 for r in got)
        found = m.near_duplicates(texts.join(wide, "doc_id")).collect()
        assert sorted((r["doc_id"], r["n"], r["component_id"]) for r in found) == sorted(brute(rows))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_without_candidates_are_not_shuffled(spark):
    # 200 texts of 36 KB that hardly compress and are like no other, three that are; no join by broadcast unless asked for
    rng = random.Random(12)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(2200)) for _ in range(200)]
    texts += [texts[5] + " end", texts[5] + " another end", texts[7] + " end"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        seen = shuffled_bytes(spark)
        docs.write.format("noop").mode("overwrite").save()
        own = sum(v for k, v in shuffled_bytes(spark).items() if k not in seen)  # the repartition
        seen = shuffled_bytes(spark)
        got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(docs).collect()}
        moved = sum(v for k, v in shuffled_bytes(spark).items() if k not in seen) - own
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {i: c for i, c in got.items() if i != c} == {200: 5, 201: 5, 202: 7} and len(got) == 203
    assert 0 < moved < sum(map(len, texts)) / 4


def test_shared_words_of_the_bit_map_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "MAP_WORDS", 1)
    rows, pairs = spark.range(500).withColumnRenamed("id", "rid"), spark.createDataFrame([(3, 64 + 63), (3, 300)], "a long, b long")
    found = {r["rid"] for r in m.among(rows, "rid", pairs).collect()}
    assert {3, 127, 300} <= found and len(found) < 30
    monkeypatch.undo()
    assert {r["rid"] for r in m.among(rows, "rid", pairs).collect()} == {3, 127, 300}


def joined_rows(spark):
    """Rows that joins have made so far, by execution and node."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    for k in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, found = store.planGraph(k).allNodes(), store.executionMetrics(k)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name():
                ids = [x.accumulatorId() for x in (node.metrics().apply(i) for i in range(node.metrics().size())) if x.name() == "number of output rows"]
                out[k, node.id()] = sum(int(found.apply(x).replace(",", "")) for x in ids if found.contains(x))
    return out


def least_of(links):
    root = {}
    for a, b in links:
        x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
        if x is not y:
            x |= y
            root.update((v, x) for v in y)
    return {v: min(x) for v, x in root.items()}


def links_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_links_are_looked_up_once(spark):
    # a clique and a chain, which many turns join: the clique's links are looked up by each end, and not in every turn
    links = [(i, j) for i in range(80) for j in range(i)] + [(1000 + i, 1001 + i) for i in range(40)]
    seen = joined_rows(spark)
    got = {r["v"]: r["root"] for r in m.components(links_of(spark, links)).collect()}
    made = sum(v for k, v in joined_rows(spark).items() if k not in seen)
    assert got == least_of(links)
    assert len(links) < made < 2.5 * len(links)


def test_components_grow(spark):
    rng = random.Random(14)
    far = [[(rng.randrange(s, s + n), rng.randrange(s, s + n)) for _ in range(k)] for s, n, k in ((0, 300, 150), (0, 300, 40), (200, 300, 60))]
    chain = rng.sample(range(600, 700), 100)
    rounds = [far[0] + list(zip(chain, chain[1:], strict=False)), far[1] + [(2000, k) for k in range(1000, 1030)], [], far[2] + [(5, 650), (5000, 5001)]]
    rounds = [[(a, b) for a, b in x if a != b] for x in rounds]
    at, all_ = m.components(links_of(spark, [])), []
    assert at.count() == 0
    for links in rounds:
        at = m.components(links_of(spark, links), at)
        all_ += links
        got = at.collect()
        assert len(got) == len(least_of(all_)) and {r["v"]: r["root"] for r in got} == least_of(all_)
