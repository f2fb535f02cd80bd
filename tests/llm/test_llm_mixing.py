import random
import re

from pyspark.sql import functions as F

from tagmill.llm import mixing as m


def brute_targets(sizes, weights=m.WEIGHTS, most=3):
    """sizes by source in order; share by weight, cut at most times the size, share the rest anew."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, full, left = [0.0] * len(sizes), set(), float(sum(sizes))
    while len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = left / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * level >= most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = w[i] * level
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
            full.add(i)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = m.mix(df, **more).collect()
    assert len(got) == len(rows)
    by = {}
    for _, text, source in rows:
        by[source] = by.get(source, 0) + words(text)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, brute_targets([by[s] for s in order]), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["source_size"] == by[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) < 1
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    return got


def corpus(seed, n=400):
    rng = random.Random(seed)
    sources = ["hot"] * 10 + ["a", "b", "é", "Z", "tiny", None, ""]
    return [(i, "w " * rng.choice([0, 1, 3, 50, 400]), rng.choice(sources)) for i in range(n)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, corpus(seed), range_rows=20)


def test_small_sources_repeat_and_stop_at_three_epochs(spark):
    rows = [(i, "w " * 10, "big") for i in range(50)] + [(100, "w " * 7, "a"), (101, "w", "b")]
    got = {r["doc_id"]: r["taken"] for r in check(spark, rows)}
    assert got[100] == 21 and got[101] == 3


def test_ranges_do_not_change_the_mix(spark):
    rows = corpus(3)
    a, b = (sorted((r["doc_id"], r["taken"]) for r in check(spark, rows, range_rows=n)) for n in (7, 10**6))
    assert a == b


def test_blocks_of_ranges_do_not_change_the_mix(spark, monkeypatch):
    rows = corpus(5)
    a = sorted((r["doc_id"], r["taken"]) for r in check(spark, rows, range_rows=7))
    monkeypatch.setattr(m, "BLOCK_RANGES", 3)
    assert a == sorted((r["doc_id"], r["taken"]) for r in check(spark, rows, range_rows=7))


def test_reruns_and_partitions_agree(spark):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, x.collect())) for x in (m.mix(df), m.mix(df.repartition(7))))
    assert a == b


def test_nulls_repeats_empty_and_clashing_columns(spark):
    check(spark, [(1, None, None), (1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, " \t\n", "t")])
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix(df).count() == 0
    more = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1), "range": F.lit(2), "of": F.lit(3)})
    assert m.mix(more).first()["taken"] == 2


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    check(spark, [tuple(r) for r in rows])
    assert m.op10_mix_sources(spark, sf_dir).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_rows_that_share_an_id_or_have_none_are_spread(spark):
    docs = spark.createDataFrame([(i, f"{'w ' * 3}{n}", "a") for i in (None, 7) for n in range(200)], "doc_id long, text string, source string")
    assert m.measured(docs).select("key").distinct().count() >= 200
    got = m.mix(docs, range_rows=10).collect()
    assert len(got) == 400 and sum(r["taken"] for r in got) == sum(r["size"] for r in got) == 1600
