import numpy as np
from pyspark.sql import functions as F

from tagmill.llm import ann as m

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, wanted, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in wanted:
        score = x @ x[ids.tolist().index(q)]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:k]
        out[q] = [int(ids[j]) for j in order]
    return out


def found(spark, rows, every=20, **more):
    got = m.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n, d=24, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, d)) * rng.uniform(0.5, 2, (n, 1)))]


def test_query_recall_and_exact_scores(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    e = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.values).astype(float), e.vec_id.values
    got = m.op7_nearest(spark, folder).toPandas()
    assert got.groupby("query_id").size().eq(20).all() and set(got.query_id) == {i for i in ids if i % 20 == 0}
    near = {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")}
    assert m.recall(near, ids, x) >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    assert all(abs(s - x[at[q]] @ x[at[v]]) < 1e-12 for q, v, s in zip(got.query_id, got.vec_id, got.score, strict=True))


def test_all_lists_give_brute_force_with_any_norms(spark):
    rows = vectors(600)
    got = found(spark, rows, k=5, probes=10**6)
    expected = brute(rows, got, 5)
    same = sum(len(set(expected[q]) & {r["vec_id"] for r in got[q]}) for q in got)
    assert len(got) == 30 and same >= 0.98 * 150


def test_few_rows_give_all_candidates(spark):
    rows = vectors(8)
    got = found(spark, rows, every=2)
    assert {q: [r["vec_id"] for r in rs] for q, rs in got.items()} == brute(rows, [0, 2, 4, 6], 20)
    assert found(spark, rows[:1], every=1) == {}


def test_copies_count_and_ties_go_by_id(spark):
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in vectors(120, seed=3)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(300)]
    got = found(spark, rows, k=5)
    assert [r["vec_id"] for r in got[1000]] == [7, 1001, 1002, 1003, 1004]
    assert [r["vec_id"] for r in got[1020]] == [7, 1000, 1001, 1002, 1003]


def test_blocks_and_turns_change_nothing(spark, monkeypatch):
    rows = vectors(300, seed=5)
    a = found(spark, rows, k=5, probes=10**6)
    monkeypatch.setattr(m, "LIST_ROWS", 7)
    monkeypatch.setattr(m, "QUERY_ROWS", 2)
    b = found(spark, rows, k=5, probes=10**6)
    hits = sum(len({r["vec_id"] for r in a[q]} & {r["vec_id"] for r in b[q]}) for q in a)
    assert set(a) == set(b) and hits >= 0.97 * 5 * len(a)


def test_unusable_rows_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (120, []), (5, [0.5, 0.5]), (5, [0.5, 0.5])]
    got = found(spark, rows)
    assert {q: [(r["vec_id"], r["score"]) for r in rs] for q, rs in got.items()} == {0: [(1, 0.5), (5, 0.5)]}


def test_empty_table_and_clashing_columns(spark):
    assert m.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 2), (1, [1.0, 1.0], 1, 2)], SCHEMA + ", score int, list int")
    assert m.search(df, F.col("vec_id") == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    near = [set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist()) for q in x[:50]]
    for together, bound in ((1, None), (50, None), (50, 100.0)):
        lost = 0
        for of in range(0, 50, together):
            who, which = m.scan(x, x[of : of + together], 10, None if bound is None else np.full(together, bound))
            for j in range(together):
                kept = which[who == j]
                assert len(kept) < 1500
                lost += len(near[of + j] - set(kept.tolist()))
        assert lost <= 10
