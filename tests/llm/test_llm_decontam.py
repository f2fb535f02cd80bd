import random
import re

from tagmill.llm import decontam as m


def test_query_matches_sql(spark, sf_dir, same_as_sql):
    same_as_sql(m.op3_decontaminate(spark, sf_dir), m.OP3_SQL, sf_dir)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, **more):
    d, b = tables(spark, docs, items)
    return {r["id"]: (r["overlap"]["n_words"], list(r["overlap"]["spans"]), list(r["overlap"]["items"])) for r in m.find_overlaps(d, b, **more).collect()}


def test_against_brute_force_on_few_words(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "?!")]
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for i in range(25)] + [(99, None)]
    items = [x for x in items if len(m.words_of(x[1])) != 1 or x[1] == "a"]
    brute = m.brute(docs, items)
    for most in (1 << 20, 4_000):
        got = found(spark, docs, items, table_bytes=most)
        for doc, (n, hit, n_items, _, bad) in brute.items():
            w, spans, ids = got[doc]
            assert (w, sum(spans[1::2]) - sum(spans[::2]), len(ids), bool(spans)) == (n, hit, n_items, bad)


def test_words_and_short_items(spark):
    got = found(spark, [(1, "One-TWO, Éa 3x"), (2, "two éa"), (3, "Two Éa")], [(7, "TWO Éa 3x"), (8, "one"), (9, "--")])
    assert got == {1: (4, [0, 4], ["7", "8"]), 2: (2, [], []), 3: (2, [], [])}


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(map(str, range(12)))
    assert found(spark, [(1, text), (1, text)], [(None, text), (5, text), (5, text)]) == {1: (12, [0, 12], ["5"])}
    assert found(spark, [(1, text)], []) == {1: (12, [], [])}
    d, b = tables(spark, [], [(1, text)])
    assert m.find_overlaps(d, b).count() == 0


def test_decontaminate_keeps_clean_rows_and_clashing_columns(spark):
    text = " ".join(map(str, range(12)))
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, "clean", 6, "y"), (3, None, 7, None)], "doc_id long, text string, id long, overlap string")
    kept = m.decontaminate(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["id"] for r in kept.collect()) == [6, 7]


def test_long_text_with_one_hit(spark):
    text = " ".join(map(str, range(10)))
    long = "zz " * 200_000 + text + " yy" * 200_000
    assert found(spark, [(1, long)], [(1, text)])[1] == (400_010, [200_000, 200_010], ["1"])


def test_tables_of_each_block_stay_below_the_bound(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9)))
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 60, 200])))) for i in range(3000)]
    _, b = tables(spark, [], items)
    bound = 2 << 20
    blocks = list(m.blocks_of(b, "item_id", "text", m.WINDOW, bound))
    assert len(blocks) > 5 and sum(len(x.names) for x in blocks) == len(items)
    assert max(x.nbytes() for x in blocks) < 1.3 * bound  # blocks are cut by a hash
    # of many blocks each document gets all its hits
    docs = [(i, f"{word()} {items[i * 7][1]} {word()} {items[i * 11][1]}") for i in range(60)]
    got = found(spark, docs, items, table_bytes=bound)
    assert all({str(i * 7), str(i * 11)} <= set(got[i][2]) for i, _ in docs) and all(got[i][1][-1] - got[i][1][0] >= 9 for i, _ in docs)


def test_one_block_is_held_at_a_time(spark):
    text = " ".join(map(str, range(12)))
    d, b = tables(spark, [(1, text)], [(i, f"{text} {i}") for i in range(200)])
    plan = m.find_overlaps(d, b, table_bytes=20_000)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow|PythonMapInArrow", plan)) <= 2  # the first block's pass; a plan is printed twice where it adapts


def test_hashes_that_agree_are_compared_as_text():
    found = m.Tables([("a", "one two three four")], 4)
    assert [x[2] for x in found.search([b"One, two;three four", b"one two three five", b""])] == [["a"], [], []]
    # a pattern's hash that lies gives no hit: the words decide
    found.kinds[0].words.data[:3] = list(b"xxx")
    assert [x[2] for x in found.search([b"one two three four"])] == [[]]
