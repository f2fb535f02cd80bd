import corpus_pipeline as p
import pytest

from tagmill.llm import decontam, mixing, neardup, toxicity
from tagmill.llm.common import stage

from test_llm_neardup import brute as near_brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before the first stage and after each."""
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, step in p.STAGES:
        docs.append(stage(step(spark, docs[-1], sf_dir), f"test-{name}"))
    return docs


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_are_the_named_ones_in_order():
    assert [n for n, _ in p.STAGES] == ["language", "toxicity", "near_dedup", "decontaminate", "mix"]


def test_columns_stay(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[:-1])


def test_language_keeps_clear_documents(stages):
    assert len(ids(stages[1])) >= 0.99 * len(ids(stages[0]))


def test_toxicity_drops_what_its_model_rejects(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity.score_documents(stages[1], labels).collect()
    assert ids(stages[2]) == {r["doc_id"] for r in scores if r["score"] < toxicity.THRESHOLD}


def test_one_document_of_each_group_stays(stages):
    rows = [tuple(r) for r in stages[2].select("doc_id", "text").collect()]
    groups = {}
    for doc, _, component in near_brute(rows, neardup.WORDS):
        groups.setdefault(component, []).append(doc)
    assert ids(stages[3]) == set(groups)


def test_benchmark_passages_go(spark, sf_dir, stages):
    rows = [tuple(r) for r in stages[3].select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(stages[4]) == {doc for doc, r in decontam.brute(rows, bench).items() if not r[-1]}


def test_mixture_is_of_what_is_left(stages):
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[4]).collect() if r["taken"]}
    assert {r["doc_id"]: r["taken"] for r in stages[5].collect()} == want


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert sorted(map(tuple, p.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[5].collect()))


def test_empty_documents(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    # columns are named as the stages' own; every id and text comes twice, and one text is very long
    long = "the cat and the dog were there with that " * 20_000
    texts = [None, "", " \n", "the cat and the dog were there with that", long, "word " * 3, "vile the cat was there and it was vile"]
    rows = [(i, t, x, s, 1, 2, 3, "r", "y") for i, t in enumerate(texts) for x in ("en", None) for s in ("src", None)]
    df = spark.createDataFrame(rows + [(None, "the cat and the dog", "en", "src", 1, 2, 3, "r", "y")], "doc_id long, text string, lang string, source string, language int, score int, gone int, row string, __toxic string")
    folder = str(tmp_path)
    spark.createDataFrame([(6, 1, 1), (3, 0, 1), (None, 1, 1), (4, None, 1)], "doc_id long, toxic int, score int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any of these texts at all here"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at = df
    for name, step in p.STAGES[:-1]:
        at = stage(step(spark, at, folder), f"test-{name}")
        assert at.dtypes == df.dtypes
        if name == "language":  # the texts that have letters and are of the language learnt
            assert {r["doc_id"] for r in at.collect()} >= {3, 4, 6} and not {r["doc_id"] for r in at.collect()} & {0, 1, 2}
    left = at.collect()
    assert len({r["text"] for r in left}) == len(left)
    taken = {r["doc_id"]: r["taken"] for r in p.STAGES[-1][1](spark, at, folder).collect()}
    assert sum(taken.values()) == sum(len(r["text"].split()) for r in left)


def test_stages_take_empty_tables(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, step in p.STAGES[:-1]:
        assert step(spark, docs.filter("false"), str(tmp_path)).columns == docs.columns
    assert p.STAGES[1][1](spark, docs, str(tmp_path)).count() == 50 == p.STAGES[3][1](spark, docs, str(tmp_path)).count()


def test_language_rejects_what_is_of_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(-1, "これは日本語の文章です", None, "src1", 1), (-2, "qxzk jvwq zzxk kqjv wvxz qqkz", None, "src1", 1), (-3, "12 34", "en", "src1", 1)], docs.schema)
    assert not {r["doc_id"] for r in p.language(spark, docs.unionByName(more), sf_dir).collect()} & {-1, -2, -3}
