from pyspark.sql import functions as F

from tagmill.llm import neardup as m
from tagmill.llm.common import stage


def test_filter_on_a_column_with_a_large_dictionary(spark):
    # 3,000 values of 8 bytes, each repeated: a dictionary page of 24 KB, which a pushed filter reads in pieces
    rows = spark.range(30_000).select((F.col("id") % 3000).alias("n"), "id").coalesce(1)
    got = stage(rows, "test-dictionary")
    assert got.filter("n > 0").count() == 29_990 and got.filter("n = 2999").count() == 10


def test_near_duplicates_of_many_sizes_each_repeated(spark):
    # 1,500 set sizes, 4 copies each, in one file
    words = F.expr("concat_ws(' ', transform(sequence(1, 5 + id div 4), x -> concat('w', id div 4, 'x', x)))")
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), words.alias("text")).coalesce(1)
    got = m.near_duplicates(docs, words=4)
    assert got.filter("component_id = doc_id - doc_id % 4 AND n = 2 + doc_id div 4").count() == 6_000
