"""A training corpus from raw documents: language, toxicity, near duplicates, benchmark passages, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes
each result as Parquet to the shared folder and reads it again for the next stage.

Defined results. Columns of docs other than those named here pass through whatever their names, since each stage keeps a row
in one column while it judges it. Texts are judged whole, however long. An empty table gives an empty result everywhere.

language       needs text, lang, source. Null, empty and letterless texts go: they have no language. A null source gives no
               prior, a null lang teaches nothing. Rows that repeat are judged alike.
toxicity       needs doc_id, text. Null and empty texts have the score of the bias. Without labels nothing goes. The same id
               twice: both rows learn and are judged by their own text.
near_dedup     needs doc_id, text. Null, empty and blank texts are alike with nothing and stay, repeated or not. Of a group
               the row with the smallest id stays, of several with that id the first; a null id is larger than all others.
decontaminate  needs text. Null and empty texts have no words and stay. Repeated rows go or stay together.
mix            needs doc_id, source, text. A null text has size 0 and isn't taken; null sources are one source, the last.
               Equal keys are ordered by id, size and text; equal rows by nothing that could show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import decontam, langid, mixing, neardup, toxicity
from tagmill.llm.common import stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is clear and known; the text model learns from a bounded sample of `lang`."""
    model = langid.train(docs, F.col("lang"), F.col("text"))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    found = langid.identify(packed, model, F.col("row.text"), F.col("row.source"))
    return found.filter("language.kept").select("row.*")


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return scored.filter(toxicity.predicted(F.col("score")) == 0).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten consecutive words with a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with the words to take of each; those of which none are taken aren't in it."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("language", language), ("toxicity", harmless), ("near_dedup", distinct), ("decontaminate", uncontaminated), ("mix", mixture)]

#: Learnt models and hash-random order: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
