"""Continuous classification: every micro-batch classifies what the ledger lacks and commits it.

Items have no event time; the ledger's keys, not a watermark, make the result exactly-once. Before a batch calls anything it
notes its number and that of its commit; a batch that runs again and finds the commit there does nothing, so failed items
aren't called twice by it either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagmill.backends import Backend
from tagmill.config import Settings
from tagmill.identity import KEYS
from tagmill.operators import dedup, merge
from tagmill.plans.classify import classify
from tagmill.sources.ledger import Ledger


BATCH = "batch.json"


def batch_of(frame: DataFrame, number: int, backend: Backend, settings: Settings, ledger: Ledger) -> None:
    if frame.isEmpty():
        return
    ordered = frame.withColumn("ord", F.monotonically_increasing_id())
    items = dedup.keep_first(ordered, settings.text_column, settings.context_column).select(*KEYS, "ord")
    noted = ledger.metadata_of(BATCH) or {}
    if noted.get("batch") == number and not ledger.read().filter(F.col("seq") == noted["seq"]).isEmpty():
        return
    seq = ledger.next_seq()
    ledger.write_metadata_of(BATCH, {"batch": number, "seq": seq})
    todo = merge.resume_todo(items, ledger.successes())
    ledger.append(classify(todo, backend, settings), seq)


def classify_stream(stream: DataFrame, backend: Backend, settings: Settings, ledger: Ledger, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the query; once: it ends when what is there now is done. stop() on it ends it after the batch under way."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda frame, number: batch_of(frame, number, backend, settings, ledger))
    return (writer.trigger(availableNow=True) if once else writer).start()
