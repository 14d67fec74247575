"""Incremental ingest: new event rows, as files arrive, into a store; the checkpoint is the watermark.

Each micro-batch adds a version to the segments it touches and rewrites none, and storing a batch again
changes nothing, so a batch that a failure repeats counts once. ``EventStore.compact`` makes the
versions one, whenever that suits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import EVENTS
from ..operators.extract import extract
from ..operators.store import LAST, EventStore


def ledgers_arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of (ledger_sequence, raw) as a stream."""
    return spark.readStream.schema("ledger_sequence long, raw binary").option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def events_arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of event rows as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def store_stream(stream: DataFrame, store: EventStore, checkpoint: str, exclude_topic0: Sequence[bytes] = (), decoder: Callable | None = None, once: bool = True) -> StreamingQuery:
    """Starts storing ``stream``, of event rows or, with a ``decoder``, of ledgers; with ``once``, it ends when all there is has been stored."""

    def batch(df: DataFrame, _: int) -> None:
        events = extract(df, decoder) if decoder else df
        # a batch adds a version to its segments and moves the watermark by the same manifest
        store.upsert(events, exclude_topic0, LAST)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
