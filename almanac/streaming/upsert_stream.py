"""An extension: the keyed upsert as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import BUCKETS
from ..operators.upsert import EventStore


def start(events: DataFrame, store_path: str, checkpoint: str, order: list[str], now: Column, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each micro-batch of the streaming events into the store under store_path.

    A micro-batch's number is the store's version, so a batch that runs again
    after a failure is completed or, if it had been written, changes nothing.
    Only the buckets that a batch touches are read and written.
    """
    schema = events.schema

    def apply(batch: DataFrame, number: int) -> None:
        EventStore(batch.sparkSession, store_path, schema, buckets).apply(batch, order, now, number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, store_path: str, schema) -> DataFrame:
    """The newest version of the store; no rows where there is none."""
    return EventStore(spark, store_path, schema).read()
