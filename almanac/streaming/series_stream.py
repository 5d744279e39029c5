"""An extension: the collapsed listing as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import BUCKETS
from ..operators.series import SeriesStore


def start(events: DataFrame, store_path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each micro-batch of the streaming events into the series under store_path.

    Late, shuffled and repeated events give the same series as all at once. A
    micro-batch's number is the store's version, so one that runs again after a
    failure is completed or changes nothing.
    """
    schema = events.schema

    def apply(batch: DataFrame, number: int) -> None:
        SeriesStore(batch.sparkSession, store_path, schema, buckets).apply(batch, number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
