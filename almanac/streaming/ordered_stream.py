"""An extension: the keyed upsert over a stream whose rows come late, shuffled and repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import BUCKETS
from ..operators.ordered import OrderedStore


def start(events: DataFrame, store_path: str, checkpoint: str, order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each micro-batch of events into the store under store_path, as if rows came in the order of their `order` columns.

    order is the event time and what names a row of that time, such as source
    and number. There is no watermark, as none is needed: a key's state is of one size
    however many rows it has had, and takes a row at any time, once. A
    micro-batch's number is the store's version, so one that runs again after a
    failure is completed or changes nothing.
    """
    schema = events.schema

    def apply(batch: DataFrame, number: int) -> None:
        OrderedStore(batch.sparkSession, store_path, schema, order, buckets).apply(batch, number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
