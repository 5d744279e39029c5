"""The collapsed listing kept up to date: batches of events are merged into the parts of their series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import BUCKETS, KeyedTable, drop_folder
from .serve import merge_parts, order_key, series_parts, whole_series


def _keyed(parts: DataFrame) -> DataFrame:
    """parts with a key for each series and artist; no artist, an empty one and no name differ."""
    return parts.withColumn("part_key", F.sha2(F.to_json(F.struct("_series", "_artist")), 256))


class SeriesStore:
    """Parts of series under path, and the ids of the events in them.

    A batch costs what it touches: the buckets of its ids and of its parts. As
    parts merge in any order, batches may come late or out of order. An event is
    known by its id: one that comes again, in the same batch or a later one,
    counts once, as it came first (in one batch: as its earliest date and time
    say). Events without an id are all different. A series of any size is spread over its artists'
    parts, of which each is one row.

    An event that was changed or withdrawn needs a new store, as a minimum can't be taken back.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        none = spark.createDataFrame([], schema)
        self.spark, self.path, self.columns = spark, path, none.columns
        self.parts = KeyedTable(spark, f"{path}/parts", _keyed(series_parts(none)).schema, "part_key", buckets)
        self.ids = KeyedTable(spark, f"{path}/ids", none.select("id").schema, "id", buckets)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The events of batch that the store doesn't have, each id once."""
        names = [F.col(f"`{c}`") for c in self.columns]
        named = batch.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct(*names), order_key(F.xxhash64(*names).alias("tie"))).alias("_e")).select("_e.*")
        known = self.ids.read_touched(named.select("id")).select("id").hint("merge")
        return named.join(known, "id", "left_anti").unionByName(batch.where(F.col("id").isNull()).select(*names))

    def _staged(self, fresh: DataFrame, version: int) -> DataFrame:
        """fresh as a table of its own, as it is read more than once; a batch that runs again writes it anew."""
        path = f"{self.path}/fresh/version={version}"
        fresh.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(fresh.schema).parquet(path)

    def apply(self, batch: DataFrame, version: int | None = None) -> list[int]:
        """Merge batch; the buckets of parts written. Extra columns of batch go.

        Both tables get the same version, the ids last: a batch that failed
        between them is completed when it is applied again, and one that had been
        written changes nothing.
        """
        version = self.ids.version() + 1 if version is None else version
        if version <= self.ids.version():
            return []
        written = []
        if version > self.parts.version():
            fresh = self._staged(_keyed(series_parts(self.unseen(batch))), version)
            held = self.parts.read_touched(fresh.select("part_key")).drop("bucket").join(fresh.select("part_key").hint("merge"), "part_key", "left_semi")
            written = self.parts.put(_keyed(merge_parts(fresh.unionByName(held))), version)
            drop_folder(self.spark, f"{self.path}/fresh/version={version}")
        self.ids.put(batch.where(F.col("id").isNotNull()).select("id").distinct(), version)
        return written

    def read(self, version: int | None = None) -> DataFrame:
        """The collapsed listing as of a version; the newest by default."""
        return whole_series(self.parts.read(version).drop("bucket", "part_key"))

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest `keep` versions don't read; how many folders."""
        return len(self.parts.vacuum(keep)) + len(self.ids.vacuum(keep))
