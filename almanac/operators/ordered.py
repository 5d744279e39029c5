"""An extension: the keyed upsert for batches that come late, shuffled or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import BUCKETS, KeyedTable
from .upsert import MUTABLE


def key_states(rows: DataFrame, order: list[str], fixed: list[str]) -> DataFrame:
    """(dedup_key, first_at, last_at, f, m): of each key the first row's fixed and the last row's mutable values, by order.

    Rows that agree in order should be the same row, come again. Where they
    differ all the same, their values' hashes decide, so the result is one.
    """
    at = lambda values: F.struct(*order, F.xxhash64(*values).alias("tie"))
    keyed = rows.select("dedup_key", at(fixed).alias("first_at"), at(MUTABLE).alias("last_at"), F.struct(*fixed).alias("f"), F.struct(*MUTABLE).alias("m"))
    return merge_states(keyed)


def merge_states(states: DataFrame) -> DataFrame:
    """One state a key. Merging in any order, in any portions and more than once gives the same."""
    return states.groupBy("dedup_key").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min_by("f", "first_at").alias("f"), F.max_by("m", "last_at").alias("m"))


class OrderedStore:
    """Events by key under path, as if all rows ever given had been applied one by one in the order of their `order` columns.

    order must name a row for good, such as event time, source and number in
    its source; nulls come first. The state of a key is its earliest and its
    latest row's values with their places, which is all that an upsert leaves,
    so no list of rows is kept: a row that comes again, in whatever batch,
    changes nothing, and one that comes late takes its place in the order. A
    batch reads the buckets of its keys and writes those in which a state changes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order: list[str], buckets: int = BUCKETS):
        none = spark.createDataFrame([], schema)
        self.names, self.order = [c for c in none.columns if c not in order], order
        self.fixed = [c for c in self.names if c not in (*MUTABLE, "dedup_key")]
        self.states = KeyedTable(spark, path, key_states(none, order, self.fixed).schema, "dedup_key", buckets)

    def changes(self, batch: DataFrame) -> DataFrame:
        """The states that are new or differ after batch."""
        fresh = key_states(batch, self.order, self.fixed)
        held = self.states.read_touched(fresh.select("dedup_key")).select("dedup_key", F.struct("first_at", "last_at", "f", "m").alias("held"))
        both = fresh.withColumn("fresh", F.struct("first_at", "last_at", "f", "m")).join(held, fresh["dedup_key"].eqNullSafe(held["dedup_key"]), "left").select(fresh["dedup_key"], "fresh", "held")
        early = F.col("held").isNull() | (F.col("fresh.first_at") < F.col("held.first_at"))
        late = F.col("held").isNull() | (F.col("fresh.last_at") > F.col("held.last_at"))
        pick = lambda when, c: F.when(when, F.col(f"fresh.{c}")).otherwise(F.col(f"held.{c}")).alias(c)
        return both.where(early | late).select("dedup_key", pick(early, "first_at"), pick(late, "last_at"), pick(early, "f"), pick(late, "m"))

    def apply(self, batch: DataFrame, version: int | None = None) -> list[int]:
        """Merge batch; the buckets written. A version that is already there changes nothing. Extra columns of batch go."""
        return self.states.put(self.changes(batch), version)

    def read(self, version: int | None = None) -> DataFrame:
        """The events as of a version; the newest by default."""
        value: dict[str, Column] = {c: F.col(f"f.{c}") for c in self.fixed} | {c: F.col(f"m.{c}") for c in MUTABLE} | {"dedup_key": F.col("dedup_key")}
        return self.states.read(version).select(*(value[c].alias(c) for c in self.names))

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest `keep` versions don't read; how many folders."""
        return len(self.states.vacuum(keep))
