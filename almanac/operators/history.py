"""An extension: how keyed rows were over time, and lookups as of an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def intervals(rows: DataFrame, key: str, time: str, values: list[str], tie: str) -> DataFrame:
    """(key, *values, valid_from, valid_to): for each key the stretches in which its values stayed the same.

    valid_to is the begin of the next stretch, null for the last. Of rows at one
    instant the one with the largest tie holds. Rows without a time are left out.
    """
    own = W.partitionBy(key).orderBy(time)
    state = F.struct(*values)
    rows = rows.where(F.col(time).isNotNull()).groupBy(key, time).agg(F.max_by(state, F.struct(tie)).alias("_s"))
    rows = rows.withColumns({"_before": F.lag("_s").over(own), "_nth": F.row_number().over(own)})
    rows = rows.where((F.col("_nth") == 1) | ~F.col("_s").eqNullSafe(F.col("_before")))
    return rows.select(key, "_s.*", F.col(time).alias("valid_from"), F.lead(time).over(own).alias("valid_to"))


def as_of(asks: DataFrame, facts: DataFrame, key: str, time: str, values: list[str], tie: Column | None = None) -> DataFrame:
    """asks with the values that facts had for their key at their time, null before the key's first fact.

    Both sides are merged in one sort by key and time, in which each ask takes
    the last fact before it or at the same instant; of facts at one instant
    that with the largest tie. No pairs are made, so a key may have any number
    of facts and asks on both sides, and memory is that of one row. Asks and
    facts without a key meet; asks without a time find nothing.
    """
    taken = {c for c in asks.columns}
    name = {c: f"_fact_{c}" for c in values}
    order = F.lit(0) if tie is None else tie
    told = facts.where(F.col(time).isNotNull()).select(key, time, F.lit(0).alias("_kind"), order.alias("_tie"), F.struct(*(F.col(c).alias(name[c]) for c in values)).alias("_value"), F.lit(None).cast(asks.schema).alias("_ask"))
    asked = asks.select(key, time, F.lit(1).alias("_kind"), F.lit(None).cast(told.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(told.schema["_value"].dataType).alias("_value"), F.struct(*(F.col(f"`{c}`") for c in asks.columns)).alias("_ask"))
    before = W.partitionBy(key).orderBy(F.col(time).asc_nulls_first(), "_kind", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = told.unionByName(asked).withColumn("_found", F.last("_value", ignorenulls=True).over(before)).where("_kind = 1")
    return met.select(*(F.col(f"_ask.`{c}`").alias(c) for c in asks.columns), *(F.col(f"_found.{name[c]}").alias(c if c not in taken else name[c]) for c in values))
