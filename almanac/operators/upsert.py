"""Keyed three-way upsert with sequential semantics, as one join and one window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..functions.text import dedup_key, iso, strip_fence
from .keyed import BUCKETS, KeyedTable, staged
from .serve import numbered

#: Columns that a later row with the same key may change.
MUTABLE = ["description", "start_time", "end_time", "price", "event_url"]


def with_key(events: DataFrame) -> DataFrame:
    return events.withColumn("dedup_key", dedup_key(F.col("name"), iso(F.col("date")), F.col("town")))


def outcomes(store: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """batch with outcome (insert, update, unchanged), as if its rows were applied one by one in the order given.

    After a row, the store has that row's mutable values, so each row is compared
    with the one before it of the same key, and the first with the store. One
    shuffle by key serves the join and the window.
    """
    own = W.partitionBy("dedup_key").orderBy(*order)
    values = F.struct(*MUTABLE)
    held = store.select("dedup_key", values.alias("_held"), F.lit(True).alias("_hit"))
    rows = batch.join(held, "dedup_key", "left").withColumn("_nth", F.row_number().over(own)).withColumn("_last", F.lag(values).over(own))
    exists = (F.col("_nth") > 1) | F.coalesce("_hit", F.lit(False))
    before = F.when(F.col("_nth") > 1, F.col("_last")).otherwise(F.col("_held"))
    same = F.lit(True)
    for c in MUTABLE:
        same = same & before[c].eqNullSafe(F.col(c))
    return rows.withColumn("outcome", F.when(~exists, "insert").when(same, "unchanged").otherwise("update")).drop("_held", "_hit", "_nth", "_last")


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows were inserted, updated and unchanged."""
    count = lambda o: F.count(F.when(F.col("outcome") == o, F.lit(1)))
    return rows.groupBy(*by).agg(count("insert").alias("inserted"), count("update").alias("updated"), count("unchanged").alias("unchanged"))


def _ends(batch: DataFrame, fixed: list[str], order: list[str]) -> DataFrame:
    """(dedup_key, f, m): of each key the first row's fixed values and the last row's mutable ones."""
    key = F.struct(*order)
    return batch.groupBy("dedup_key").agg(F.min_by(F.struct(*fixed), key).alias("f"), F.max_by(F.struct(*MUTABLE), key).alias("m"))


def merge(store: DataFrame, batch: DataFrame, order: list[str], now: Column) -> DataFrame:
    """The store after the batch: new keys get the first row's fixed and the last row's mutable values, known keys the last row's mutable ones."""
    names = store.columns
    fixed = [c for c in names if c not in (*MUTABLE, "dedup_key", "last_scraped_at")]
    ends = _ends(batch, fixed, order)
    hit, new = F.col("m").isNotNull(), F.col("_known").isNull()
    both = store.withColumn("_known", F.lit(True)).join(ends, "dedup_key", "full_outer")
    value = {c: F.when(new, F.col(f"f.{c}")).otherwise(F.col(c)) for c in fixed} | {c: F.when(hit, F.col(f"m.{c}")).otherwise(F.col(c)) for c in MUTABLE}
    value |= {"dedup_key": F.col("dedup_key"), "last_scraped_at": F.when(hit, now).otherwise(F.col("last_scraped_at"))}
    return both.select(*(value[c].alias(c) for c in names))


class EventStore:
    """The event table under path, kept by key in two keyed tables: the events, and when each key was last seen.

    Most rows of a batch only say that an event was seen again. They rewrite
    buckets of the narrow table of times; buckets of events are rewritten only
    where an event is new or one of its mutable values changes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS):
        own = StructType([f for f in schema.fields if f.name != "last_scraped_at"])
        seen = StructType([f for f in schema.fields if f.name in ("dedup_key", "last_scraped_at")])
        self.names = schema.names
        self.events, self.seen = KeyedTable(spark, f"{path}/events", own, "dedup_key", buckets), KeyedTable(spark, f"{path}/seen", seen, "dedup_key", buckets)

    def read(self, version: int | None = None) -> DataFrame:
        """The store as merge() leaves it, as of a version; the newest by default."""
        both = self.events.read(version).join(self.seen.read(version).drop("bucket"), "dedup_key", "left")
        return both.select(*self.names)

    def changes(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """The event rows that are new or differ after the batch."""
        fixed = [c for c in self.events.schema.names if c not in (*MUTABLE, "dedup_key")]
        ends = staged(_ends(batch, fixed, order), "ends")
        held = self.events.read_touched(ends.select("dedup_key")).drop("bucket")
        both = ends.join(held.withColumn("_known", F.lit(True)), "dedup_key", "left")
        new, differs = F.col("_known").isNull(), F.lit(False)
        for c in MUTABLE:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"m.{c}"))
        both = both.where(new | differs)
        return both.select("dedup_key", *(F.when(new, F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in fixed), *(F.col(f"m.{c}").alias(c) for c in MUTABLE))

    def apply(self, batch: DataFrame, order: list[str], now: Column, version: int | None = None) -> tuple[list[int], list[int]]:
        """Merge the batch; the buckets written of events and of times. A version that is already there changes nothing.

        Both tables get the same version, the times last, so a batch that failed
        between them is completed when it is applied again.
        """
        version = self.seen.version() + 1 if version is None else version
        written = self.events.put(self.changes(batch, order), version) if version > self.events.version() else []
        if version <= self.seen.version():
            return written, []
        times = batch.groupBy("dedup_key").agg(F.max(now).alias("last_scraped_at"))
        return written, self.seen.put(times, version)

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest `keep` versions don't read; how many folders."""
        return len(self.events.vacuum(keep)) + len(self.seen.vacuum(keep))


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with the rows whose key it lacks."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert_by_key(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with the rows put in place of those that share their key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def config_values(config: DataFrame, *keys: str) -> DataFrame:
    """One row with a column for each key, null where it is missing or empty."""
    return config.where(F.col("key").isin(*keys)).agg(*(F.nullif(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("")).alias(k) for k in keys))


# From the design documents only; no code of the surveyed application does these.


def possibly_stale(events: DataFrame, as_of: dt.date, days: int = 14) -> DataFrame:
    """Events not seen for `days` days; they are marked, never deleted."""
    return events.where(F.col("last_scraped_at") < F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz"))


def crawl_recent(posts: DataFrame, as_of: dt.date, newest: int = 20, days: int = 60, by: str = "source_slug") -> DataFrame:
    """Each source's newest posts, without those older than `days` days."""
    recent = posts.where(F.col("date") >= F.lit(as_of - dt.timedelta(days=days)))
    return recent.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(F.desc("date"), "id"))).where(F.col("nth") <= newest)


def reconcile_visibility(events: DataFrame) -> DataFrame:
    """Per key: public if any row is, private if all known ones are."""
    return events.groupBy("dedup_key").agg(F.when(F.max((F.col("visibility") == "public").cast("int")) == 1, "public").otherwise("private").alias("visibility"))


def needs_importance() -> Column:
    """Whether an event is to be scored: a public one without an importance, or with one that no editor set."""
    return F.coalesce(F.col("visibility") == "public", F.lit(False)) & (F.col("importance").isNull() | ~F.coalesce("importance_override", F.lit(False)))


def scoring_batches(events: DataFrame, size: int = 10) -> DataFrame:
    """Public events that need an importance, in batches of `size`: numbered within the day, so no global sort is needed."""
    rows = numbered(events.where(needs_importance()), "date", "_nth")
    return rows.withColumn("batch", (F.floor((F.col("_nth") - 1) / size) + 1).cast("long")).drop("_nth")


def score_importance(events: DataFrame, classifier: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """events with importance, importance_score and importance_reason by a classifier.

    The classifier gets (id, name, venue_name, town, category, description) of the
    events that need a score and returns (id, reply), at most one row an id, with
    replies such as {"importance": "major", "score": 0.9, "reason": "..."}. Other
    events, and those whose reply isn't of this form, keep what they have.
    """
    asked = classifier(events.where(needs_importance()).select("id", "name", "venue_name", "town", "category", "description"))
    told = F.from_json(strip_fence(F.col("reply")), "importance string, score double, reason string")
    told = asked.select("id", told.alias("_told")).where(F.col("_told.importance").isin("major", "minor") & F.col("_told.score").between(0, 1))
    kept = {c: F.col(c) if c in events.columns else F.lit(None).cast(t) for c, t in (("importance_score", "double"), ("importance_reason", "string"))}
    hit = F.col("_told").isNotNull()
    value = lambda field, old: F.when(hit, F.col(f"_told.{field}")).otherwise(old)
    return events.join(told, "id", "left").withColumns({"importance": value("importance", F.col("importance")), "importance_score": value("score", kept["importance_score"]), "importance_reason": value("reason", kept["importance_reason"])}).drop("_told")
