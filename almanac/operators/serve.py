"""Read path: scans, visibility, collapse of series, date groups, slug lookup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.present import events_word
from ..functions.text import iso, series_key, slug
from .keyed import BUCKETS, KeyedTable


def upcoming(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Events from as_of on that are neither past nor cancelled; null flags and states drop out, as in SQL."""
    return events.where((F.col("date") >= F.lit(as_of)) & (F.col("is_past") == F.lit(False)) & (F.col("status") != "cancelled"))


def briefing_window(events: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Public upcoming events of as_of and `days` days more."""
    return upcoming(events, as_of).where((F.col("date") <= F.lit(as_of + dt.timedelta(days=days))) & (F.col("visibility") == "public"))


def is_visible(enabled_orgs: list[str]) -> Column:
    """Private events show only for an enabled organisation; anything else shows, null too."""
    private = F.col("visibility").eqNullSafe(F.lit("private"))
    org = F.col("org_slug")
    enabled = (org != "") & org.isin(enabled_orgs) if enabled_orgs else F.lit(False)
    return F.coalesce(~private | enabled, F.lit(False))


def toggle(enabled: list[str], org: str) -> list[str]:
    """The enabled organisations with org taken out, or put in at the end."""
    return [o for o in enabled if o != org] if org in enabled else [*enabled, org]


def visible(events: DataFrame, enabled_orgs: list[str] = (), category: str = "all", town: str = "all") -> DataFrame:
    events = events.where(is_visible(list(enabled_orgs)))
    if category != "all":
        events = events.where(F.col("category") == category)
    return events if town == "all" else events.where(F.col("town") == town)


def facets(events: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """(town, category, span, level, n, said): how many events each choice of the filters shows, 'all' where one isn't set.

    span is today, soon (the `days` days after it) or later. level has a bit for
    each filter that isn't set: 4 town, 2 category, 1 span. Events are counted
    once by all three; the cube is over those few counts.
    """
    day = F.lit(as_of)
    span = F.when(F.col("date") == day, "today").when(F.col("date") <= F.date_add(day, days), "soon").otherwise("later")
    counts = events.groupBy("town", "category", span.alias("span")).agg(F.count(F.lit(1)).alias("_n"))
    cube = counts.cube("town", "category", "span").agg(F.grouping_id("town", "category", "span").alias("level"), F.sum("_n").alias("n"))
    shown = lambda c, bit: F.when(F.col("level").bitwiseAND(bit) > 0, "all").otherwise(F.col(c)).alias(c)
    return cube.select(shown("town", 4), shown("category", 2), shown("span", 1), F.col("level").cast("long").alias("level"), "n", events_word(F.col("n")).alias("said"))


def order_key(*extra: Column) -> Column:
    """Date, then start time with null last, then id, as one comparable value."""
    return F.struct(F.col("date"), F.col("start_time").isNull().alias("late"), F.col("start_time"), F.col("id"), *extra)


def numbered(rows: DataFrame, by: str, name: str, first: Column | None = None, chars: int = 3) -> DataFrame:
    """rows with their 1-based place among those with the same `by`, in order of first (if any) and id.

    Rows are numbered within each `by`, first and begin of the id, and moved on by
    the number of rows that come before those; only such counts are summed up. So
    no task needs to hold a whole day: `chars` characters of the id split it. Nulls
    come first, and rows with a null in `by` are numbered together.
    """
    rows = rows.withColumns({"_first": F.lit(0) if first is None else first, "_begin": F.coalesce(F.substring("id", 1, chars), F.lit(""))})
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_first").alias("_f"), F.col("_begin").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_by").orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_by", "_f", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(W.partitionBy(by, "_first", "_begin").orderBy("id")))
    met = rows.join(counts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_first").eqNullSafe(F.col("_f")) & (F.col("_begin") == F.col("_b")))
    return met.withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_first", "_begin", "_by", "_f", "_b", "_before", "_in")


def with_ordinal(rows: DataFrame, name: str = "ord") -> DataFrame:
    """rows with their 1-based place by date, start time (null last) and id: numbered within each date, and moved on by the rows of the dates before."""
    days = rows.groupBy(F.col("date").alias("_date")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each date.
    days = days.select("_date", F.coalesce(F.sum("_n").over(W.orderBy("_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_days"))
    rows = numbered(rows, "date", "_nth", F.coalesce(F.col("start_time"), F.lit("~")))
    rows = rows.join(F.broadcast(days), F.col("date").eqNullSafe(F.col("_date")))
    return rows.withColumn(name, F.col("_days") + F.col("_nth")).drop("_nth", "_date", "_days")


def series_parts(events: DataFrame) -> DataFrame:
    """(_series, _artist, n, rep, k, last, first): what the events of each series and artist come to.

    An event counts (n, rep, k, last) in its first artist's part, or in the part without an
    artist if it has none; first is where the artist first appears. merge_parts() combines them.
    """
    key = order_key()
    rows = events.withColumn("_series", series_key(F.col("name"))).select("*", F.posexplode_outer("artists").alias("_i", "_artist"))
    once = F.coalesce(F.col("_i") == 0, F.lit(True))
    place = F.when(F.col("_i").isNotNull(), F.struct(key.alias("k"), F.col("_i").alias("i")))
    return rows.groupBy("_series", "_artist").agg(
        F.sum(once.cast("long")).alias("n"), F.min_by(F.when(once, F.struct(*events.columns)), F.when(once, key)).alias("rep"), F.min(F.when(once, key)).alias("k"),
        F.max("date").alias("last"), F.min(place).alias("first"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """One part for each series and artist, of parts of disjoint sets of events, in any order."""
    return parts.groupBy("_series", "_artist").agg(F.sum("n").alias("n"), F.min_by("rep", "k").alias("rep"), F.min("k").alias("k"), F.max("last").alias("last"), F.min("first").alias("first"))


def whole_series(parts: DataFrame) -> DataFrame:
    """The collapsed rows of merged parts; only a series' distinct artists meet in one row."""
    names = parts.schema["rep"].dataType.names
    seen = F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", F.col("_artist").alias("artist"))))
    groups = parts.groupBy("_series").agg(F.sum("n").alias("n"), F.min_by("rep", "k").alias("rep"), F.max("last").alias("last"), F.transform(F.array_sort(seen), lambda x: x["artist"]).alias("_artists"))
    artists = F.coalesce("_artists", F.array().cast("array<string>"))
    many = F.col("n") > 1
    changed = {"name": F.when(many, F.col("_series")).otherwise(F.col("rep.name")), "artists": F.when(many & (F.size(artists) > 0), artists).otherwise(F.col("rep.artists"))}
    kept = [changed.get(c, F.col(f"rep.{c}")).alias(c) for c in names]
    return groups.select(*kept, F.when(many, F.col("last")).alias("end_date"), F.when(many, F.col("n")).alias("day_count"), F.when(many, F.lit(True)).alias("is_collapsed"))


def collapse(events: DataFrame) -> DataFrame:
    """Events of one series become one row: the first one's, with end_date, day_count and all artists in order of appearance.

    A series of one row stays as it is, suffix and all. The order is a struct, so
    no global sort is needed. The events are read once: they are combined by
    series and artist, in each task and then by a shuffle, and those rows by
    series. So a series may hold any share of the table.
    """
    return whole_series(series_parts(events))


def date_groups(rows: DataFrame) -> DataFrame:
    """(date, group_index, n, first_id): a group for each date, in order."""
    groups = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", order_key()).alias("first_id"))
    return groups.withColumn("group_index", F.row_number().over(W.orderBy("date")).cast("long"))  # one row for each date


def with_slug(events: DataFrame) -> DataFrame:
    return events.withColumn("slug", slug(F.col("name"), iso(F.col("date")), F.col("town")))


def first_by_slug(events: DataFrame) -> DataFrame:
    """One event for each slug: the earliest date's, then the smallest id; n_events tells how many share it."""
    names = events.columns
    own = with_slug(events).groupBy("slug").agg(F.min_by(F.struct(*names), F.struct("date", "id")).alias("e"), F.count(F.lit(1)).alias("n_events"))
    return own.select("slug", "n_events", "e.*")


def index_by_slug(events: DataFrame, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """A table under path that leads from each slug to its event (first_by_slug), for lookups that don't scan the events.

    Later events go in by put(): a change of a few events rewrites their slugs' buckets.
    """
    rows = first_by_slug(events.select("id", "name", "date", "town")).select("slug", "id", "date", "n_events")
    table = KeyedTable(events.sparkSession, path, rows.schema, "slug", buckets)
    table.put(rows)
    return table


def find_by_slug(events: DataFrame, wanted: str) -> DataFrame:
    """The event a slug leads to, or no row."""
    return with_slug(events).where(F.col("slug") == wanted).orderBy("date", "id").limit(1)


def dangling_slugs(cards: DataFrame, events: DataFrame) -> DataFrame:
    """Cards whose slug belongs to no event."""
    return with_slug(cards).join(with_slug(events).select("slug"), "slug", "left_anti")
