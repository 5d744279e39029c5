"""Queries on the driver's tables and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .functions import present, text
from .operators import fuzzy, history, ingest, nearby, serve, upsert
from .operators.keyed import shared_folder, staged
from .operators.ordered import OrderedStore
from .operators.search import SearchIndex
from .operators.series import SeriesStore
from .plans import briefing, documents, freshness as fresh
from .sources import fetch
from .sources.listing import VENUES, listing
from .sources.pages import html_text, pages

AS_OF = dt.date(2024, 1, 15)
ORGS = ["org-3", "org-6"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


# --- SQL building blocks (DuckDB) -------------------------------------------------------------------------------------

WS = r"\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

LISTING_SQL = f"""
e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type || ' ' || user_id AS series FROM events),
n AS (SELECT *, series || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' - Day ' || (event_id % 3 + 1) WHEN 2 THEN ' (through day ' || k || ')' ELSE ' (Opening Day)' END AS name FROM e),
L AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date,
  CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%H:%M') END AS start_time,
  CASE WHEN event_id % 3 <> 0 THEN strftime(ts + INTERVAL 2 HOURS, '%H:%M') END AS end_time,
  series, name, CASE WHEN event_id % 11 <> 0 THEN 'About ' || name END AS description,
  {_list(dims.FILTER_TOWNS)}[user_id % 8 + 1] AS town, {_list(VENUES)}[user_id % 9 + 1] AS venue_name,
  CASE WHEN k % 2 <> 0 THEN k || ' Main St' END AS address,
  CASE event_type WHEN 'click' THEN 'live_music' WHEN 'view' THEN 'festival' WHEN 'signup' THEN 'civic' WHEN 'purchase' THEN 'resort'
    ELSE CASE WHEN user_id % 2 = 0 THEN 'lodge' ELSE 'other' END END AS category,
  CASE k % 3 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['Artist ' || k, 'Artist ' || (k % 10)] END AS artists,
  CASE WHEN k <> 99 THEN CASE k % 10 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'tentative' ELSE 'confirmed' END END AS status,
  CASE WHEN k <> 97 THEN k % 20 = 5 END AS is_past,
  CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 4 = 1 THEN 'Free' ELSE '$' || k END END AS price,
  CASE WHEN k <> 98 THEN CASE WHEN user_id % 6 = 0 THEN 'private' ELSE 'public' END END AS visibility,
  CASE WHEN user_id % 5 <> 0 THEN 'org-' || (user_id % 9) END AS org_slug,
  k = 42 AS editor_pick, ts AS last_scraped_at, 'https://tickets.example/' || event_id AS event_url, event_id, k FROM n)
"""
UP_SQL = LISTING_SQL + ", U AS (SELECT * FROM L WHERE date >= DATE '2024-01-15' AND is_past = false AND status <> 'cancelled')"
VISIBLE_SQL = UP_SQL + ", V AS (SELECT * FROM U WHERE visibility IS DISTINCT FROM 'private' OR org_slug IN ('org-3', 'org-6'))"
ORDER_SQL = "date, start_time NULLS LAST, id"
_day = lambda c: f"strftime({c}, '%Y-%m-%d')"
_trim = lambda c: f"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def _series_sql(c: str) -> str:
    for p in (rf"[{WS}]*-[{WS}]*Day[{WS}]*\d+", rf"[{WS}]*\(through[^)]*\)", rf"[{WS}]*\(Opening Day\)"):
        c = f"regexp_replace({c}, '{p}$', '', 'i')"
    return _trim(c)


def _slug_sql(name: str = "name", date: str = "date", town: str = "town") -> str:
    c = rf"regexp_replace(lower({name} || ' ' || {_day(date)} || ' ' || {town}), '[^\w{WS}-]', '', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '[{WS}]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


def _key_sql() -> str:
    return f"substr(sha256(lower({_trim('name')}) || '|' || {_day('date')} || '|' || lower({_trim('town')})), 1, 32)"


def _time_sql(c: str) -> str:
    h = rf"TRY_CAST(regexp_extract({c}, '^\s*(\d+)', 1) AS INTEGER)"
    return f"(CASE WHEN {c} <> '' THEN (CASE WHEN {h} > 12 THEN {h} - 12 WHEN {h} = 0 THEN 12 ELSE {h} END) || ':' || string_split({c}, ':')[2] || CASE WHEN {h} >= 12 THEN ' PM' ELSE ' AM' END END)"


def _label_sql(d: str) -> str:
    return (
        f"CASE WHEN {d} = DATE '2024-01-15' THEN 'Today — ' || strftime({d}, '%B %-d') WHEN {d} = DATE '2024-01-16' THEN 'Tomorrow — ' || strftime({d}, '%B %-d') "
        f"WHEN {d} - CAST(dayofweek({d}) AS INTEGER) = DATE '2024-01-15' - CAST(dayofweek(DATE '2024-01-15') AS INTEGER) THEN 'This ' || strftime({d}, '%A') || ' — ' || strftime({d}, '%B %-d') "
        f"ELSE strftime({d}, '%A, %B %-d, %Y') END"
    )


COLLAPSE_SQL = (
    VISIBLE_SQL
    + f""",
s AS (SELECT *, {_series_sql("name")} AS base, count(*) OVER (PARTITION BY {_series_sql("name")}) AS n,
        row_number() OVER (PARTITION BY {_series_sql("name")} ORDER BY {ORDER_SQL}) AS rn FROM V),
a AS (SELECT base, string_agg(x, ', ' ORDER BY f) AS all_artists FROM (
        SELECT base, x, min((rn, i)) AS f FROM (SELECT base, rn, unnest(artists) AS x, unnest(range(len(artists))) AS i FROM s) GROUP BY base, x) GROUP BY base),
C AS (SELECT s.id, CASE WHEN n > 1 THEN s.base ELSE name END AS name, date, start_time, end_time, town, venue_name, category, description, price, visibility, org_slug,
        CASE WHEN n > 1 AND all_artists IS NOT NULL THEN all_artists ELSE array_to_string(artists, ', ') END AS artists, artists IS NULL AS no_artists,
        CASE WHEN n > 1 THEN (SELECT max(date) FROM s z WHERE z.base = s.base) END AS end_date,
        CASE WHEN n > 1 THEN n END AS day_count, CASE WHEN n > 1 THEN true END AS is_collapsed
      FROM s LEFT JOIN a ON s.base = a.base WHERE rn = 1)
"""
)


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return serve.visible(serve.upcoming(listing(spark, d), AS_OF), ORGS)


# --- Listing ----------------------------------------------------------------------------------------------------------

_SHOWN = ["id", "name", "description", "start_time", "end_time", "venue_name", "town", "address", "category", "price", "visibility", "org_slug", "editor_pick"]
_shown_sql = ", ".join(_SHOWN)


@_query("upcoming_listing", f"WITH {UP_SQL} SELECT row_number() OVER (ORDER BY {ORDER_SQL}) AS ord, {_shown_sql}, {_day('date')} AS date, array_to_string(artists, ', ') AS artists FROM U")
def upcoming_listing(spark, d):
    rows = serve.with_ordinal(serve.upcoming(listing(spark, d), AS_OF))
    return rows.select("ord", *_SHOWN, text.iso(F.col("date")).alias("date"), F.array_join("artists", ", ").alias("artists"))


@_query("detail_scan", f"WITH {UP_SQL} SELECT row_number() OVER (PARTITION BY date ORDER BY id) AS nth, id, {_day('date')} AS date, name FROM U")
def detail_scan(spark, d):
    rows = serve.numbered(serve.upcoming(listing(spark, d), AS_OF), "date", "nth")
    return rows.select("nth", "id", text.iso(F.col("date")).alias("date"), "name")


@_query("visible_default", f"WITH {UP_SQL} SELECT id, visibility, org_slug FROM U WHERE visibility IS DISTINCT FROM 'private'")
def visible_default(spark, d):
    return serve.visible(serve.upcoming(listing(spark, d), AS_OF)).select("id", "visibility", "org_slug")


@_query("visible_with_orgs", f"WITH {VISIBLE_SQL} SELECT id, visibility, org_slug FROM V")
def visible_with_orgs(spark, d):
    return _visible(spark, d).select("id", "visibility", "org_slug")


@_query("toggled_orgs", f"WITH {VISIBLE_SQL} SELECT id, org_slug FROM V WHERE (visibility = 'private' AND org_slug = '{ORGS[0]}') IS NOT TRUE")
def toggled_orgs(spark, d):
    twice = serve.toggle(serve.toggle(ORGS, ORGS[-1]), ORGS[-1])  # out, and in again
    return serve.visible(serve.upcoming(listing(spark, d), AS_OF), serve.toggle(twice, ORGS[0])).select("id", "org_slug")


@_query(
    "filter_category_town",
    f"WITH {VISIBLE_SQL} SELECT category, town, count(*) AS n, count(*) || CASE WHEN count(*) = 1 THEN ' event' ELSE ' events' END AS said FROM V WHERE category = 'festival' AND town = 'Arnold' GROUP BY ALL",
)
def filter_category_town(spark, d):
    rows = serve.visible(serve.upcoming(listing(spark, d), AS_OF), ORGS, "festival", "Arnold")
    return rows.groupBy("category", "town").agg(F.count(F.lit(1)).alias("n")).withColumn("said", present.events_word(F.col("n")))


@_query(
    "facet_counts",
    f"WITH {VISIBLE_SQL}, w AS (SELECT town, category, CASE WHEN date = DATE '2024-01-15' THEN 'today' WHEN date <= DATE '2024-01-22' THEN 'soon' ELSE 'later' END AS span FROM V) "
    "SELECT CASE WHEN GROUPING(town) = 1 THEN 'all' ELSE town END AS town, CASE WHEN GROUPING(category) = 1 THEN 'all' ELSE category END AS category, CASE WHEN GROUPING(span) = 1 THEN 'all' ELSE span END AS span, "
    "CAST(GROUPING(town, category, span) AS BIGINT) AS level, count(*) AS n, count(*) || CASE WHEN count(*) = 1 THEN ' event' ELSE ' events' END AS said FROM w GROUP BY CUBE (town, category, span)",
)
def facet_counts(spark, d):
    """The count that every choice of town, category and time shows."""
    return serve.facets(_visible(spark, d), AS_OF)


@_query("series_key", f"WITH {LISTING_SQL} SELECT id, name, {_series_sql('name')} AS series_key FROM L")
def series_key(spark, d):
    return listing(spark, d).select("id", "name", text.series_key(F.col("name")).alias("series_key"))


_CARD = ["id", "name", "start_time", "end_time", "town", "venue_name", "category", "description", "price", "visibility", "org_slug"]
_FLAT_ARTISTS = "coalesce(CASE WHEN no_artists AND artists IS NULL THEN '(none)' ELSE artists END, '')"


@_query(
    "collapsed_listing",
    f"WITH {COLLAPSE_SQL} SELECT row_number() OVER (ORDER BY {ORDER_SQL}) AS ord, {', '.join(_CARD)}, {_day('date')} AS date, {_day('end_date')} AS end_date, day_count, is_collapsed, coalesce(artists, '') AS artists FROM C",
)
def collapsed_listing(spark, d):
    rows = serve.with_ordinal(serve.collapse(_visible(spark, d)))
    return rows.select("ord", *_CARD, text.iso(F.col("date")).alias("date"), text.iso(F.col("end_date")).alias("end_date"), "day_count", "is_collapsed", F.coalesce(F.array_join("artists", ", "), F.lit("")).alias("artists"))


@_query("collapsed_by_batches", f"WITH {COLLAPSE_SQL} SELECT {', '.join(_CARD)}, {_day('date')} AS date, {_day('end_date')} AS end_date, day_count, is_collapsed, coalesce(artists, '') AS artists FROM C")
def collapsed_by_batches(spark, d):
    """The same listing from a store that gets the events in three batches out of order, the last with all events of the first again."""
    rows = _visible(spark, d)
    turn = F.col("event_id") % 3
    store = SeriesStore(spark, shared_folder(spark, "series"), rows.schema, 16)
    for batch in (turn == 2, turn == 0, turn > 0):
        store.apply(rows.where(batch))
    return store.read().select(*_CARD, text.iso(F.col("date")).alias("date"), text.iso(F.col("end_date")).alias("end_date"), "day_count", "is_collapsed", F.coalesce(F.array_join("artists", ", "), F.lit("")).alias("artists"))


@_query(
    "date_groups",
    f"WITH {COLLAPSE_SQL} SELECT dense_rank() OVER (ORDER BY date) AS group_index, {_day('date')} AS date, {_label_sql('date')} AS label, count(*) AS n, arg_min(id, (start_time IS NULL, coalesce(start_time, ''), id)) AS first_id FROM C GROUP BY date",
)
def date_groups(spark, d):
    rows = serve.date_groups(serve.collapse(_visible(spark, d)))
    return rows.select("group_index", text.iso(F.col("date")).alias("date"), present.group_label(F.col("date"), F.lit(AS_OF)).alias("label"), "n", "first_id")


@_query("up_next", f"WITH {COLLAPSE_SQL} SELECT {_day('date')} AS date, id AS first_id FROM C ORDER BY {ORDER_SQL} LIMIT 1")
def up_next(spark, d):
    return documents.up_next(serve.date_groups(serve.collapse(_visible(spark, d)))).select(text.iso(F.col("date")).alias("date"), "first_id")


_IMAGE_SQL = "CASE " + " ".join(
    "WHEN (" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")" + (f" AND category = '{only}'" if only else "") + f" THEN '{path}'" for c, words, only, path in dims.IMAGE_RULES
) + " ELSE '/images/' || category || '.jpg' END"
_map_sql = lambda c, m: f"CASE {c} " + " ".join("WHEN '" + k + "' THEN '" + v.replace("'", "''") + "'" for k, v in m.items()) + " END"


@_query(
    "event_cards",
    f"""WITH {COLLAPSE_SQL} SELECT id, {_slug_sql()} AS slug, strftime(date, '%a') AS weekday,
  strftime(date, '%b %-d') || coalesce('–' || CASE WHEN strftime(date, '%b') = strftime(end_date, '%b') THEN strftime(end_date, '%-d') ELSE strftime(end_date, '%b %-d') END, '') AS dates,
  day_count || 'd' AS badge, {_time_sql('start_time')} || coalesce(' - ' || {_time_sql('end_time')}, '') AS times,
  {_map_sql('category', dims.CATEGORY_LABELS)} AS label, {_map_sql('category', dims.CATEGORY_COLORS)} AS color, {_IMAGE_SQL} AS image,
  coalesce({_map_sql('org_slug', dims.ORG_LABELS)}, org_slug) AS org FROM C""",
)
def event_cards(spark, d):
    rows = serve.with_slug(serve.collapse(_visible(spark, d)))
    c = F.col
    return rows.select(
        "id", "slug", F.date_format("date", "EEE").alias("weekday"), present.date_badge(c("date"), c("end_date")).alias("dates"), F.concat(c("day_count").cast("string"), F.lit("d")).alias("badge"),
        text.time_range(c("start_time"), c("end_time"), " - ").alias("times"), present.category_label(c("category")).alias("label"), present.category_color(c("category")).alias("color"),
        present.image(c("name"), c("venue_name"), c("category")).alias("image"), present.org_label(c("org_slug")).alias("org"),
    )


@_query("event_slugs", f"WITH {UP_SQL} SELECT id, {_slug_sql()} AS slug FROM U")
def event_slugs(spark, d):
    return serve.with_slug(serve.upcoming(listing(spark, d), AS_OF)).select("id", "slug")


@_query(
    "slug_lookup",
    f"WITH {UP_SQL}, s AS (SELECT *, {_slug_sql()} AS slug FROM U) SELECT slug, arg_min(id, (date, id)) AS id, {_day('min(date)')} AS date, count(*) AS n_events FROM s GROUP BY slug",
)
def slug_lookup(spark, d):
    return serve.first_by_slug(serve.upcoming(listing(spark, d), AS_OF)).select("slug", "id", text.iso(F.col("date")).alias("date"), "n_events")


_REQUEST_SQL = "a AS (SELECT doc_id, slug FROM documents LEFT JOIN (SELECT event_id, {} AS slug FROM L) ON event_id = doc_id)"


@_query(
    "slug_index_lookup",
    f"WITH {UP_SQL}, {_REQUEST_SQL.format(_slug_sql())}, s AS (SELECT *, {_slug_sql()} AS slug FROM U), f AS (SELECT slug, arg_min(id, (date, id)) AS id, {_day('min(date)')} AS date, count(*) AS n_events FROM s GROUP BY slug) "
    "SELECT doc_id, a.slug, id, date, n_events FROM a LEFT JOIN f ON a.slug = f.slug",
)
def slug_index_lookup(spark, d):
    """Pages that readers ask for by slug: request n is for event n of the listing, past events' pages (not found) too."""
    rows = listing(spark, d)
    asked = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    known = rows.join(asked.select(F.col("doc_id").alias("event_id")), "event_id", "left_semi")  # only these need a slug
    asked = asked.join(serve.with_slug(known).select(F.col("event_id").alias("doc_id"), "slug"), "doc_id", "left")
    index = serve.index_by_slug(serve.upcoming(rows, AS_OF), shared_folder(spark, "slugs"), 16)
    return index.lookup(staged(asked, "asked")).select("doc_id", "slug", "id", text.iso(F.col("date")).alias("date"), "n_events")


@_query("slug_collisions", f"WITH {UP_SQL}, s AS (SELECT *, {_slug_sql()} AS slug FROM U) SELECT slug, arg_min(id, (date, id)) AS id, count(*) AS n_events FROM s GROUP BY slug HAVING count(*) > 1")
def slug_collisions(spark, d):
    return serve.first_by_slug(serve.upcoming(listing(spark, d), AS_OF)).where("n_events > 1").select("slug", "id", "n_events")


@_query("dangling_card_slugs", f"WITH {COLLAPSE_SQL} SELECT id, {_slug_sql()} AS slug FROM C WHERE {_slug_sql()} NOT IN (SELECT {_slug_sql()} FROM U)")
def dangling_card_slugs(spark, d):
    return serve.dangling_slugs(serve.collapse(_visible(spark, d)), serve.upcoming(listing(spark, d), AS_OF)).select("id", "slug")


_TOWN_SQL = ", ".join("('" + t[0] + f"', {t[1]}, '" + t[3].replace("'", "''") + f"', {t[4]}, {t[5]})" for t in dims.TOWNS)


@_query(
    "town_context",
    f"WITH {UP_SQL}, t(name, elevation, drive_text, lat, lng) AS (VALUES {_TOWN_SQL}) SELECT id, town, format('{{:,}}', elevation) || ' ft' AS elevation, drive_text, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM U LEFT JOIN t ON t.name = U.town",
)
def town_context(spark, d):
    t = F.broadcast(dims.towns(spark).withColumnRenamed("name", "town"))  # eight rows
    rows = serve.upcoming(listing(spark, d), AS_OF).select("id", "town").join(t, "town", "left")
    placed = (F.col("lat") != 0) & (F.col("lng") != 0)
    return rows.select("id", "town", present.feet(F.col("elevation")).alias("elevation"), "drive_text", F.when(placed, F.col("lat")).alias("lat"), F.when(placed, F.col("lng")).alias("lng"))


#: An event's place: its town's, moved by up to 0.05 degrees.
_PLACE_SQL = f"t(name, elevation, drive_text, lat, lng) AS (VALUES {_TOWN_SQL}), p AS (SELECT U.*, CAST(lat AS DOUBLE) + CAST(k - 50 AS DOUBLE) / 1000 AS lat, CAST(lng AS DOUBLE) + CAST(event_id % 101 - 50 AS DOUBLE) / 1000 AS lng FROM U JOIN t ON t.name = U.town)"
_FAR_SQL = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - t.lat) / 2), 2) + cos(radians(CAST(t.lat AS DOUBLE))) * cos(radians(p.lat)) * pow(sin(radians(p.lng - t.lng) / 2), 2))))"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    t = F.broadcast(dims.towns(spark).select(F.col("name").alias("town"), "lat", "lng"))  # eight rows
    rows = serve.upcoming(listing(spark, d), AS_OF).select("id", "town", "event_id", "k").join(t, "town")
    return rows.select("id", "town", (F.col("lat") + (F.col("k") - 50).cast("double") / 1000).alias("lat"), (F.col("lng") + (F.col("event_id") % 101 - 50).cast("double") / 1000).alias("lng"))


@_query("events_near_towns", f"WITH {UP_SQL}, {_PLACE_SQL}, f AS (SELECT t.name AS town, p.id, {_FAR_SQL} AS km FROM t, p) SELECT town, id, CAST(round(km * 1000) AS BIGINT) AS metres FROM f WHERE km <= 8")
def events_near_towns(spark, d):
    """Events to come within eight kilometres of each town."""
    found = nearby.within(dims.towns(spark), _placed(spark, d), 8.0)
    return found.select(F.col("ask.name").alias("town"), F.col("place.id").alias("id"), F.round(F.col("km") * 1000).cast("long").alias("metres"))


@_query(
    "nearest_towns",
    f"WITH {UP_SQL}, {_PLACE_SQL}, f AS (SELECT t.name AS nearest, p.id, {_FAR_SQL} AS km FROM t, p) SELECT id, arg_min(nearest, (km, nearest)) AS nearest, CAST(round(min(km) * 1000) AS BIGINT) AS metres FROM f WHERE km <= 20 GROUP BY id",
)
def nearest_towns(spark, d):
    """Each event's nearest town within twenty kilometres, which need not be its own."""
    found = nearby.nearest(_placed(spark, d), dims.towns(spark), 20.0, "id", "name")
    return found.select("id", F.col("place.name").alias("nearest"), F.round(F.col("km") * 1000).cast("long").alias("metres"))


@_query("directions", f"WITH {UP_SQL} SELECT id, replace(replace(coalesce(address, venue_name) || ', ' || town || ', CA', ' ', '%20'), ',', '%2C') AS place FROM U")
def directions(spark, d):
    return serve.upcoming(listing(spark, d), AS_OF).select("id", present.directions(F.col("address"), F.col("venue_name"), F.col("town")).alias("place"))


@_query("dedup_keys", f"WITH {LISTING_SQL} SELECT id, {_key_sql()} AS dedup_key FROM L")
def dedup_keys(spark, d):
    return upsert.with_key(listing(spark, d)).select("id", "dedup_key")


# --- Upsert -----------------------------------------------------------------------------------------------------------

_M = upsert.MUTABLE
KEYED_SQL = LISTING_SQL + f""",
  K AS (SELECT *, {_key_sql()} AS dedup_key FROM L),
  S AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY event_id) AS rn FROM K WHERE event_id % 2 = 0) WHERE rn = 1),
  B AS (SELECT 1 AS source_ord, event_id AS row_ord, id, name, date, town, dedup_key, description, start_time, end_time, CASE WHEN k % 5 = 0 THEN '$' || (k + 1) ELSE price END AS price, event_url FROM S
        UNION ALL SELECT 2, event_id, id, name, date, town, dedup_key, description, start_time, end_time, price, event_url FROM K WHERE event_id % 2 = 1
        UNION ALL SELECT 3, event_id, id, name, date, town, dedup_key, description, start_time, end_time, price, event_url FROM K WHERE event_id % 2 = 1 AND event_id % 10 = 1),
  O AS (SELECT B.*, row_number() OVER w AS nth, {", ".join(f"lag(B.{c}) OVER w AS p_{c}" for c in _M)}, {", ".join(f"S.{c} AS h_{c}" for c in _M)}, S.dedup_key IS NOT NULL AS hit
        FROM B LEFT JOIN S ON B.dedup_key = S.dedup_key WINDOW w AS (PARTITION BY B.dedup_key ORDER BY B.source_ord, B.row_ord)),
  R AS (SELECT *, CASE WHEN nth = 1 AND NOT hit THEN 'insert' WHEN {" AND ".join(f"(CASE WHEN nth > 1 THEN p_{c} ELSE h_{c} END) IS NOT DISTINCT FROM {c}" for c in _M)} THEN 'unchanged' ELSE 'update' END AS outcome FROM O)
"""
_STORE = ["id", "name", "date", "town", "venue_name", "category", *_M, "dedup_key", "last_scraped_at"]


def _batches(spark, d) -> tuple[DataFrame, DataFrame]:
    """A store of the even events' keys, and batches with changes, new keys and repeats."""
    rows = upsert.with_key(listing(spark, d)).select("event_id", "k", *_STORE)
    names = [c for c in rows.columns if c != "dedup_key"]
    even = rows.where("event_id % 2 = 0").groupBy("dedup_key").agg(F.min_by(F.struct(*names), "event_id").alias("e")).select("dedup_key", "e.*")
    odd = rows.where("event_id % 2 = 1")
    changed = even.withColumn("price", F.when(F.col("k") % 5 == 0, F.concat(F.lit("$"), (F.col("k") + 1).cast("string"))).otherwise(F.col("price")))
    parts = [changed.withColumn("source_ord", F.lit(1)), odd.withColumn("source_ord", F.lit(2)), odd.where("event_id % 10 = 1").withColumn("source_ord", F.lit(3))]
    batch = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("row_ord", F.col("event_id"))
    return even, batch


_ORDER = ["source_ord", "row_ord"]


@_query("upsert_outcomes", f"WITH {KEYED_SQL} SELECT source_ord, row_ord, dedup_key, price, outcome FROM R")
def upsert_outcomes(spark, d):
    return upsert.outcomes(*_batches(spark, d), _ORDER).select("source_ord", "row_ord", "dedup_key", "price", "outcome")


@_query("upsert_counters", f"WITH {KEYED_SQL} SELECT source_ord, count(*) FILTER (outcome = 'insert') AS inserted, count(*) FILTER (outcome = 'update') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged FROM R GROUP BY source_ord")
def upsert_counters(spark, d):
    return upsert.counters(upsert.outcomes(*_batches(spark, d), _ORDER), "source_ord")


@_query(
    "upsert_final_state",
    f"""WITH {KEYED_SQL}, ends AS (SELECT dedup_key, arg_min(id, (source_ord, row_ord)) AS id, arg_min(name, (source_ord, row_ord)) AS name, {", ".join(f"arg_max(CASE WHEN {c} IS NULL THEN {{'v': NULL::VARCHAR}} ELSE {{'v': {c}}} END, (source_ord, row_ord)).v AS {c}" for c in _M)} FROM B GROUP BY dedup_key)
SELECT coalesce(S.id, e.id) AS id, coalesce(S.name, e.name) AS name, coalesce(S.dedup_key, e.dedup_key) AS dedup_key, {", ".join(f"CASE WHEN e.dedup_key IS NOT NULL THEN e.{c} ELSE S.{c} END AS {c}" for c in _M)},
  e.dedup_key IS NOT NULL AS touched FROM S FULL OUTER JOIN ends e ON S.dedup_key = e.dedup_key""",
)
def upsert_final_state(spark, d):
    store, batch = _batches(spark, d)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    done = upsert.merge(store.select(*_STORE), batch, _ORDER, now)
    return done.select("id", "name", "dedup_key", *_M, (F.col("last_scraped_at") == now).alias("touched"))


@_query("upsert_idempotent", f"WITH {KEYED_SQL} SELECT CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS updated, count(*) AS unchanged FROM S")
def upsert_idempotent(spark, d):
    store, _ = _batches(spark, d)
    again = store.withColumns({"source_ord": F.lit(1), "row_ord": F.col("event_id")})
    return upsert.counters(upsert.outcomes(upsert.merge(store.select(*_STORE), again, _ORDER, F.col("last_scraped_at")), again, _ORDER))


_STORE_BUCKETS = 16
_BUCKET_SQL = f"CAST(('0x' || substr(md5({{}}), 1, 7)) AS INTEGER) % {_STORE_BUCKETS}"


def _stored(spark, d):
    """An event store of the even events' keys after the three sources' batches, each a version of its own; and what each wrote."""
    store, batch = _batches(spark, d)
    store = staged(store, "held")
    # Scraped batches lie in files.
    path = shared_folder(spark, "batches")
    batch.select("source_ord", "row_ord", *_STORE).write.parquet(path)
    batch = spark.read.parquet(path)
    held = upsert.EventStore(spark, shared_folder(spark, "store"), store.select(*_STORE).schema, _STORE_BUCKETS)
    held.events.put(store.select(*_STORE), 0)
    held.seen.put(store.select("dedup_key", "last_scraped_at"), 0)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    wrote = [held.apply(batch.where(F.col("source_ord") == k), _ORDER, now, k) for k in (1, 2, 3)]
    return held, now, wrote


@_query("store_state", SQL["upsert_final_state"])
def store_state(spark, d):
    held, now, _ = _stored(spark, d)
    return held.read().select("id", "name", "dedup_key", *_M, (F.col("last_scraped_at") == now).alias("touched"))


@_query(
    "store_rewrites",
    f"""WITH {KEYED_SQL}, z AS (SELECT source_ord, dedup_key, {", ".join(f"arg_max(CASE WHEN {c} IS NULL THEN {{'v': NULL::VARCHAR}} ELSE {{'v': {c}}} END, row_ord).v AS {c}" for c in _M)} FROM B GROUP BY ALL),
  y AS (SELECT 0 AS source_ord, dedup_key, {", ".join(_M)} FROM S UNION ALL SELECT source_ord, dedup_key, {", ".join(_M)} FROM z),
  p AS (SELECT *, row_number() OVER w AS nth, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in _M)} FROM y WINDOW w AS (PARTITION BY dedup_key ORDER BY source_ord)),
  t AS (SELECT *, {_BUCKET_SQL.format("dedup_key")} AS b, nth = 1 OR NOT ({" AND ".join(f"{c} IS NOT DISTINCT FROM p_{c}" for c in _M)}) AS differs FROM p WHERE source_ord > 0)
SELECT source_ord, count(DISTINCT b) FILTER (differs) AS event_buckets, count(DISTINCT b) AS time_buckets FROM t GROUP BY source_ord""",
)
def store_rewrites(spark, d):
    """How many of the store's buckets each batch rewrites."""
    _, _, wrote = _stored(spark, d)
    return spark.createDataFrame([(k, len(e), len(t)) for k, (e, t) in enumerate(wrote, 1)], "source_ord int, event_buckets long, time_buckets long")


def _config(spark):
    return spark.createDataFrame([("greeting", "Welcome"), ("weekly_briefing", "old"), ("empty", "")], "key string, value string")


# Orgs and settings as tables that come from the events.

_ORGS_SQL = "SELECT org_slug AS slug, arg_min(venue_name, event_id) AS display_name FROM L WHERE org_slug IS NOT NULL {} GROUP BY org_slug"


def _org_table(spark, d, where: str = "true") -> DataFrame:
    """(slug, display_name): each organisation of the events, by the name of the venue of its first one."""
    return listing(spark, d).where("org_slug IS NOT NULL").where(where).groupBy(F.col("org_slug").alias("slug")).agg(F.min_by("venue_name", "event_id").alias("display_name"))


@_query("org_list", f"WITH {LISTING_SQL}, o AS ({_ORGS_SQL.format('')}) SELECT row_number() OVER (ORDER BY display_name, slug) AS ord, slug, display_name FROM o")
def org_list(spark, d):
    from pyspark.sql import Window as W

    return _org_table(spark, d).select(F.row_number().over(W.orderBy("display_name", "slug")).cast("long").alias("ord"), "slug", "display_name")  # one row for each organisation


@_query(
    "seed_orgs",
    f"WITH {LISTING_SQL}, h AS ({_ORGS_SQL.format("AND category = 'civic'")}), o AS ({_ORGS_SQL.format('')}) SELECT o.slug, coalesce(h.display_name || ' (kept)', o.display_name) AS display_name FROM o LEFT JOIN h ON h.slug = o.slug",
)
def seed_orgs(spark, d):
    """Organisations of civic events are there already, under a name of their own; the seeds of all events add the others."""
    held = _org_table(spark, d, "category = 'civic'").withColumn("display_name", F.concat("display_name", F.lit(" (kept)")))
    return upsert.insert_missing(held, _org_table(spark, d), "slug")


def _settings(spark, d) -> DataFrame:
    """(key, value): a greeting for each town with its number of events, an old briefing and an empty setting."""
    rows = listing(spark, d).groupBy("town").agg(F.count(F.lit(1)).alias("n"))
    towns = rows.select(F.concat(F.lit("greeting_"), F.lower(F.replace("town", F.lit(" "), F.lit("_")))).alias("key"), F.concat("n", F.lit(" events in "), "town").alias("value"))
    last = listing(spark, d).agg(F.max("name").alias("value"))
    return towns.unionByName(last.select(F.lit("weekly_briefing").alias("key"), "value")).unionByName(last.select(F.lit("empty").alias("key"), F.lit("").alias("value")))


_SETTINGS_SQL = """c AS (SELECT 'greeting_' || lower(replace(town, ' ', '_')) AS key, count(*) || ' events in ' || town AS value FROM L GROUP BY town UNION ALL SELECT 'weekly_briefing', max(name) FROM L UNION ALL SELECT 'empty', '')"""


@_query("config_upsert", f"WITH {LISTING_SQL.strip()}, {_SETTINGS_SQL}, put AS (SELECT 'weekly_briefing' AS key, min(name) AS value FROM L UNION ALL SELECT 'weekly_briefing_date', {_day('max(date)')} FROM L) SELECT * FROM put UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM put)")
def config_upsert(spark, d):
    rows = listing(spark, d).agg(F.min("name").alias("a"), text.iso(F.max("date")).alias("b"))
    new = rows.select(F.lit("weekly_briefing").alias("key"), F.col("a").alias("value")).unionByName(rows.select(F.lit("weekly_briefing_date").alias("key"), F.col("b").alias("value")))
    return upsert.upsert_by_key(_settings(spark, d), new, "key")


@_query("config_lookup", f"WITH {LISTING_SQL.strip()}, {_SETTINGS_SQL} SELECT (SELECT value FROM c WHERE key = 'greeting_murphys') AS greeting_murphys, (SELECT value FROM c WHERE key = 'weekly_briefing') AS weekly_briefing, CAST(NULL AS VARCHAR) AS weekly_briefing_date, CAST(NULL AS VARCHAR) AS empty")
def config_lookup(spark, d):
    return upsert.config_values(_settings(spark, d), "greeting_murphys", "weekly_briefing", "weekly_briefing_date", "empty")


# --- Ingest -----------------------------------------------------------------------------------------------------------

_GATE_SQL = "CASE WHEN doc_id % 13 = 0 THEN 'fetch_failed' WHEN length(coalesce(text, '')) < 100 THEN 'too_short' WHEN contains(lower(text), '404') OR contains(lower(text), 'page not found') THEN 'not_found' ELSE 'pass' END"


def _gated(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    return docs.withColumn("gate_reason", ingest.gate_reason(F.col("doc_id") % 13 != 0, F.col("text")))


@_query("page_gate", f"SELECT doc_id, {_GATE_SQL} AS gate_reason FROM documents")
def page_gate(spark, d):
    return _gated(spark, d).select("doc_id", "gate_reason")


@_query("page_gate_counts", f"SELECT source, {_GATE_SQL} AS gate_reason, count(*) AS n FROM documents GROUP BY ALL")
def page_gate_counts(spark, d):
    return _gated(spark, d).groupBy("source", "gate_reason").agg(F.count(F.lit(1)).alias("n"))


def _html_sql() -> str:
    c = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g')"
    c = rf"regexp_replace({c}, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    c = rf"regexp_replace({c}, '[ \t]+', ' ', 'g')"
    return rf"trim(regexp_replace({c}, '\s*\n\s*', chr(10), 'g'), ' ')"


@_query("page_text", f"SELECT page_id, length({_html_sql()}) AS n_chars, sha256({_html_sql()}) AS text_sha256 FROM pages")
def page_text(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", html_text(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@_query(
    "page_extraction",
    f"WITH {LISTING_SQL}, p AS (SELECT page_id FROM pages WHERE length({_html_sql()}) >= 100 AND NOT contains(lower({_html_sql()}), '404') AND NOT contains(lower({_html_sql()}), 'page not found')), "
    "told AS (SELECT CAST(id AS BIGINT) // 5 AS page_id, name, CAST(CAST(date AS DATE) AS VARCHAR) AS date, town FROM L) SELECT page_id, name, date, town FROM told JOIN p USING (page_id)",
)
def page_extraction(spark, d):
    # Recorded replies: five events of the listing for each page.
    record = F.struct("name", text.iso(F.col("date")).alias("date"), "town")
    replies = listing(spark, d).groupBy(F.expr("CAST(id AS BIGINT) DIV 5").alias("page_id")).agg(F.to_json(F.collect_list(record)).alias("reply"))
    found = ingest.run_extractor(pages(spark, d), ingest.recorded_extractor(replies))
    return ingest.extract_events(found.select("page_id", "reply")).select("page_id", "name", "date", "town")


_STATED_SQL = LISTING_SQL + """,
  I AS (SELECT id, event_id % 9 AS ord, CASE event_id % 6 WHEN 0 THEN ' ' || town || ' ' WHEN 1 THEN town || ', CA' WHEN 2 THEN 'camp' WHEN 3 THEN '' WHEN 4 THEN 'Sonora' END AS stated,
          CASE WHEN k % 17 = 0 THEN 'TBD' WHEN k % 17 = 1 THEN '2024-02-30' WHEN k % 17 = 2 THEN NULL ELSE strftime(date, '%Y-%m-%d') END AS day FROM L)
"""
_ON_SQL = "len(list_filter(" + _list(dims.CORRIDOR) + ", lambda n: contains(lower(" + _trim("stated") + "), n) OR contains(n, lower(" + _trim("stated") + ")))) > 0"


def _stated(spark, d) -> DataFrame:
    """Events as an extractor might give them: odd towns and dates."""
    e, eid, k = listing(spark, d), F.col("event_id"), F.col("k")
    town = F.when(eid % 6 == 0, F.concat(F.lit(" "), "town", F.lit(" "))).when(eid % 6 == 1, F.concat("town", F.lit(", CA"))).when(eid % 6 == 2, "camp").when(eid % 6 == 3, "").when(eid % 6 == 4, "Sonora")
    day = F.when(k % 17 == 0, "TBD").when(k % 17 == 1, "2024-02-30").when(k % 17 != 2, text.iso(F.col("date")))
    return e.select("id", (eid % 9).cast("int").alias("source_ord"), town.alias("town"), day.alias("date"))


@_query("corridor_filter", f"WITH {_STATED_SQL} SELECT id, stated AS town FROM I WHERE {_ON_SQL}")
def corridor_filter(spark, d):
    return _stated(spark, d).where(ingest.on_corridor(F.col("town"))).select("id", "town")


@_query("ingest_future", f"WITH {_STATED_SQL} SELECT id, day AS stated_date, TRY_CAST(day AS DATE) IS NULL AS date_rejected FROM I WHERE day >= '2024-01-15'")
def ingest_future(spark, d):
    rows = _stated(spark, d).where(ingest.is_future(F.col("date"), AS_OF)).withColumn("stated_date", F.col("date"))
    return ingest.with_date(rows).select("id", "stated_date", "date_rejected")


_PLACES_SQL = ", ".join(f"({s[0]}, '{s[1]}', '{s[3].replace(chr(39), chr(39) * 2)}', '{s[4]}', {'NULL' if s[5] is None else chr(39) + s[5] + chr(39)})" for s in dims.SOURCES)


@_query(
    "parse_extraction",
    f"WITH {LISTING_SQL}, s(ord, source_slug, venue, place, addr) AS (VALUES {_PLACES_SQL}) SELECT source_slug, event_id // 9 AS page_id, 0 AS row_ord, name, {_day('date')} AS date, coalesce(CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN venue_name END, venue) AS venue_name, "
    "coalesce(CASE WHEN k % 2 = 0 THEN L.town END, place) AS town, coalesce(address, addr) AS address, array_to_string(artists, ', ') AS artists FROM L JOIN s ON event_id % 9 = ord WHERE event_id % 7 IN (0, 1, 2)",
)
def parse_extraction(spark, d):
    """Each event as a page's reply, fenced or plain, some of them broken; empty and missing places come from the source's registry entry."""
    e = listing(spark, d)
    eid, k = F.col("event_id"), F.col("k")
    record = F.struct("name", text.iso(F.col("date")).alias("date"), F.when(k % 3 == 1, F.col("venue_name")).when(k % 3 == 2, "").alias("venue_name"), F.when(k % 2 == 0, F.col("town")).otherwise("").alias("town"), "address", "artists")
    plain = F.to_json(F.array(record))
    reply = (
        F.when(eid % 7 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(eid % 7 == 1, plain).when(eid % 7 == 2, F.concat(F.lit("```\n"), plain, F.lit("```")))
        .when(eid % 7 == 3, F.expr("substring(r, 1, length(r) - 3)")).when(eid % 7 == 4, F.concat(plain, F.lit(" and more"))).when(eid % 7 == 5, F.to_json(record)).otherwise("[]")
    )
    own = F.broadcast(dims.sources(spark).select(F.col("source_ord").alias("_ord"), F.col("slug").alias("source_slug")))  # nine rows
    replies = e.withColumn("r", plain).select((eid % 9).cast("int").alias("_ord"), F.expr("event_id DIV 9").alias("page_id"), reply.alias("reply")).join(own, "_ord").drop("_ord")
    rows = ingest.extract_events(replies, dims.sources(spark))
    return rows.select("source_slug", "page_id", "row_ord", "name", "date", "venue_name", "town", "address", F.array_join("artists", ", ").alias("artists"))


_SRC_SQL = ", ".join(f"({s[0]}, '{s[1]}', {str(s[6]).lower()})" for s in dims.SOURCES)


@_query(
    "ingest_counts",
    f"WITH {_STATED_SQL}, s(ord, source_slug, filtered) AS (VALUES {_SRC_SQL}) SELECT source_slug, count(*) AS extracted, count(*) FILTER (NOT filtered OR ({_ON_SQL})) AS on_corridor, "
    f"count(*) FILTER ((NOT filtered OR ({_ON_SQL})) AND day >= '2024-01-15') AS future FROM I JOIN s ON I.ord = s.ord GROUP BY source_slug",
)
def ingest_counts(spark, d):
    own = F.broadcast(dims.sources(spark).select("source_ord", F.col("slug").alias("source_slug"), "corridor_filter"))  # nine rows
    return ingest.ingest_counts(_stated(spark, d).join(own, "source_ord"), AS_OF)


@_query(
    "source_isolation",
    f"WITH s(ord, source_slug, filtered) AS (VALUES {_SRC_SQL}), p AS (SELECT source_slug, source_slug = 'lube-room' AS down FROM documents JOIN s ON doc_id % 9 = ord) "
    "SELECT source_slug, count(*) AS pages, count(*) FILTER (down) AS failed, CASE WHEN bool_or(down) THEN 'ConnectionError: lube-room is down' END AS error FROM p GROUP BY source_slug",
)
def source_isolation(spark, d):
    """Each document as a page of one of the sources, one of which fails on every page."""
    own = F.broadcast(dims.sources(spark).select("source_ord", F.col("slug").alias("source_slug")))  # nine rows
    rows = spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") % 9).cast("int").alias("source_ord"), F.col("text").alias("markdown"))

    def fetch(slug, markdown):
        if slug == "lube-room":
            raise ConnectionError(f"{slug} is down")
        return markdown

    return ingest.source_outcomes(ingest.isolated(rows.join(own, "source_ord"), fetch))


_HOST_SQL = "regexp_extract(url, '//([^/:?#]+)', 1)"


class _Recorded:
    """Recorded pages in place of the web: hosts that sell something are down, pages with a long body time out at the first try, those of one path are gone."""

    def __init__(self):
        self.tried: set = set()

    def __call__(self, page_id, url, html):
        from .sources.fetch import Lasting

        host = url.split("//")[1].split("/")[0]
        if "cheap" in host:
            raise ConnectionError(f"{host} is down")
        if url.endswith("#top"):
            raise Lasting("HTTP 404")
        if len(html) > 8000 and page_id not in self.tried:
            self.tried.add(page_id)
            raise TimeoutError("slow")
        return html


@_query(
    "page_fetch",
    f"WITH p AS (SELECT {_HOST_SQL} AS host, contains({_HOST_SQL}, 'cheap') AS down, ends_with(url, '#top') AS gone, length(html) > 8000 AS slow FROM pages) "
    "SELECT host, count(*) AS pages, count(*) FILTER (down OR gone) AS failed, count(*) FILTER (NOT down AND NOT gone AND slow) AS retried, min(CASE WHEN down THEN 'ConnectionError: ' || host || ' is down' WHEN gone THEN 'HTTP 404' END) AS error FROM p GROUP BY host",
)
def page_fetch(spark, d):
    """The given pages through the fetcher, by recorded replies: what each host's pages came to."""
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.col("html").alias("body"), F.regexp_extract("url", "//([^/:?#]+)", 1).alias("host"))
    return fetch.site_outcomes(fetch.fetch_pages(rows, "host", ["page_id", "url", "body"], _Recorded(), pause=0.0), "host")


# --- Briefing, documents, freshness -----------------------------------------------------------------------------------

_WINDOW_SQL = UP_SQL + ", W AS (SELECT * FROM U WHERE date <= DATE '2024-01-22' AND visibility = 'public')"
_LINE_SQL = f"""name || ' at ' || venue_name || ' (' || town || ')' || ' — on ' || {_day('date')} || coalesce(' — at ' || start_time, '') || ' — [' || category || ']' || coalesce(' — ' || price, '')
  || CASE WHEN editor_pick THEN ' — {briefing.PICK.replace("'", "''")}' ELSE '' END || CASE WHEN artists IS NOT NULL THEN ' — Artists: ' || coalesce(array_to_string(artists, ', '), '') ELSE '' END"""


@_query("briefing_window", f"WITH {_WINDOW_SQL} SELECT id, {_day('date')} AS date, CASE WHEN date = DATE '2024-01-15' THEN 'today' ELSE 'upcoming' END AS block FROM W")
def briefing_window(spark, d):
    rows = serve.briefing_window(listing(spark, d), AS_OF)
    return rows.select("id", text.iso(F.col("date")).alias("date"), F.when(F.col("date") == F.lit(AS_OF), "today").otherwise("upcoming").alias("block"))


@_query("briefing_lines", f"WITH {_WINDOW_SQL} SELECT id, {_LINE_SQL} AS line FROM W")
def briefing_lines(spark, d):
    return serve.briefing_window(listing(spark, d), AS_OF).select("id", briefing.line().alias("line"))


@_query("briefing_blocks", f"WITH {_WINDOW_SQL} SELECT CASE WHEN date = DATE '2024-01-15' THEN 'today' ELSE 'upcoming' END AS block, count(*) AS n, string_agg({_LINE_SQL}, chr(10) ORDER BY {ORDER_SQL}) AS lines FROM W GROUP BY 1")
def briefing_blocks(spark, d):
    return briefing.blocks(listing(spark, d), AS_OF)


@_query(
    "briefing_result",
    f"WITH {_WINDOW_SQL}, b AS (SELECT date = DATE '2024-01-15' AS t, {_LINE_SQL} AS line, {ORDER_SQL.replace(' NULLS LAST', '')} FROM W) "
    f"SELECT true AS ok, count(*) AS event_count, 'Today is Monday, January 15, 2024. Write the daily briefing.' || chr(10) || chr(10) || 'TODAY''S EVENTS:' || chr(10) || string_agg(line, chr(10) ORDER BY {ORDER_SQL}) FILTER (t) || chr(10) || chr(10) || 'NEXT 6 DAYS:' || chr(10) || string_agg(line, chr(10) ORDER BY {ORDER_SQL}) FILTER (NOT t) AS briefing FROM b",
)
def briefing_result(spark, d):
    return briefing.run(listing(spark, d), _config(spark), AS_OF, "2024-01-15T14:00:00Z")[0]


@_query(
    "briefing_saved",
    f"WITH {LISTING_SQL.strip()}, q AS ({SQL['briefing_result']}) SELECT (SELECT count(*) || ' events in Arnold' FROM L WHERE town = 'Arnold') AS greeting_arnold, (SELECT briefing FROM q) AS weekly_briefing, '2024-01-15T14:00:00Z' AS weekly_briefing_date, CAST(NULL AS VARCHAR) AS empty, CAST(NULL AS VARCHAR) AS missing",
)
def briefing_saved(spark, d):
    """The day's briefing written into the settings, and the settings that a page reads afterwards."""
    _, saved = briefing.run(listing(spark, d), _settings(spark, d), AS_OF, "2024-01-15T14:00:00Z")
    return upsert.config_values(saved, "greeting_arnold", "weekly_briefing", "weekly_briefing_date", "empty", "missing")


@_query("paragraphs", "SELECT doc_id, unnest(range(len(p))) AS ord, unnest(p) AS paragraph FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)")
def paragraphs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("ord", "paragraph")).withColumn("ord", F.col("ord").cast("long"))


_SCHEMA = "https://schema.org"
_PRICE_SQL = "CASE WHEN price <> '' THEN CASE WHEN price = 'Free' THEN '0' ELSE price END END"
_START_SQL = f"{_day('date')} || coalesce('T' || nullif(start_time, ''), '')"
_END_SQL = f"CASE WHEN end_time <> '' THEN {_day('date')} || 'T' || end_time END"


@_query(
    "itemlist_doc",
    f"WITH {UP_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS position, count(*) OVER () AS number_of_items FROM U WHERE visibility = 'public') "
    f"SELECT position, number_of_items, '{dims.SITE_URL}/events/' || {_slug_sql()} AS url, name, {_START_SQL} AS start_date, {_END_SQL} AS end_date, venue_name, town, nullif(description, '') AS description, {_PRICE_SQL} AS price, '{_SCHEMA}/EventScheduled' AS event_status FROM p WHERE position <= 50",
)
def itemlist_doc(spark, d):
    return documents.list_items(serve.upcoming(listing(spark, d), AS_OF))


@_query(
    "event_doc",
    f"WITH {UP_SQL}, s AS (SELECT *, {_slug_sql()} AS slug FROM U) SELECT id, slug, name, description, {_START_SQL} AS start_date, {_END_SQL} AS end_date, venue_name, address AS street, town, {_PRICE_SQL} AS price, "
    f"CASE WHEN price <> '' THEN event_url END AS offer_url, '{_SCHEMA}/' || CASE WHEN status = 'tentative' THEN 'EventPostponed' ELSE 'EventScheduled' END AS event_status, CASE WHEN len(artists) > 0 THEN array_to_string(artists, ', ') END AS performers FROM s",
)
def event_doc(spark, d):
    return documents.event_fields(serve.upcoming(listing(spark, d), AS_OF)).withColumn("performers", F.array_join("performers", ", "))


_TITLE_SQL = "name || ' — ' || strftime(date, '%B %-d, %Y') || ' in ' || town"
_ABOUT_SQL = "coalesce(substr(description, 1, 155), name || ' at ' || venue_name || ' in ' || town || ', CA on ' || strftime(date, '%B %-d, %Y') || '.')"


@_query(
    "page_metadata",
    f"WITH {UP_SQL}, s AS (SELECT id, {_slug_sql()} AS slug, {_TITLE_SQL} AS title, {_ABOUT_SQL} AS description FROM U) SELECT id, title, description, '/events/' || slug AS canonical, '{dims.SITE_URL}/events/' || slug AS url, "
    "title AS og_title, description AS og_description, 'website' AS og_type, 'summary' AS twitter_card, title AS twitter_title, description AS twitter_description FROM s",
)
def page_metadata(spark, d):
    return documents.page_metadata(serve.upcoming(listing(spark, d), AS_OF))


@_query(
    "requested_metadata",
    f"WITH {UP_SQL}, r AS (SELECT DISTINCT {_slug_sql()} AS slug FROM L), s AS (SELECT *, {_slug_sql()} AS slug FROM U), f AS (SELECT slug, {_TITLE_SQL} AS title, {_ABOUT_SQL} AS description, row_number() OVER (PARTITION BY slug ORDER BY {ORDER_SQL}) AS nth FROM s) "
    "SELECT r.slug, coalesce(title, 'Event Not Found') AS title, description FROM r LEFT JOIN f ON r.slug = f.slug AND nth = 1",
)
def requested_metadata(spark, d):
    """Pages asked for by every slug of the listing, past events' too, which are not found."""
    rows = listing(spark, d)
    return documents.requested_metadata(serve.with_slug(rows).select("slug").distinct(), serve.upcoming(rows, AS_OF))


_PUT_SQL = "json_merge_patch('{}', json_object("  # leaves out members that are null


@_query(
    "itemlist_json",
    f"WITH {UP_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS position, count(*) OVER () AS n, {_PRICE_SQL} AS cost FROM U WHERE visibility = 'public'), "
    f"i AS (SELECT position, n, {_PUT_SQL}'@type', 'ListItem', 'position', position, 'url', '{dims.SITE_URL}/events/' || {_slug_sql()}, 'item', json_object('@type', 'Event', 'name', name, 'startDate', {_START_SQL}, 'endDate', {_END_SQL}, "
    "'location', json_object('@type', 'Place', 'name', venue_name, 'address', json_object('@type', 'PostalAddress', 'addressLocality', town, 'addressRegion', 'CA', 'addressCountry', 'US')), 'description', nullif(description, ''), "
    f"'offers', CASE WHEN cost IS NOT NULL THEN json_object('@type', 'Offer', 'price', cost, 'priceCurrency', 'USD', 'availability', '{_SCHEMA}/InStock') END, 'eventAttendanceMode', '{_SCHEMA}/OfflineEventAttendanceMode', 'eventStatus', '{_SCHEMA}/EventScheduled'))) AS e FROM p WHERE position <= 50) "
    f"SELECT CAST(json_object('@context', '{_SCHEMA}', '@type', 'ItemList', 'name', 'Upcoming events', 'numberOfItems', coalesce(max(n), 0), 'itemListElement', to_json(coalesce(list(e ORDER BY position), []))) AS VARCHAR) AS document FROM i",
)
def itemlist_json(spark, d):
    return documents.list_document(serve.upcoming(listing(spark, d), AS_OF))


@_query(
    "event_json",
    f"WITH {UP_SQL}, s AS (SELECT *, {_slug_sql()} AS slug, {_PRICE_SQL} AS cost FROM U) SELECT id, slug, CAST({_PUT_SQL}'@context', '{_SCHEMA}', '@type', 'Event', 'name', name, 'description', nullif(description, ''), 'startDate', {_START_SQL}, 'endDate', {_END_SQL}, "
    "'location', json_object('@type', 'Place', 'name', venue_name, 'address', json_object('@type', 'PostalAddress', 'streetAddress', nullif(address, ''), 'addressLocality', town, 'addressRegion', 'CA', 'addressCountry', 'US')), "
    f"'offers', CASE WHEN cost IS NOT NULL THEN json_object('@type', 'Offer', 'price', cost, 'priceCurrency', 'USD', 'availability', '{_SCHEMA}/InStock', 'url', coalesce(nullif(event_url, ''), '{dims.SITE_URL}/events/' || slug)) END, "
    f"'eventAttendanceMode', '{_SCHEMA}/OfflineEventAttendanceMode', 'eventStatus', '{_SCHEMA}/' || CASE WHEN status = 'tentative' THEN 'EventPostponed' ELSE 'EventScheduled' END, "
    f"'performer', CASE WHEN len(artists) > 0 THEN to_json(list_transform(artists, lambda a: json_object('@type', 'Person', 'name', a))) END, 'organizer', json_object('@type', 'Organization', 'name', '{dims.SITE_NAME}', 'url', '{dims.SITE_URL}'))) AS VARCHAR) AS document FROM s",
)
def event_json(spark, d):
    return documents.event_documents(serve.upcoming(listing(spark, d), AS_OF))


@_query(
    "breadcrumbs",
    f"WITH {UP_SQL}, s AS (SELECT DISTINCT name, '/events/' || {_slug_sql()} AS path FROM U) SELECT path, CAST(json_object('@context', '{_SCHEMA}', '@type', 'BreadcrumbList', 'itemListElement', json_array("
    f"json_object('@type', 'ListItem', 'position', 1, 'name', 'Home', 'item', '{dims.SITE_URL}'), json_object('@type', 'ListItem', 'position', 2, 'name', name, 'item', '{dims.SITE_URL}' || path))) AS VARCHAR) AS document FROM s",
)
def breadcrumbs(spark, d):
    rows = serve.with_slug(serve.upcoming(listing(spark, d), AS_OF))
    return documents.breadcrumbs(rows.select("name", F.concat(F.lit("/events/"), "slug").alias("path")).distinct())


@_query(
    "faq_doc",
    f"WITH {UP_SQL}, q AS (SELECT town, json_object('@type', 'Question', 'name', 'What is on in ' || town || '?', 'acceptedAnswer', json_object('@type', 'Answer', 'text', count(*) || ' events, the first on ' || {_day('min(date)')} || '.')) AS e FROM U GROUP BY town) "
    f"SELECT CAST(json_object('@context', '{_SCHEMA}', '@type', 'FAQPage', 'mainEntity', to_json(list(e ORDER BY town))) AS VARCHAR) AS document FROM q",
)
def faq_doc(spark, d):
    """A page of questions that the events answer."""
    rows = serve.upcoming(listing(spark, d), AS_OF).groupBy("town").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))
    answer = F.concat(F.col("n").cast("string"), F.lit(" events, the first on "), text.iso(F.col("first")), F.lit("."))
    return documents.faq_document(rows.select(F.col("town").alias("ord"), F.concat(F.lit("What is on in "), "town", F.lit("?")).alias("question"), answer.alias("answer")))


_DAY_SITE_SQL = f"WITH {UP_SQL}, s AS (SELECT town AS name, '{dims.SITE_URL}/' || lower(replace(town, ' ', '-')) AS url, count(*) || ' events to come' AS description FROM U GROUP BY town), "


@_query(
    "site_docs",
    _DAY_SITE_SQL + f"b AS (SELECT *, '{_SCHEMA}' AS ctx FROM s) SELECT name, 'WebSite' AS kind, CAST(json_object('@context', ctx, '@type', 'WebSite', 'name', name, 'url', url, 'description', description) AS VARCHAR) AS document FROM b "
    "UNION ALL SELECT name, 'Organization', CAST(json_object('@context', ctx, '@type', 'Organization', 'name', name, 'url', url, 'description', description, 'areaServed', json_object('@type', 'Place', 'name', name)) AS VARCHAR) FROM b",
)
def site_docs(spark, d):
    """A site for each town with events to come."""
    rows = serve.upcoming(listing(spark, d), AS_OF).groupBy(F.col("town").alias("name")).agg(F.concat(F.count(F.lit(1)), F.lit(" events to come")).alias("description"))
    return documents.site_documents(rows.withColumns({"url": F.concat(F.lit(f"{dims.SITE_URL}/"), F.lower(F.replace("name", F.lit(" "), F.lit("-")))), "area": F.col("name")}))


@_query(
    "sitemap_rows",
    f"SELECT *, '2024-01-15T14:00:00Z' AS last_modified FROM (WITH {UP_SQL} SELECT 3 AS section, '{dims.SITE_URL}/events/' || {_slug_sql()} AS url, 'weekly' AS change_frequency, CAST(0.8 AS DOUBLE) AS priority FROM U "
    f"UNION ALL SELECT * FROM (VALUES (0, '{dims.SITE_URL}', 'daily', CAST(1.0 AS DOUBLE)), (1, '{dims.SITE_URL}/about', 'monthly', CAST(0.7 AS DOUBLE)), (2, '{dims.SITE_URL}/faq', 'monthly', CAST(0.6 AS DOUBLE))))",
)
def sitemap_rows(spark, d):
    return documents.sitemap(spark, serve.upcoming(listing(spark, d), AS_OF), F.lit("2024-01-15T14:00:00Z"))


_NOW = "2024-02-01 12:00:00"


@_query(
    "freshness",
    f"WITH m AS (SELECT max(ts) AS t FROM events), a AS (SELECT t, epoch(TIMESTAMP '{_NOW}') - floor(epoch(t)) AS s FROM m) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS last_checked, CAST(floor(s / 3600) AS BIGINT) AS age_hours, s < 172800 AS is_recent, "
    "'Last checked ' || CASE WHEN s < 172800 THEN CASE WHEN round(s / 60) < 1440 THEN 'about ' || CAST(round(round(s / 60) / 60) AS BIGINT) || ' hours ago' WHEN round(s / 60) < 2520 THEN '1 day ago' ELSE CAST(round(round(s / 60) / 1440) AS BIGINT) || ' days ago' END ELSE 'on ' || strftime(t, '%A') END || '. Not all events may be listed.' AS sentence FROM a",
)
def freshness(spark, d):
    return fresh.freshness(listing(spark, d), F.lit(_NOW).cast("timestamp_ntz"))


# --- Extensions: how events were ---

_FACTS_SQL = LISTING_SQL.strip() + ", f AS (SELECT series, ts, arg_max({'p': price}, event_id).p AS price FROM (SELECT L.*, e.ts FROM L JOIN e USING (event_id)) GROUP BY series, ts)"


@_query(
    "price_history",
    f"WITH {_FACTS_SQL}, h AS (SELECT *, lag(price) OVER w AS before, row_number() OVER w AS nth FROM f WINDOW w AS (PARTITION BY series ORDER BY ts)) "
    "SELECT series, price, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(lead(ts) OVER (PARTITION BY series ORDER BY ts), '%Y-%m-%d %H:%M:%S.%f') AS valid_to FROM h WHERE nth = 1 OR price IS DISTINCT FROM before",
)
def price_history(spark, d):
    """For each series the stretches of time in which its price stayed the same."""
    rows = history.intervals(listing(spark, d), "series", "last_scraped_at", ["price"], "event_id")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select("series", "price", stamp("valid_from"), stamp("valid_to"))


@_query(
    "price_as_of",
    f"WITH {_FACTS_SQL}, a AS (SELECT event_id, series, ts - INTERVAL 36 HOURS AS ts FROM (SELECT L.*, e.ts FROM L JOIN e USING (event_id))) SELECT a.event_id, a.series, f.price FROM a ASOF LEFT JOIN f ON a.series = f.series AND a.ts >= f.ts",
)
def price_as_of(spark, d):
    """What each event's series cost a day and a half before."""
    rows = listing(spark, d).select("event_id", "series", "last_scraped_at", "price")
    asks = rows.select("event_id", "series", (F.col("last_scraped_at") - F.expr("INTERVAL 36 HOURS")).alias("last_scraped_at"))
    return history.as_of(asks, rows, "series", "last_scraped_at", ["price"], F.col("event_id")).select("event_id", "series", "price")


# --- Extensions: late batches, spellings, search ---

_LATE = ["id", "name", "description", "start_time", "end_time", "price", "event_url"]


@_query(
    "upsert_late",
    f"WITH {LISTING_SQL}, o AS (SELECT L.*, e.ts FROM L JOIN e USING (event_id)), g AS (SELECT series AS dedup_key, arg_min({{'id': id, 'name': name}}, (ts, event_id)) AS f, "
    f"arg_max({{{', '.join(f"'{c}': {c}" for c in upsert.MUTABLE)}}}, (ts, event_id)) AS m FROM o GROUP BY series) SELECT dedup_key, f.id AS id, f.name AS name, {', '.join(f'm.{c} AS {c}' for c in upsert.MUTABLE)} FROM g",
)
def upsert_late(spark, d):
    """Each series as one event, from a store that gets the rows in three batches out of order, the last with all rows of the first again."""
    rows = listing(spark, d).select(F.col("series").alias("dedup_key"), F.col("last_scraped_at").alias("at"), "event_id", *_LATE)
    store = OrderedStore(spark, shared_folder(spark, "late"), rows.schema, ["at", "event_id"], 16)
    turn = F.col("event_id") % 3
    for batch in (turn == 2, turn == 0, turn > 0):
        store.apply(rows.where(batch))
    return store.read().select("dedup_key", *_LATE)


_FED_SQL = (
    LISTING_SQL.strip() + ", t AS (SELECT *, lower(series || ' at the ' || venue_name) AS title, CAST(k % 9 + 1 AS INTEGER) AS pos FROM L), "
    "fed_names AS (SELECT id, date, town, CASE event_id % 10 WHEN 3 THEN substr(title, 1, pos - 1) || substr(title, pos + 1) WHEN 6 THEN substr(title, 1, pos) || substr(title, pos) ELSE title END AS fed_name FROM t), fed AS (SELECT *, trim(regexp_replace(fed_name, ' +', ' ', 'g')) AS name FROM fed_names)"
)


def _misspelled(spark: SparkSession, d: str) -> DataFrame:
    """Events with a title, of which one in ten lacks a letter and one in ten has one twice."""
    eid, title, at = F.col("event_id"), F.col("title"), (F.col("k") % 9 + 1).cast("int")
    rows = listing(spark, d).withColumn("title", F.lower(F.concat("series", F.lit(" at the "), "venue_name")))
    without = F.concat(F.substring(title, F.lit(1), at - 1), F.substring(title, at + 1, F.length(title)))
    twice = F.concat(F.substring(title, F.lit(1), at), F.substring(title, at, F.length(title)))
    return rows.select("id", "date", "town", F.when(eid % 10 == 3, without).when(eid % 10 == 6, twice).otherwise(title).alias("name"))


_PAIRS_SQL = (
    _FED_SQL + ", names AS (SELECT DISTINCT date, town, name FROM fed), "
    "q AS (SELECT *, regexp_replace(name, '[^0-9]+', ' ', 'g') AS digits, list_distinct(list_transform(range(1, length(name) + 3), lambda i: substr('##' || name || '##', i, 3))) AS g FROM names), "
    "j AS (SELECT x.date, x.town, x.name AS a, y.name AS b, len(list_intersect(x.g, y.g)) AS shared, len(x.g) AS grams_a, len(y.g) AS grams_b FROM q x JOIN q y ON x.date = y.date AND x.town = y.town AND x.digits = y.digits AND x.name < y.name), "
    "p AS (SELECT * FROM j WHERE shared * 100 >= (grams_a + grams_b - shared) * 70)"
)


@_query("similar_names", f"WITH {_PAIRS_SQL} SELECT {_day('date')} AS date, town, a, b, CAST(shared AS INTEGER) AS shared, CAST(grams_a AS INTEGER) AS grams_a, CAST(grams_b AS INTEGER) AS grams_b FROM p")
def similar_names(spark, d):
    """Titles of a date and town that are spelled alike."""
    return fuzzy.similar_names(_misspelled(spark, d), ["date", "town"]).withColumn("date", text.iso(F.col("date")))


@_query(
    "event_spelling",
    f"WITH {_PAIRS_SQL}, c AS (SELECT date, town, name, count(*) AS n FROM fed GROUP BY ALL), w AS (SELECT date, town, a AS name, b AS other FROM p UNION ALL SELECT date, town, b, a FROM p UNION ALL SELECT date, town, name, name FROM names), "
    "best AS (SELECT w.date, w.town, w.name, arg_min(w.other, (-c.n, w.other)) AS spelling FROM w JOIN c ON w.date = c.date AND w.town = c.town AND w.other = c.name GROUP BY ALL) "
    "SELECT fed.id, best.spelling FROM fed JOIN best ON fed.date = best.date AND fed.town = best.town AND fed.name = best.name",
)
def event_spelling(spark, d):
    """Each event's title as most of its date and town spell it."""
    return fuzzy.with_spelling(_misspelled(spark, d), ["date", "town"]).select("id", "spelling")


_TEXTS_SQL = UP_SQL + ", x AS (SELECT id, lower(concat_ws(' ', name, replace(category, '_', ' '), venue_name, town, array_to_string(artists, ' '))) AS t FROM U), d AS (SELECT id, list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM x)"
_IDF_SQL = "floor(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 1e6::DOUBLE)"


def _index(spark: SparkSession, d: str) -> SearchIndex:
    texts = F.concat_ws(" ", "name", F.replace("category", F.lit("_"), F.lit(" ")), "venue_name", "town", F.array_join("artists", " "))
    return SearchIndex(spark, shared_folder(spark, "search")).build(serve.upcoming(listing(spark, d), AS_OF).select("id", texts.alias("text")), 16)


@_query(
    "event_search",
    f"WITH {_TEXTS_SQL}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len(ws)) / CAST(count(*) AS DOUBLE) AS mean FROM d), each AS (SELECT id, CAST(len(ws) AS DOUBLE) AS size, unnest(ws) AS w FROM d), "
    "tf AS (SELECT id, size, w, CAST(count(*) AS DOUBLE) AS tf FROM each GROUP BY ALL), df AS (SELECT w, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY w), "
    "a AS (SELECT DISTINCT venue_name || ', ' || town || ', ' || replace(category, '_', ' ') AS query FROM U), b AS (SELECT DISTINCT query, unnest(string_split_regex(lower(query), '[^a-z0-9]+')) AS w FROM a), "
    f"k AS (SELECT query, b.w, {_IDF_SQL} AS weight FROM b JOIN df ON b.w = df.w, s), "
    "r AS (SELECT query, id, CAST(sum(floor(weight * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)))) AS BIGINT) AS score FROM k JOIN tf ON k.w = tf.w, s GROUP BY query, id), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r) SELECT query, rank, id, score FROM z WHERE rank <= 10",
)
def event_search(spark, d):
    """The ten best events for each venue, town and category that occur together."""
    asks = serve.upcoming(listing(spark, d), AS_OF).select(F.concat_ws(", ", "venue_name", "town", F.replace("category", F.lit("_"), F.lit(" "))).alias("query")).distinct()
    return _index(spark, d).search(asks.withColumn("text", F.col("query"))).withColumn("rank", F.col("rank").cast("long"))


@_query(
    "event_phrases",
    f"WITH {_TEXTS_SQL}, a AS (SELECT DISTINCT venue_name || ' ' || town AS query FROM U), b AS (SELECT query, string_split_regex(lower(query), '[^a-z0-9]+') AS ps FROM a), "
    "m AS (SELECT query, id, len(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + len(ps) - 1] = ps)) AS times FROM b, d) SELECT query, id, CAST(times AS BIGINT) AS times FROM m WHERE times > 0",
)
def event_phrases(spark, d):
    """The events in whose text a venue's name is followed by a town's."""
    asks = serve.upcoming(listing(spark, d), AS_OF).select(F.concat_ws(" ", "venue_name", "town").alias("query")).distinct()
    return _index(spark, d).phrases(asks.withColumn("text", F.col("query")))


# --- Operators known from design documents only -----------------------------------------------------------------------


@_query("stale_events", "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE ts < TIMESTAMP '2024-01-26' - INTERVAL 14 DAYS")
def stale_events(spark, d):
    return upsert.possibly_stale(listing(spark, d), dt.date(2024, 1, 26)).select("id")


@_query(
    "crawl_recent",
    f"WITH {LISTING_SQL}, r AS (SELECT id, town, row_number() OVER (PARTITION BY town ORDER BY date DESC, id) AS nth FROM L WHERE date >= DATE '2024-01-15' - 60) SELECT id, town, nth FROM r WHERE nth <= 20",
)
def crawl_recent(spark, d):
    return upsert.crawl_recent(listing(spark, d), AS_OF, by="town").select("id", "town", F.col("nth").cast("long").alias("nth"))


@_query("reconcile_visibility", f"WITH {LISTING_SQL} SELECT {_key_sql()} AS dedup_key, CASE WHEN bool_or(visibility = 'public') THEN 'public' ELSE 'private' END AS visibility FROM L GROUP BY 1")
def reconcile_visibility(spark, d):
    return upsert.reconcile_visibility(upsert.with_key(listing(spark, d)))


def _scored(spark, d) -> DataFrame:
    """The listing with some events already scored, some of those by an editor."""
    k = F.col("k")
    return listing(spark, d).withColumns({"importance": F.when(k % 7 == 0, "major"), "importance_override": k % 14 == 0})


@_query("scoring_batches", f"WITH {LISTING_SQL} SELECT id, {_day('date')} AS date, CAST((row_number() OVER (PARTITION BY date ORDER BY id) - 1) // 10 + 1 AS BIGINT) AS batch FROM L WHERE visibility = 'public' AND (k % 7 <> 0 OR k % 14 <> 0)")
def scoring_batches(spark, d):
    return upsert.scoring_batches(_scored(spark, d)).select("id", text.iso(F.col("date")).alias("date"), "batch")


_TOLD_SQL = "WHEN target AND category = 'festival' THEN {} WHEN target AND category IS DISTINCT FROM 'civic' THEN {}"


@_query(
    "importance",
    f"WITH {LISTING_SQL}, t AS (SELECT *, visibility = 'public' AND (k % 7 <> 0 OR k % 14 <> 0) AS target FROM L) SELECT id, CASE {_TOLD_SQL.format("'major'", "'minor'")} WHEN k % 7 = 0 THEN 'major' END AS importance, "
    f"CASE {_TOLD_SQL.format('CAST(0.9 AS DOUBLE)', 'CAST(0.2 AS DOUBLE)')} END AS importance_score, CASE {_TOLD_SQL.format("'draws visitors'", "'local'")} END AS importance_reason FROM t",
)
def importance(spark, d):
    """A classifier of recorded replies: plain, fenced, and one that isn't JSON."""
    category = F.col("category")
    reply = F.when(category == "festival", '{"importance": "major", "score": 0.9, "reason": "draws visitors"}').when(category == "civic", "I can't say.").otherwise('```json\n{"importance": "minor", "score": 0.2, "reason": "local"}\n```')
    return upsert.score_importance(_scored(spark, d), lambda rows: rows.select("id", reply.alias("reply"))).select("id", "importance", "importance_score", "importance_reason")
