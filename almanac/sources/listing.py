"""Event rows from the events table: the listing view that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import FILTER_TOWNS

#: A venue for each image rule and one that matches none.
VENUES = ["Ironstone Amphitheatre", "Bear Valley Lodge", "Sequoia Woods Club", "Moose Lodge Hall", "County Fairgrounds", "The Watering Hole", "Hilltop Winery", "Old Vineyard Barn", "Main Street Plaza"]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event row for each row of events; all columns are expressions of the row, so filters and pruning reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))
    eid, k, user = F.col("event_id"), F.col("k"), F.col("user_id")
    series = F.concat("event_type", F.lit(" "), user.cast("string"))
    name = F.concat(
        series,
        F.when(eid % 4 == 0, "").when(eid % 4 == 1, F.concat(F.lit(" - Day "), (eid % 3 + 1).cast("string")))
        .when(eid % 4 == 2, F.concat(F.lit(" (through day "), k.cast("string"), F.lit(")"))).otherwise(" (Opening Day)"),
    )
    artist = lambda n: F.concat(F.lit("Artist "), n.cast("string"))
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        eid.cast("string").alias("id"),
        ts.cast("date").alias("date"),
        F.when(eid % 7 != 0, F.date_format(ts, "HH:mm")).alias("start_time"),
        F.when(eid % 3 != 0, F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "HH:mm")).alias("end_time"),
        series.alias("series"),
        name.alias("name"),
        F.when(eid % 11 != 0, F.concat(F.lit("About "), name)).alias("description"),
        pick(FILTER_TOWNS, user % 8).alias("town"),
        pick(VENUES, user % 9).alias("venue_name"),
        F.when(k % 2 != 0, F.concat(k.cast("string"), F.lit(" Main St"))).alias("address"),
        F.when(F.col("event_type") == "click", "live_music").when(F.col("event_type") == "view", "festival").when(F.col("event_type") == "signup", "civic")
        .when(F.col("event_type") == "purchase", "resort").otherwise(F.when(user % 2 == 0, "lodge").otherwise("other")).alias("category"),
        F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array(artist(k), artist(k % 10))).alias("artists"),
        F.when(k != 99, F.when(k % 10 == 0, "cancelled").when(k % 10 == 1, "tentative").otherwise("confirmed")).alias("status"),
        F.when(k != 97, k % 20 == 5).alias("is_past"),
        F.when(k % 4 != 0, F.when(k % 4 == 1, "Free").otherwise(F.concat(F.lit("$"), k.cast("string")))).alias("price"),
        F.when(k != 98, F.when(user % 6 == 0, "private").otherwise("public")).alias("visibility"),
        F.when(user % 5 != 0, F.concat(F.lit("org-"), (user % 9).cast("string"))).alias("org_slug"),
        (k == 42).alias("editor_pick"),
        ts.alias("last_scraped_at"),
        F.concat(F.lit("https://tickets.example/"), eid.cast("string")).alias("event_url"),
        eid, k,
    )
