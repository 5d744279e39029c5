"""When events were last checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.present import relative_age


def freshness(events: DataFrame, now: Column) -> DataFrame:
    """One row: the latest check, its age in hours, whether it is recent (under 48 hours) and the sentence to show."""
    last = events.agg(F.max("last_scraped_at").alias("last_checked"))
    seconds = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_checked").cast("timestamp"))).cast("double")
    recent = seconds < 48 * 3600
    said = F.concat(F.lit("Last checked "), F.when(recent, relative_age(seconds)).otherwise(F.concat(F.lit("on "), F.date_format("last_checked", "EEEE"))), F.lit(". Not all events may be listed."))
    return last.select(
        F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss").alias("last_checked"), F.floor(seconds / 3600).cast("long").alias("age_hours"), recent.alias("is_recent"),
        F.coalesce(said, F.lit("Updated regularly. Not all events may be listed.")).alias("sentence"),
    )
