"""Schemas and value domains of the event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = (
    "id string, name string, description string, date date, start_time string, end_time string, venue_name string, town string, "
    "address string, category string, artists array<string>, status string, is_past boolean, price string, event_url string, "
    "source_url string, source_name string, visibility string, org_slug string, importance string, dedup_key string, "
    "last_scraped_at timestamp, image_url string, editor_pick boolean"
)
EXTRACTED = "name string, description string, date string, start_time string, end_time string, venue_name string, town string, address string, category string, price string, artists array<string>, event_url string"
ORG = "id string, slug string, display_name string"
CONFIG = "key string, value string"
TOWN = "name string, elevation int, tagline string, drive_text string, lat double, lng double, corridor_ord int, filter_ord int"
SOURCE = "source_ord int, slug string, source_name string, default_venue string, default_town string, default_address string, corridor_filter boolean"

#: Fixed values.
DOMAINS = {
    "category": ("live_music", "festival", "civic", "resort", "lodge", "other"),
    "status": ("confirmed", "tentative", "cancelled"),
    "visibility": ("public", "private"),
    "importance": ("major", "minor"),
}


def with_rejects(events: DataFrame) -> DataFrame:
    """events with reject_reason: the first column whose value is outside its domain, null where all are inside."""
    checks = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(c)) for c, values in DOMAINS.items() if c in events.columns]
    return events.withColumn("reject_reason", F.coalesce(*checks, F.lit(None).cast("string")))
