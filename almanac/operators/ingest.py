"""Write path up to the store: page gates, extraction, corridor and date filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..dims import CORRIDOR
from ..functions.text import js_trim, strip_fence, truthy
from ..schemas import EXTRACTED


def gate_reason(success: Column, markdown: Column) -> Column:
    """Why a page is rejected: fetch_failed, too_short (under 100 characters), not_found, or pass."""
    text = F.coalesce(markdown, F.lit(""))
    low = F.lower(text)
    missing = F.contains(low, F.lit("404")) | F.contains(low, F.lit("page not found"))
    return F.when(~F.coalesce(success, F.lit(False)), "fetch_failed").when(F.length(text) < 100, "too_short").when(missing, "not_found").otherwise("pass")


def extracted(reply: Column) -> Column:
    """A reply's array of event records; empty where it isn't one JSON array."""
    text = strip_fence(reply)
    whole = F.regexp_like(text, F.lit(r"^\s*\[")) & F.regexp_like(text, F.lit(r"\]\s*\z"))
    records = F.from_json(text, f"array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in EXTRACTED.split(', '))}>>")
    return F.coalesce(F.when(whole & F.try_parse_json(text).isNotNull(), records), F.array().cast(f"array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in EXTRACTED.split(', '))}>>"))


def extract_events(replies: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Rows (source_slug, reply, any columns) to one row for each record, with row_ord and the source's default places."""
    rows = replies.select(*(c for c in replies.columns if c != "reply"), F.posexplode(extracted(F.col("reply"))).alias("row_ord", "r")).select("*", "r.*").drop("r")
    if sources is None:
        return rows
    own = F.broadcast(sources.select(F.col("slug").alias("source_slug"), "source_ord", "default_venue", "default_town", "default_address"))  # the registry's few rows
    rows = rows.join(own, "source_slug", "left")
    for c, d in (("venue_name", "default_venue"), ("town", "default_town"), ("address", "default_address")):
        rows = rows.withColumn(c, F.coalesce(truthy(F.col(c)), F.col(d)))
    return rows.drop("default_venue", "default_town", "default_address")


def run_extractor(pages: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pages that pass the gate through an extractor, which adds the column reply (a model call belongs there, in mapInPandas; recorded_extractor() needs none)."""
    return extractor(pages.where(gate_reason(F.col("success"), F.col("markdown")) == "pass"))


def recorded_extractor(replies: DataFrame, key: str = "page_id") -> Callable[[DataFrame], DataFrame]:
    """An extractor that takes each page's reply from a table (key, reply), one row for each page; a page without one has a null reply, which holds no events."""
    return lambda pages: pages.join(replies.select(key, "reply"), key, "left")


def isolated(pages: DataFrame, fetch: Callable[[str | None, str | None], str | None]) -> DataFrame:
    """pages (source_slug, markdown, any columns) with reply, or error where fetch(source_slug, markdown) raised: no source's failure stops another's pages."""

    def run(batches):
        for batch in batches:
            replies, errors = [], []
            for slug, text in zip(batch.column("source_slug").to_pylist(), batch.column("markdown").to_pylist()):
                try:
                    reply, error = fetch(slug, text), None
                except Exception as e:  # whatever a source does, its row says so
                    reply, error = None, f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "reply", "error"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("reply", StringType()), StructField("error", StringType())]))


def source_outcomes(fetched: DataFrame) -> DataFrame:
    """Per source of isolated(): pages, failed ones, and one of the errors."""
    return fetched.groupBy("source_slug").agg(F.count(F.lit(1)).alias("pages"), F.count("error").alias("failed"), F.min("error").alias("error"))


def on_corridor(town: Column, names: list[str] = CORRIDOR) -> Column:
    """Whether the town contains a corridor name or is contained in one; an empty town is, a null one isn't."""
    low = F.lower(js_trim(town))
    return F.exists(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(low, n) | F.contains(n, low))


def is_future(date: Column, as_of: dt.date) -> Column:
    """String comparison, so text after digits passes; null doesn't."""
    return F.coalesce(date >= F.lit(as_of.isoformat()), F.lit(False))


def with_date(events: DataFrame) -> DataFrame:
    """events with their date parsed, and date_rejected where it isn't one."""
    day = F.try_to_date(F.col("date"), "yyyy-MM-dd")
    return events.withColumn("date_rejected", day.isNull()).withColumn("date", day)


def ingest_counts(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Per source: extracted, on the corridor (all of them where the source has no such filter), and future ones among those."""
    corridor = ~F.col("corridor_filter") | on_corridor(F.col("town"))
    count = lambda c: F.count(F.when(c, F.lit(1)))
    return events.groupBy("source_slug").agg(F.count(F.lit(1)).alias("extracted"), count(corridor).alias("on_corridor"), count(corridor & is_future(F.col("date"), as_of)).alias("future"))
