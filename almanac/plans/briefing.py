"""The daily briefing: event lines, text blocks, prompt, saved text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso, truthy
from ..operators.serve import briefing_window, order_key
from ..operators.upsert import upsert_by_key

PICK = "[EDITOR'S PICK]"


def line() -> Column:
    """An event's line: parts that have a value, joined by dashes. An empty list of artists counts as a value."""
    parts = F.array(
        F.concat("name", F.lit(" at "), "venue_name", F.lit(" ("), "town", F.lit(")")),
        F.concat(F.lit("on "), iso(F.col("date"))),
        F.concat(F.lit("at "), truthy(F.col("start_time"))),
        F.concat(F.lit("["), truthy(F.col("category")), F.lit("]")),
        truthy(F.col("price")),
        F.when(F.col("editor_pick"), F.lit(PICK)),
        F.concat(F.lit("Artists: "), F.array_join("artists", ", ", "")),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " — ")


def blocks(events: DataFrame, as_of: dt.date) -> DataFrame:
    """(block, n, lines): today's and the later events' lines in order; a block without events has its fixed sentence.

    Lines are joined for each minute first, so only the minutes' texts meet.
    """
    rows = briefing_window(events, as_of).withColumns({"block": F.when(F.col("date") == F.lit(as_of), "today").otherwise("upcoming"), "_line": line()})
    late = F.col("start_time").isNull()
    minute = rows.groupBy("block", "date", late.alias("late"), "start_time").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", "_line"))).alias("all"))
    minute = minute.select("block", F.struct("date", "late", "start_time").alias("k"), "n", F.array_join(F.transform("all", lambda x: x["_line"]), "\n").alias("text"))
    found = minute.groupBy("block").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("all"))
    found = found.select("block", "n", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("lines"))
    empty = events.sparkSession.createDataFrame([("today", "No events today."), ("upcoming", "No events listed for the rest of the week.")], "block string, none string")
    return F.broadcast(empty).join(found, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lines", "none").alias("lines"))


def prompt(found: DataFrame, as_of: dt.date) -> DataFrame:
    """One row with the prompt text of the two blocks."""
    text = lambda b: F.max(F.when(F.col("block") == b, F.col("lines")))
    day = F.date_format(F.lit(as_of), "EEEE, MMMM d, yyyy")
    return found.agg(text("today").alias("t"), text("upcoming").alias("u"), F.sum("n").alias("event_count")).select(
        F.concat(F.lit("Today is "), day, F.lit(". Write the daily briefing.\n\nTODAY'S EVENTS:\n"), "t", F.lit("\n\nNEXT 6 DAYS:\n"), "u").alias("prompt"), "event_count"
    )


def template_writer(prompts: DataFrame) -> DataFrame:
    """The deterministic writer: the prompt's own text."""
    return prompts.withColumn("briefing", F.col("prompt"))


def run(events: DataFrame, config: DataFrame, as_of: dt.date, now: str, writer: Callable[[DataFrame], DataFrame] = template_writer) -> tuple[DataFrame, DataFrame]:
    """The result row (ok, briefing, event_count) and config with the text and its time saved."""
    written = writer(prompt(blocks(events, as_of), as_of))
    saved = written.select(F.lit("weekly_briefing").alias("key"), F.col("briefing").alias("value")).unionByName(written.select(F.lit("weekly_briefing_date").alias("key"), F.lit(now).alias("value")))
    return written.select(F.lit(True).alias("ok"), "briefing", "event_count"), upsert_by_key(config, saved, "key")


__all__ = ["PICK", "blocks", "line", "order_key", "prompt", "run", "template_writer"]
