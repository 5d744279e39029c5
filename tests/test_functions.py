"""Golden cases of the text functions, filters and gates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac import dims, schemas
from almanac.functions import present, text
from almanac.operators import ingest, serve


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_series_key(spark):
    cases = {
        "Jazz Fest - Day 2": "Jazz Fest", "Jazz Fest-day3": "Jazz Fest", "Fair (through Aug 2)": "Fair", "Fair (opening day)": "Fair", "Fair (Opening Day) - Day 1": "Fair",
        "Fair - Day 1 (Opening Day)": "Fair - Day 1", "Fair - Day 1 extra": "Fair - Day 1 extra", "Fair - Day 2\n": "Fair - Day 2",
    }
    assert values(spark, text.series_key(F.col("x")), [(k,) for k in cases], "x string") == list(cases.values())


def test_slug_and_key(spark):
    rows = [("Live Music at the Brewery", "2026-03-15", "Murphys"), ("Foo - Day 1", "2026-03-15", "Angels Camp"), ("Café & Bar_1!", "2026-03-15", "Arnold")]
    got = values(spark, text.slug(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string")
    assert got == ["live-music-at-the-brewery-2026-03-15-murphys", "foo-day-1-2026-03-15-angels-camp", "caf-bar_1-2026-03-15-arnold"]
    assert values(spark, text.dedup_key(F.col("a"), F.col("b"), F.col("c")), [("A ", "b", " C")], "a string, b string, c string") == ["a52dd81bfd5e4e66d96b9f598382f6cb"]


def test_times(spark):
    cases = {"00:05": "12:05 AM", "12:00": "12:00 PM", "13:30:00": "1:30 PM", None: None, "": None, "9": None}
    assert values(spark, text.time_12h(F.col("x")), [(k,) for k in cases], "x string") == list(cases.values())
    got = values(spark, text.time_range(F.col("a"), F.col("b"), " – "), [(None, "20:00"), ("19:00", None), ("19:00", "20:00")], "a string, b string")
    assert got == [None, "7:00 PM", "7:00 PM – 8:00 PM"]


def test_percent_encode(spark):
    assert values(spark, text.percent_encode(F.lit("a b!'()*~,é")), [(1,)], "x int") == ["a%20b!'()*~%2C%C3%A9"]


@pytest.mark.parametrize(
    ("reply", "n"),
    [('```json\n[{"name":"a"},{"name":"b"}]\n```', 2), ('[{"name":"a"}]', 1), ("[]", 0), ('{"name":"a"}', 0), ('[{"name":"a"', 0), ('[{"name":"a"}] more', 0), ('```json\n[{"name":"a"}]\n```\n', 0), ("prose", 0), (None, 0)],
)
def test_extraction(spark, reply, n):
    assert values(spark, F.size(ingest.extracted(F.col("x"))), [(reply,)], "x string") == [n]


def test_visibility(spark):
    rows = [("public", None), (None, "org-3"), ("private", None), ("private", ""), ("private", "org-3"), ("private", "org-4")]
    frame = spark.createDataFrame(rows, "visibility string, org_slug string")
    assert [r[0] for r in frame.select(serve.is_visible(["org-3"])).collect()] == [True, True, False, False, True, False]
    assert [r[0] for r in frame.select(serve.is_visible([])).collect()] == [True, True, False, False, False, False]
    assert serve.toggle(["a", "b"], "a") == ["b"] and serve.toggle(["b"], "a") == ["b", "a"]


def test_corridor(spark):
    cases = {" Murphys ": True, "Murphys, CA": True, "camp": True, "": True, "Sonora": False, None: None}
    assert values(spark, ingest.on_corridor(F.col("x")), [(k,) for k in cases], "x string") == list(cases.values())


def test_gate(spark):
    long = "x" * 100
    rows = [(False, long), (True, None), (True, "x" * 99), (True, long + "404"), (True, long + "Page Not Found"), (True, long), (None, long)]
    want = ["fetch_failed", "too_short", "too_short", "not_found", "not_found", "pass", "fetch_failed"]
    assert values(spark, ingest.gate_reason(F.col("a"), F.col("b")), rows, "a boolean, b string") == want


def test_group_label(spark):
    friday, monday = F.lit(dt.date(2026, 3, 13)), F.lit(dt.date(2026, 3, 9))
    rows = [(dt.date(2026, 3, 13),), (dt.date(2026, 3, 14),), (dt.date(2026, 3, 15),)]
    assert values(spark, present.group_label(F.col("x"), friday), rows, "x date") == ["Today — March 13", "Tomorrow — March 14", "Sunday, March 15, 2026"]
    assert values(spark, present.group_label(F.col("x"), monday), rows[:1], "x date") == ["This Friday — March 13"]


def test_rejects_and_sources(spark):
    frame = spark.createDataFrame([("festival", "confirmed"), ("party", "confirmed"), (None, "maybe")], "category string, status string")
    assert [r[0] for r in schemas.with_rejects(frame).select("reject_reason").collect()] == [None, "category", "status"]
    assert dims.sources(spark).count() == 9 and dims.sources(spark, "lube-room").count() == 1
    with pytest.raises(ValueError):
        dims.sources(spark, "nowhere")


def test_relative_age(spark):
    cases = {10: "less than a minute ago", 60: "1 minute ago", 600: "10 minutes ago", 3600: "about 1 hour ago", 3600 * 5: "about 5 hours ago", 3600 * 30: "1 day ago", 3600 * 47: "2 days ago", 86400 * 40: "about 1 month ago", 86400 * 100: "3 months ago"}
    assert values(spark, present.relative_age(F.col("x")), [(float(k),) for k in cases], "x double") == list(cases.values())


def test_replies(spark):
    """Replies as a model gives them: fenced, plain, empty, no array, cut off, followed by prose."""
    from almanac import dims
    from almanac.operators import ingest

    replies = [
        ("lube-room", '```json\n[{"name": "A", "date": "2024-02-01", "town": ""}, {"name": "B", "date": "2024-02-02", "town": "Arnold", "artists": ["x", "y"]}]\n```'),
        ("gocalaveras", '[{"name": "C", "date": "2024-01-20", "town": "Sonora", "venue_name": "Hall"}]'),
        ("bear-valley", "[]"), ("branding-iron", '{"name": "D"}'), ("mystic-saloon", '[{"name": "E"'), ("visit-murphys", '[{"name": "F"}] and more'), ("watering-hole", "no events"),
    ]
    rows = ingest.extract_events(spark.createDataFrame(replies, "source_slug string, reply string"), dims.sources(spark))
    got = sorted((r["source_slug"], r["row_ord"], r["name"], r["venue_name"], r["town"], r["address"], r["artists"]) for r in rows.collect())
    assert got == [
        ("gocalaveras", 0, "C", "Hall", "Sonora", None, None), ("lube-room", 0, "A", "The Lube Room Saloon", "Dorrington", "3431 Highway 4, Dorrington, CA 95223", None),
        ("lube-room", 1, "B", "The Lube Room Saloon", "Arnold", "3431 Highway 4, Dorrington, CA 95223", ["x", "y"]),
    ]
