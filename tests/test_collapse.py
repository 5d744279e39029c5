"""Collapse of series: artists in order of appearance, null and empty artists, single rows."""

import datetime as dt

from almanac.operators import serve


def test_artists(spark):
    day = lambda k: dt.date(2024, 3, k)
    rows = [
        ("1", "Fair - Day 2", day(2), "10:00", ["b", None, "a"]), ("2", "Fair - Day 1", day(1), None, ["a", "c"]), ("3", "Fair - Day 3", day(3), None, None),
        ("4", "Solo - Day 1", day(1), "09:00", ["x", "x"]), ("5", "Bare - Day 1", day(4), None, []), ("6", "Bare - Day 2", day(5), None, None),
    ]
    events = spark.createDataFrame(rows, "id string, name string, date date, start_time string, artists array<string>")
    found = {r["id"]: r for r in serve.collapse(events).collect()}
    assert set(found) == {"2", "4", "5"}
    fair, solo, bare = found["2"], found["4"], found["5"]
    assert (fair["name"], fair["artists"], fair["end_date"], fair["day_count"], fair["is_collapsed"]) == ("Fair", ["a", "c", "b", None], day(3), 3, True)
    assert (solo["name"], solo["artists"], solo["end_date"], solo["day_count"], solo["is_collapsed"]) == ("Solo - Day 1", ["x", "x"], None, None, None)
    assert (bare["name"], bare["artists"], bare["end_date"], bare["day_count"]) == ("Bare", [], day(5), 2)
    assert serve.collapse(events.limit(0)).count() == 0
