"""Places in an order, against sorting."""

import datetime as dt
import random

import pytest

from almanac.operators import serve


@pytest.mark.parametrize("seed", [0, 1])
def test_numbers(spark, seed):
    """Ids that begin alike, empty and null ones, null dates and times."""
    rng = random.Random(seed)
    ids = [None, "", "a", "aaa", "aaab", "aaac", *(str(k) for k in range(80))]
    rows = [(i, rng.choice([None, dt.date(2024, 3, 1), dt.date(2024, 3, 2)]), rng.choice([None, "09:00", "10:00"])) for i in rng.sample(ids, len(ids))]
    frame = spark.createDataFrame(rows, "id string, date date, start_time string").repartition(5)
    first = lambda x: (x is not None, x or "")
    want = {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (str(r[1] or ""), r[2] or "~", first(r[0]))), 1)}
    assert {r["id"]: r["ord"] for r in serve.with_ordinal(frame).collect()} == want
    day = {}
    for i, d, _ in sorted(rows, key=lambda r: first(r[0])):
        day.setdefault(d, []).append(i)
    got = serve.numbered(frame, "date", "nth")
    assert got.columns == [*frame.columns, "nth"]
    assert {r["id"]: r["nth"] for r in got.collect()} == {i: k for d in day.values() for k, i in enumerate(d, 1)}
    assert serve.with_ordinal(frame.limit(0)).count() == 0
