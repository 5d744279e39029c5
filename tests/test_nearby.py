"""Places within a distance, against all pairs."""

import math
import random

import pytest

from almanac.operators import nearby


def far(a, b):
    (y1, x1), (y2, x2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * nearby.EARTH_KM * math.asin(math.sqrt(min(1, h)))


def globe(rng, n):
    """Places all over, at the poles, on the date line and in a heap; some without a place or off the globe."""
    kinds = [
        lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180)), lambda: (rng.choice([90.0, -90.0, 89.99, -89.99, 88.0]), rng.uniform(-180, 180)),
        lambda: (rng.uniform(-60, 60), rng.choice([180.0, -180.0, 179.99, -179.99])), lambda: (38 + rng.random() / 10, -120 + rng.random() / 10), lambda: rng.choice([(None, 1.0), (1.0, None), (91.0, 0.0), (0.0, 181.0), (math.nan, 0.0)]),
    ]
    return [(k, *rng.choice(kinds)()) for k in range(n)]


@pytest.mark.parametrize(("km", "rows"), [(3.0, 100_000), (500.0, 40), (8000.0, 7)])
def test_all_pairs(spark, monkeypatch, km, rows):
    monkeypatch.setattr(nearby, "CELL_ROWS", rows)  # cells are split
    rng = random.Random(int(km))
    asks, places = globe(rng, 150), globe(rng, 400)
    frame = lambda r: spark.createDataFrame(r, "id int, lat double, lng double")
    on = lambda p: None not in p and abs(p[0]) <= 90 and abs(p[1]) <= 180
    want = {(a, b): far(p, q) for a, *p in asks for b, *q in places if on(p) and on(q) and far(p, q) <= km}
    got = nearby.within(frame(asks), frame(places), km).select("ask.id", "place.id", "km").toDF("a", "b", "km").collect()
    assert len(got) == len(want) and all(abs(want[r["a"], r["b"]] - r["km"]) < 1e-6 for r in got)
    best = {}
    for (a, b), x in want.items():
        best[a] = min(best.get(a, (math.inf, 0)), (x, b))
    near = {r["id"]: r["km"] for r in nearby.nearest(frame(asks), frame(places), km, "id", "id").collect()}
    assert near.keys() == best.keys() and all(abs(near[a] - best[a][0]) < 1e-6 for a in near)


def test_edges(spark):
    none = spark.createDataFrame([], "id int, lat double, lng double")
    assert nearby.within(none, none, 5).count() == 0
    for km in (0, -1, 20_000):
        with pytest.raises(ValueError):
            nearby.within(none, none, km)


def test_nearest_sorts_after_it_deals(spark):
    """Pairs carry the ask's key alone and are dealt by it before the sort; a key that occurs twice has one nearest place."""
    asks = spark.createDataFrame([("x", 0.0, 0.0, "wide"), ("x", 1.0, 1.0, "wide"), ("y", 0.5, 0.5, "wide"), ("z", 50.0, 0.0, "wide"), (None, 0.0, 0.1, "wide")], "id string, lat double, lng double, more string")
    places = spark.createDataFrame([("b", 0.0, 0.2), ("a", 0.0, -0.2), ("c", 1.0, 1.0)], "id string, lat double, lng double")
    found = nearby.nearest(asks, places, 100.0, "id", "id")
    assert {(r["id"], r["place"]["id"]) for r in found.collect()} == {("x", "c"), ("y", "b"), (None, "b")}
    above, below = found._jdf.queryExecution().sparkPlan().toString().split("Exchange hashpartitioning(id", 1)
    assert "min_by" in above and "min_by" not in below
