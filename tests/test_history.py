"""Histories and lookups as of an instant against loops."""

import random

import pytest

from almanac.operators import history


@pytest.mark.parametrize("seed", [0, 1])
def test_against_loops(spark, seed):
    """Ties, null keys, null times, null values, and clashing columns."""
    rng = random.Random(seed)
    facts = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), k, rng.choice([None, "x", "y"])) for k in range(60)]
    asks = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-1, 14)]), "old") for k in range(50)]
    f = spark.createDataFrame(facts, "k string, t int, n int, price string").repartition(3)
    a = spark.createDataFrame(asks, "id int, k string, t int, price string").repartition(2)

    def at(key, t):
        known = [(x, n, p) for k, x, n, p in facts if k == key and x is not None and t is not None and x <= t]
        return max(known, key=lambda r: r[:2])[2] if known else None

    got = history.as_of(a, f, "k", "t", ["price"], f["n"])
    assert got.columns == ["id", "k", "t", "price", "_fact_price"]
    assert sorted((r["id"], r["_fact_price"]) for r in got.collect()) == sorted((i, at(k, t)) for i, k, t, _ in asks)
    assert got.limit(0).count() == 0 and history.as_of(a.limit(0), f, "k", "t", ["price"]).count() == 0

    want = []
    for key in {k for k, *_ in facts}:
        steps = [(t, at(key, t)) for t in sorted({t for k, t, *_ in facts if k == key and t is not None})]
        kept = [s for j, s in enumerate(steps) if j == 0 or s[1] != steps[j - 1][1]]
        want += [(key, p, t, kept[j + 1][0] if j + 1 < len(kept) else None) for j, (t, p) in enumerate(kept)]
    assert sorted(map(str, (tuple(r) for r in history.intervals(f, "k", "t", ["price"], "n").collect()))) == sorted(map(str, want))
