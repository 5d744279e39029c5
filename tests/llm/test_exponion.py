"""Exponion search against plain k-means on whole numbers."""

import hashlib

import numpy as np
import pytest

from almanac.llm import exponion as ex


def plain(rows, k, rounds, dims, scale=256, seed="2"):
    """(id, components or None) rows to the sorted result rows, with every distance looked at."""
    kept = [(i, [int(np.floor(scale * float(y))) for y in e]) for i, e in rows if e is not None and len(e) == dims and all(y is not None and np.isfinite(y) for y in e)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    if not kept:
        return []
    for step in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, z)), j) for j, z in enumerate(c)) for _, v in kept]
        if step < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, n) in zip(kept, own) if n == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    total, each = sum(d for d, _ in own), {}
    for d, j in own:
        each[j] = each.get(j, 0) + d
    sha = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted([(i, j, d, each[j], total, sha(j)) for (i, _), (d, j) in zip(kept, own)], key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e, 3, "clash", "clash") for i, e in rows], f"vec_id long, embedding array<{kind}>, cluster int, x string, v string")


@pytest.mark.parametrize("case", ["spread", "grid", "far", "same"])
def test_against_plain(spark, case):
    """Spread vectors, whole-number grids full of ties, components that need 32 bits and integer products, and equal vectors."""
    rng = np.random.default_rng(7)
    make = {"spread": lambda: rng.normal(0, 0.3, 4), "grid": lambda: rng.integers(-2, 3, 4) / 256, "far": lambda: rng.normal(0, 3e4, 4), "same": lambda: np.full(4, 0.5) if rng.random() < 0.5 else rng.integers(0, 2, 4).astype(float)}[case]
    rows = [(k, [float(np.float32(y)) for y in make()]) for k in range(300)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [1.0, float("inf"), 0.0, 0.0]), (906, [0.0] * 5)]
    for k, rounds in ((12, 5), (1, 2), (40, 0), (400, 3)):
        got = sorted((tuple(r) for r in ex.clusters(table(spark, rows).repartition(3), k, rounds, 4).collect()), key=str)
        assert got == plain(rows, k, rounds, 4)


def test_bounds_spare_distances():
    """The states of five rounds equal a full search, with far fewer distances; bounds hold."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-300, 300, (40, 16))
    x = middles[rng.integers(0, 40, 4000)] + rng.integers(-25, 26, (4000, 16))
    c, before, looked = x[:40].copy(), None, []
    state = (np.full(len(x), -1, np.int32), np.zeros(len(x)), np.zeros(len(x)))
    for _ in range(6):
        s = ex.Search(c, before)
        *state, n = s.assign(x, *state)
        looked.append(n)
        far = ex.squared(x, c)
        assert (state[0] == far.argmin(1)).all()
        own = np.sqrt(far.min(1))
        far[np.arange(len(x)), state[0]] = np.iinfo(np.int64).max
        assert (own <= state[1] + 1e-9).all() and (np.sqrt(far.min(1)) >= state[2] - 1e-9).all()
        before, c = c, np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(40)])
    assert sum(looked[1:]) < 0.35 * 5 * x.shape[0] * 40


def test_odd_tables(spark):
    assert ex.clusters(table(spark, []), 3, 2, 4).count() == 0
    assert ex.clusters(table(spark, [(1, None), (2, [float("nan")] * 4)]), 3, 2, 4).count() == 0
    rows = [(1, [0.1, -0.1, 1e3, -1e3])]
    assert [tuple(r) for r in ex.clusters(table(spark, rows, "double"), 3, 2, 4).collect()] == plain(rows, 3, 2, 4)
    with pytest.raises(Exception, match="exact"):
        ex.clusters(table(spark, [(1, [1e9] * 4)]), 3, 2, 4).collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, oracle, sf):
    assert oracle(spark, "op13_centroid_clusters", f"/root/testdata/{sf}") > 0
