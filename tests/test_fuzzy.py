"""The similarity join of names against all pairs, and planted misspellings."""

import itertools
import random

import pytest

from almanac.operators import fuzzy


def grams(name):
    marked = f"##{name}##"
    return {marked[k : k + 3] for k in range(len(marked) - 2)}


def digits(name):
    return "".join(c if c in "0123456789" else " " for c in name).split(), name[:1].isdigit(), name[-1:].isdigit()


def alike(a, b, percent):
    x, y = grams(a), grams(b)
    return digits(a) == digits(b) and 100 * len(x & y) >= percent * len(x | y)


def misspelled(rng, name):
    k = rng.randrange(len(name))
    return rng.choice([name[:k] + name[k + 1 :], name[:k] + name[k : k + 1] * 2 + name[k + 1 :], name[:k] + rng.choice("abcxyz") + name[k + 1 :], f" {name.upper()} ", name.replace(" ", "  \t")])


def some(rng, n):
    base = ["Summer Jazz in the Park", "Summer Jam in the Park", "Harvest Wine Stroll", "Farmers Market - Day 1", "Farmers Market - Day 2", "Été à la plage", "a", "ab"]
    rows = []
    for _ in range(n):
        name = rng.choice(base)
        rows.append((rng.choice(["d1", "d2", None]), rng.choice(["t1", "t2"]), rng.choice([name, misspelled(rng, name), None, "", "  "])))
    return rows


def plain(name):
    return " ".join((name or "").lower().split())


@pytest.mark.parametrize(("percent", "split"), [(40, 100_000), (70, 3), (100, 3)])
def test_all_pairs(spark, monkeypatch, percent, split):
    monkeypatch.setattr(fuzzy, "GRAM_ROWS", split)  # hot grams are split
    rows = some(random.Random(percent), 300)
    blocks = {}
    for day, town, name in rows:
        if day and plain(name):
            blocks.setdefault((day, town), set()).add(plain(name))
    want = {(*b, x, y) for b, names in blocks.items() for x, y in itertools.combinations(sorted(names), 2) if alike(x, y, percent)}
    found = fuzzy.similar_names(spark.createDataFrame(rows, "day string, town string, name string"), ["day", "town"], percent=percent)
    got = [(r["day"], r["town"], r["a"], r["b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and (want or percent == 100)


def test_spelling(spark):
    rng = random.Random(5)
    names = ["Summer Jazz in the Park", "Harvest Wine Stroll 2024", "Farmers Market by the River"]
    rows = [(k, "d", names[k % 3], "x") for k in range(60)] + [(100 + k, "d", misspelled(rng, names[k % 3].replace("2024", "MMXX")), "x") for k in range(0, 60) if k % 3 != 1]
    rows += [(200, None, "Summer Jaz in the Park", "x"), (201, "e", "Summer Jaz in the Park", "x"), (202, "d", None, "x")]
    frame = spark.createDataFrame(rows, "id int, day string, name string, a_name string")
    got = {r["id"]: r["spelling"] for r in fuzzy.with_spelling(frame, ["day"]).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == plain(names[i % 3 if i < 100 else (i - 100) % 3]) for i in got if i < 200)  # all planted ones
    assert got[200] == got[201] == "summer jaz in the park" and got[202] is None


def test_edges(spark):
    none = spark.createDataFrame([], "day string, name string")
    assert fuzzy.similar_names(none, ["day"]).count() == 0 and fuzzy.with_spelling(none, ["day"]).count() == 0
    for percent in (0, 101):
        with pytest.raises(ValueError):
            fuzzy.similar_names(none, ["day"], percent=percent)


@pytest.mark.parametrize("block", [1, 12, 256])
def test_small_and_large_blocks(spark, monkeypatch, block):
    """Names of small blocks meet without grams, those of large ones by rare grams; both find all pairs."""
    monkeypatch.setattr(fuzzy, "BLOCK_NAMES", block)
    monkeypatch.setattr(fuzzy, "GRAM_ROWS", 5)
    rows = some(random.Random(9), 200)
    blocks = {}
    for day, town, name in rows:
        if day and plain(name):
            blocks.setdefault((day, town), set()).add(plain(name))
    want = {(*b, x, y): (len(grams(x) & grams(y)), len(grams(x)), len(grams(y))) for b, names in blocks.items() for x, y in itertools.combinations(sorted(names), 2) if alike(x, y, 70)}
    found = fuzzy.similar_names(spark.createDataFrame(rows, "day string, town string, name string"), ["day", "town"])
    assert {(r["day"], r["town"], r["a"], r["b"]): tuple(r)[4:] for r in found.collect()} == want and want


def test_spelling_by_equal_names(spark):
    """Of a pair, the name that more rows have is the better spelling, and of equally many the first."""
    rows = [(1, "d", "jazz night"), (2, "d", "jazz nightt"), (3, "d", "jazz nightt"), (4, "e", "wine walk"), (5, "e", "wine walkk")]
    found = fuzzy.with_spelling(spark.createDataFrame(rows, "id int, day string, name string"), ["day"])
    assert {r["id"]: r["spelling"] for r in found.collect()} == {1: "jazz nightt", 2: "jazz nightt", 3: "jazz nightt", 4: "wine walk", 5: "wine walk"}
    assert "_gram" not in found._jdf.queryExecution().optimizedPlan().toString()


def _steps(plan):
    """The physical steps that ran, through adaptive plans and their stages."""
    kind = plan.nodeName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if kind.endswith("QueryStage") else []
    children = plan.children()
    yield plan
    for p in [*inner, *(children.apply(k) for k in range(children.size()))]:
        yield from _steps(p)


def _rows(plan):
    made = plan.metrics().get("numOutputRows")
    return made.get().value() if made.isDefined() else 0


def test_spelling_makes_no_pairs(spark):
    """Of a block in which all are alike no step makes a row for a pair, names are shuffled once to their block, and none go through the driver."""
    names = [f"summer jazz in the park{x}{y}" for x in "abcdefghijklmno" for y in "abcdefghij"]
    rows = [(k, d, n) for d in ("d", "e") for k, n in enumerate([*names, names[77]])]
    found = fuzzy.with_spelling(spark.createDataFrame(rows, "id int, day string, name string"), ["day"])
    got = found.collect()
    assert {r["spelling"] for r in got} == {names[77]} and len(got) == len(rows)
    steps = list(_steps(found._jdf.queryExecution().executedPlan()))
    kinds = [p.nodeName() for p in steps]
    assert max(map(_rows, steps)) <= len(rows) and "Generate" in kinds
    assert "BroadcastHashJoin" not in kinds and kinds.count("SortMergeJoin") == 1 and kinds.count("Exchange") == 3  # rows, names to blocks, spellings


@pytest.mark.parametrize("block", [1, 12, 256])
def test_spelling_in_small_and_large_blocks(spark, monkeypatch, block):
    """A block's names find their spelling in its list, or by rare grams where it is large; both give the one that most have, then the first."""
    monkeypatch.setattr(fuzzy, "BLOCK_NAMES", block)
    rows = [(k, *r) for k, r in enumerate(some(random.Random(11), 300))]
    counts = {}
    for _, day, town, name in rows:
        if day and plain(name):
            counts.setdefault((day, town), {}).setdefault(plain(name), []).append(1)
    want = {}
    for k, day, town, name in rows:
        own, near = plain(name) or None, counts.get((day, town), {})
        want[k] = min((y for y in near if y == own or alike(y, own, 70)), key=lambda y: (-len(near[y]), y)) if own and day else own
    found = fuzzy.with_spelling(spark.createDataFrame(rows, "id int, day string, town string, name string"), ["day", "town"])
    assert {r["id"]: r["spelling"] for r in found.collect()} == want
