"""The set-based upsert against a row-by-row model, and the stream over it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import upsert
from almanac.streaming import upsert_stream

SCHEMA = "source_ord int, row_ord int, id string, name string, dedup_key string, description string, start_time string, end_time string, price string, event_url string"
STORE = "id string, name string, dedup_key string, description string, start_time string, end_time string, price string, event_url string, last_scraped_at timestamp_ntz"
OLD, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def model(store, batch):
    held = {r[2]: list(r) for r in store}
    out = []
    for r in sorted(batch, key=lambda r: r[:2]):
        key, values = r[4], list(r[5:])
        if key not in held:
            held[key] = [r[2], r[3], key, *values, NOW]
            out.append((*r[:2], "insert"))
            continue
        out.append((*r[:2], "unchanged" if held[key][3:8] == values else "update"))
        held[key][3:] = [*values, NOW]
    return sorted(out), sorted(map(repr, map(tuple, held.values())))


@pytest.mark.parametrize("n", [0, 5, 60, 200])
def test_against_model(spark, n):
    rng = random.Random(n)
    pick = lambda: rng.choice([None, "a", "b"])
    store = [(f"s{k}", f"n{k}", f"k{k}", None, pick(), None, pick(), None, OLD) for k in range(0, 20, 2)]
    batch = [(rng.randint(0, 2), k, f"b{k}", f"m{k}", f"k{rng.randint(0, 25)}", None, pick(), None, pick(), None) for k in range(n)]
    s, b = spark.createDataFrame(store, STORE), spark.createDataFrame(batch, SCHEMA)
    order = ["source_ord", "row_ord"]
    want, state = model(store, batch)
    assert sorted(tuple(r) for r in upsert.outcomes(s, b, order).select(*order, "outcome").collect()) == want
    done = upsert.merge(s, b, order, F.lit(NOW).cast("timestamp_ntz"))
    assert sorted(repr(tuple(r)) for r in done.collect()) == state


def test_golden_counters(spark):
    rows = [(0, 1, "1", "x", "K", None, None, None, "$5", None), (0, 2, "2", "x", "K", None, None, None, "$5", None), (0, 3, "3", "x", "K", None, None, None, None, None), (0, 4, "4", "x", "K", None, None, None, None, None), (0, 5, "5", "x", "L", None, None, None, None, None)]
    empty, batch, order = spark.createDataFrame([], STORE), spark.createDataFrame(rows, SCHEMA), ["source_ord", "row_ord"]
    assert tuple(upsert.counters(upsert.outcomes(empty, batch, order)).first()) == (2, 1, 2)
    store = upsert.merge(empty, batch, order, F.lit(NOW).cast("timestamp_ntz"))
    assert tuple(upsert.counters(upsert.outcomes(store, batch, order)).first()) == (0, 2, 3)


def test_stream(spark, tmp_path):
    frame = spark.createDataFrame([("1", "x", "K", None, None, None, "$5", None, OLD)], STORE)
    frame.write.mode("append").parquet(str(tmp_path / "in"))
    for price in ("$6", "$7"):
        query = upsert_stream.start(spark.readStream.schema(STORE).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), ["id"], F.lit(NOW).cast("timestamp_ntz"))
        query.awaitTermination()
        frame.withColumn("price", F.lit(price)).write.mode("append").parquet(str(tmp_path / "in"))
    store = upsert_stream.latest(spark, str(tmp_path / "store"), frame.schema)
    assert [r["price"] for r in store.collect()] == ["$6"]


def files(path):
    """Each data file under path with its bytes."""
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("*.parquet")}


@pytest.mark.parametrize("n", [0, 60])
def test_store_against_model(spark, tmp_path, n):
    """Batches applied to a bucketed store one after another leave what the row-by-row model leaves, at each version."""
    rng = random.Random(n)
    pick = lambda: rng.choice([None, "a", "b"])
    store = [(f"s{k}", f"n{k}", f"k{k}", None, pick(), None, pick(), None, OLD) for k in range(0, 20, 2)]
    held = upsert.EventStore(spark, str(tmp_path / "store"), spark.createDataFrame(store, STORE).schema, 7)
    order, states = ["source_ord", "row_ord"], []
    for version in range(3):
        batch = [(rng.randint(0, 2), k, f"b{version}{k}", f"m{k}", f"k{rng.randint(0, 25)}", None, pick(), None, pick(), None) for k in range(n)]
        if version == 0:
            first = spark.createDataFrame(store, STORE)
            held.events.put(first, 0)
            held.seen.put(first, 0)
        else:
            held.apply(spark.createDataFrame(batch, SCHEMA), order, F.lit(NOW).cast("timestamp_ntz"), version)
            _, want = model(store, batch)
            store = [eval(x, {"datetime": dt}) for x in want]
        states.append(sorted(map(repr, store)))
        assert sorted(repr(tuple(r)) for r in held.read().collect()) == states[-1]
    for version in range(3):
        assert sorted(repr(tuple(r)) for r in held.read(version).collect()) == states[version]


def test_store_rewrites_only_what_changes(spark, tmp_path):
    frame = spark.createDataFrame([(f"{k}", "x", f"K{k}", None, None, None, "$5", None, OLD) for k in range(200)], STORE)
    held, now = upsert.EventStore(spark, str(tmp_path / "store"), frame.schema, 16), F.lit(NOW).cast("timestamp_ntz")
    held.apply(frame, ["id"], now)
    before = files(tmp_path / "store")
    # Two events change, one is only seen again.
    batch = frame.where("id IN (3, 4)").withColumn("price", F.lit("$6")).unionByName(frame.where("id = 77"))
    events, times = held.apply(batch, ["id"], now, 1)
    assert 1 <= len(events) <= 2 and len(events) <= len(times) <= 3
    after = files(tmp_path / "store")
    assert all(after[f] == raw for f, raw in before.items())  # nothing is replaced in place
    new = {f.split("/version=")[0] for f in set(after) - set(before) if "/rows/" in f}
    assert new == {f"events/rows/bucket={b}" for b in events} | {f"seen/rows/bucket={b}" for b in times}
    # Once more, as after a lost answer: nothing at all changes; nor does a batch without news touch events.
    assert held.apply(batch, ["id"], now, 1) == ([], []) and files(tmp_path / "store") == after
    assert held.apply(batch, ["id"], now, 2)[0] == []
    assert {r["id"]: r["price"] for r in held.read().collect()} == {f"{k}": "$6" if k in (3, 4) else "$5" for k in range(200)}
    assert held.read(0).where("price = '$6'").count() == 0
    # Of the touched buckets alone, files are read.
    read = held.events.read_touched(batch).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in read} == {str(b) for b in held.events.touched(batch)} and len(read) <= 3
    # What only older versions read goes.
    assert held.vacuum() > 0 and {r["id"]: r["price"] for r in held.read().collect()} == {f"{k}": "$6" if k in (3, 4) else "$5" for k in range(200)}
    assert len(files(tmp_path / "store")) < len(after)


def test_store_after_a_failure(spark, tmp_path):
    """A batch that failed after its rows were written, before its heads, is made again without a row twice."""
    import shutil

    frame = spark.createDataFrame([(f"{k}", "x", f"K{k}", None, None, None, "$5", None, OLD) for k in range(50)], STORE)
    held, now = upsert.EventStore(spark, str(tmp_path / "store"), frame.schema, 4), F.lit(NOW).cast("timestamp_ntz")
    held.apply(frame, ["id"], now, 0)
    batch = frame.where("id < 9").withColumn("price", F.lit("$7"))
    held.apply(batch, ["id"], now, 1)
    want = sorted(map(str, held.read().collect()))
    for heads in ("seen", "events"):  # first only the times' heads are lost, then the events' too
        shutil.rmtree(tmp_path / "store" / heads / "heads" / "version=1")
        again = upsert.EventStore(spark, str(tmp_path / "store"), frame.schema)
        assert again.events.buckets == 4
        again.apply(batch, ["id"], now, 1)
        assert sorted(map(str, again.read().collect())) == want


def test_keyed_table_odd_rows(spark, tmp_path):
    """Null keys are one key, empty changes make a version, extra and clashing columns go."""
    from almanac.operators.keyed import KeyedTable

    frame = spark.createDataFrame([(None, 1, "x"), ("a", 2, "x")], "k string, v int, bucket string")
    t = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k string, v int").schema, "k", 3)
    assert t.version() == -1 and t.read().count() == 0 and t.vacuum() == []
    assert t.put(frame.limit(0)) == [] and t.version() == 0 and t.read().count() == 0
    t.put(frame)
    t.put(spark.createDataFrame([(None, 5, 9)], "k string, v int, extra int"))
    assert sorted((r["k"] or "", r["v"]) for r in t.read().collect()) == [("", 5), ("a", 2)]
