"""The order-free upsert against rows applied one by one in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators.ordered import OrderedStore
from almanac.operators.upsert import MUTABLE, merge
from almanac.streaming import ordered_stream

ROW = "at timestamp_ntz, source string, row int, id string, name string, dedup_key string, description string, start_time string, end_time string, price string, event_url string"
ORDER = ["at", "source", "row"]


def some_rows(rng, n):
    pick = lambda: rng.choice([None, "", "a", "b"])
    when = lambda: rng.choice([None, *(dt.datetime(2024, 1, d) for d in range(1, 6))])
    return [(when(), rng.choice([None, "s", "t"]), k, f"i{k}", f"n{k}", rng.choice([None, *(f"k{j}" for j in range(12))]), *(pick() for _ in MUTABLE)) for k in range(n)]


def model(rows):
    """Rows applied one by one, by their place in the order; nulls first."""
    held = {}
    for r in sorted(set(rows), key=lambda r: tuple((x is not None, x) if x is not None else (False,) for x in r[:3])):
        held[r[5]] = (*held.get(r[5], r[3:6])[:3], *r[6:])
    return sorted(map(repr, held.values()))


def stored(store):
    return sorted(repr(tuple(r)) for r in store.read().select("id", "name", "dedup_key", *MUTABLE).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_and_repeated_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = some_rows(rng, 80)
    again = rows + rng.choices(rows, k=30)
    rng.shuffle(again)
    store = OrderedStore(spark, str(tmp_path), spark.createDataFrame([], ROW).schema, ORDER, 4)
    for k in range(0, len(again), 50):
        store.apply(spark.createDataFrame(again[k : k + 50], ROW))
    assert stored(store) == model(rows)
    version = store.states.version()
    assert store.apply(spark.createDataFrame(rows, ROW)) == []  # nothing is new, so no bucket is written
    assert store.apply(spark.createDataFrame([(None, None, -1, *rows[0][3:])], ROW), version) == []  # a version that is there
    assert stored(store) == model(rows) and store.vacuum() > 0 and stored(store) == model(rows)


def test_as_upsert_in_one_batch(spark, tmp_path):
    rows = spark.createDataFrame([r for r in some_rows(random.Random(3), 60) if r[5]], ROW)
    store = OrderedStore(spark, str(tmp_path), rows.schema, ORDER, 4)
    store.apply(rows.withColumn("extra", F.lit(1)))
    empty = spark.createDataFrame([], ROW).drop(*ORDER).withColumn("last_scraped_at", F.lit(None).cast("timestamp_ntz"))
    at_once = merge(empty, rows, ORDER, F.lit(None).cast("timestamp_ntz")).select("id", "name", "dedup_key", *MUTABLE)
    assert stored(store) == sorted(repr(tuple(r)) for r in at_once.collect())


def test_conflict_and_empty(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    one, two = (None, "s", 1, "x", "n", "k", "d", None, None, None, None), (None, "s", 1, "y", "m", "k", "e", None, None, None, None)
    found = []
    for n, batches in enumerate([([one], [two], []), ([two], [], [one]), ([one, two],)]):
        store = OrderedStore(spark, str(tmp_path / str(n)), schema, ORDER, 2)
        assert store.read().count() == 0
        for b in batches:
            store.apply(spark.createDataFrame(b, ROW))
        found.append(stored(store))
    assert found[0] == found[1] == found[2] and len(found[0]) == 1


def test_stream(spark, tmp_path):
    rows = some_rows(random.Random(4), 60)
    for part in (rows[40:], rows[:20] + rows[50:], rows[20:40] + rows[:5]):  # late and again
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
        ordered_stream.start(stream, str(tmp_path / "store"), str(tmp_path / "check"), ORDER, 4).awaitTermination()
    store = OrderedStore(spark, str(tmp_path / "store"), spark.createDataFrame([], ROW).schema, ORDER)
    assert store.states.version() == 2 and stored(store) == model(rows)
