"""The collapsed listing by batches, against all events at once."""

import datetime as dt
import random

import pyspark.sql.functions as F
import pytest

from almanac.operators import serve
from almanac.operators.series import SeriesStore
from almanac.streaming import series_stream

SCHEMA = "id string, name string, date date, start_time string, artists array<string>, place string"


def events(seed, n=120):
    rng = random.Random(seed)
    name = lambda: rng.choice(["Fair", "Solo", "Market", None]) and f"{rng.choice(['Fair', 'Market', f'Solo {rng.randrange(40)}'])}{rng.choice(['', ' - Day 2', ' (Opening Day)'])}"
    artists = lambda: rng.choice([None, [], [rng.choice(["a", "b", "", None]) for _ in range(rng.randrange(1, 4))]])
    return [(str(k), name(), dt.date(2024, 3, rng.randrange(1, 28)), rng.choice([None, "09:00", "10:00"]), artists(), rng.choice(["x", None])) for k in range(n)]


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_batches(spark, tmp_path, seed):
    rng, rows = random.Random(seed), events(seed)
    want = rows_of(serve.collapse(spark.createDataFrame(rows, SCHEMA)))
    shuffled = rng.sample(rows, len(rows))
    store = SeriesStore(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema, 4)
    for k in range(0, 120, 40):
        again = rng.sample(shuffled[: k + 40], 30)  # events of this batch and of those before
        store.apply(spark.createDataFrame(shuffled[k : k + 40] + again, SCHEMA).withColumn("extra", F.lit(1)))
    assert rows_of(store.read()) == want
    store.apply(spark.createDataFrame([], SCHEMA))
    assert store.ids.version() == 3 and rows_of(store.read()) == want
    store.vacuum()
    assert rows_of(store.read()) == want


def test_failure_between_the_tables(spark, tmp_path, monkeypatch):
    rows = events(2, 40)
    frame = spark.createDataFrame(rows, SCHEMA)
    store = SeriesStore(spark, str(tmp_path / "s"), frame.schema, 4)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.ids, "put", fail)
        with pytest.raises(OSError):
            store.apply(frame, 0)
    store.apply(frame, 0)
    assert rows_of(store.read()) == rows_of(serve.collapse(frame))
    assert store.apply(frame, 0) == []
    assert store.apply(frame, 1) == [] and rows_of(store.read()) == rows_of(serve.collapse(frame))


def test_touched_files_only(spark, tmp_path):
    store = SeriesStore(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema, 32)
    store.apply(spark.createDataFrame(events(3), SCHEMA))
    files = lambda: {p: p.read_bytes() for p in (tmp_path / "s/parts/rows").rglob("*.parquet")}
    before = files()
    assert len(store.apply(spark.createDataFrame([("new", "Solo 1", dt.date(2024, 3, 1), None, ["z"], None)], SCHEMA))) == 1
    after = files()
    assert all(after[p] == before[p] for p in before) and len(after) == len(before) + 1


def test_rows_without_id(spark, tmp_path):
    rows = [(None, "Fair - Day 1", dt.date(2024, 3, 1), None, ["a"], None), (None, "Fair - Day 2", dt.date(2024, 3, 2), None, ["b"], None)]
    store = SeriesStore(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema, 2)
    for r in rows:
        store.apply(spark.createDataFrame([r], SCHEMA))
    found = store.read().collect()
    assert [(r["name"], r["day_count"], r["artists"]) for r in found] == [("Fair", 2, ["a", "b"])]


def test_stream(spark, tmp_path):
    rows = events(4)
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (rows[80:], rows[:50], rows[40:90]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        series_stream.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), 4).awaitTermination()
    assert rows_of(SeriesStore(spark, str(tmp_path / "store"), schema, 4).read()) == rows_of(serve.collapse(spark.createDataFrame(rows, SCHEMA)))


def test_batches_meet_the_store_without_broadcast(spark, tmp_path):
    """However small a batch looks beside its files, neither known ids nor part keys go through the driver."""
    from pyspark.sql import functions as F

    from almanac.operators.series import SeriesStore

    rows = spark.range(40).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), F.col("id") % 5).alias("name"), F.lit("2024-01-01").cast("date").alias("date"), F.lit("09:00").alias("start_time"), F.array(F.lit("x")).alias("artists"))
    store = SeriesStore(spark, str(tmp_path / "s"), rows.schema, 2)
    store.apply(rows)
    fresh = store.unseen(rows.unionByName(rows.withColumn("id", F.concat(F.lit("z"), "id"))))
    assert "BroadcastHashJoin" not in fresh._jdf.queryExecution().sparkPlan().toString() and fresh.count() == 40
