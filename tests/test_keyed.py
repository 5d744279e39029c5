"""Lookups in a keyed table: what they find and what they read."""

import re

import pytest

from almanac.operators import keyed


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = spark.range(2000).selectExpr("concat('key-', id) AS k", "id AS v", "id % 7 AS w")
    t = keyed.KeyedTable(spark, str(tmp_path_factory.mktemp("keyed")), rows.schema, "k", 8)
    t.put(rows)
    return t


def test_get(table):
    got = table.get("key-5", "key-1999", "none")
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("key-1999", 1999), ("key-5", 5)]
    assert got.inputFiles() and {int(f.split("bucket=")[1].split("/")[0]) for f in got.inputFiles()} <= set(table.touched(table.spark.createDataFrame([("key-5",), ("key-1999",), ("none",)], "k string")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(k, ", plan)
    assert table.get().count() == 0 and table.get("none").count() == 0


def scanned(df) -> int:
    """Rows that df's scan gave, before its filters."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_bloom_filters_spare_row_groups(table):
    """A key between a row group's bounds is told by the Bloom filter to be absent, so the scan gives no row."""
    absent = [f"key-1{k}x" for k in range(8)]  # within every bucket's bounds
    assert sum(scanned(table.get(k)) for k in absent) == 0
    assert scanned(table.get("key-1234")) > 0


def test_lookup(spark, table, monkeypatch):
    """Repeated, unknown and null keys, a clashing column; broadcast or not, the same rows from the touched buckets."""
    asked = spark.createDataFrame([("key-1", 1), ("key-1", 2), ("nothing", 3), (None, 4), ("key-7", 5)], "k string, v int")
    want = [(None, 4, None), ("key-1", 1, 1), ("key-1", 2, 1), ("key-7", 5, 7), ("nothing", 3, None)]
    for most in (keyed.BROADCAST_KEYS, 2):
        monkeypatch.setattr(keyed, "BROADCAST_KEYS", most)
        got = table.lookup(asked)
        assert sorted(((r["k"], r["_asked_v"], r["v"]) for r in got.collect()), key=lambda r: (r[0] or "", r[1])) == want
        files = [f for f in got.inputFiles() if "bucket=" in f]
        assert 0 < len(files) <= 3
    assert table.lookup(asked.limit(0)).count() == 0


def test_bloom_filter_before_the_shuffle(spark, table, monkeypatch):
    """With many keys, their Bloom filter goes to the table's scan, ahead of its shuffle."""
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", 1)
    on = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in on}
    try:
        for k, v in on.items():
            spark.conf.set(k, v)
        asked = spark.range(300).selectExpr("concat('key-', id * 3) AS k", "id").where("id % 2 = 0")
        got = table.lookup(asked)
        assert "might_contain" in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.where("v IS NOT NULL").count() == 150
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_put_reads_its_rows_once(spark, tmp_path):
    """put() makes its rows once, leaves no staged ones, and of a key's rows keeps the new, a null key's too."""
    made = spark.sparkContext.accumulator(0)

    def one(row):
        made.add(1)
        return row

    frame = lambda rows: spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(one), "k string, v long")
    table = keyed.KeyedTable(spark, str(tmp_path / "once"), frame([]).schema, "k", 4)
    table.put(frame([("a", 1), ("b", 1), (None, 1)]))
    assert made.value == 3
    table.put(frame([("b", 2), ("c", 2), (None, 2)]))
    assert made.value == 6
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {("a", 1), ("b", 2), ("c", 2), (None, 2)}
    assert not list((tmp_path / "once" / "staged").iterdir())
