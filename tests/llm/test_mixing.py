"""Mixing: exact budgets, targets by filling up, odd rows."""

import pytest
from helpers import documents
from pyspark.sql import functions as F

from almanac.llm import mixing


def fill(sizes, weights, epochs=3):
    """Targets by repeated resharing."""
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(epochs * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and weights[i] * rest / w > epochs * sizes[i]}
        if not over:
            return [epochs * s if i in full else weights[i] * rest / w for i, s in enumerate(sizes)]
        full |= over


@pytest.mark.parametrize("sizes", [[10, 1000, 50, 3, 700], [5], [1, 1, 1], [0, 10, 0], [1, 100, 10_000, 2, 50, 9]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "_source string, size long")
    got = [r["target"] for r in mixing.source_targets(rows).orderBy("_source").collect()]
    assert got == pytest.approx(fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))]))


def test_exact_cut(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 13))) for k in range(300)]
    docs = documents(spark, rows).repartition(5)
    got = mixing.mix(docs, "doc_id", "source").collect()
    assert len(got) == 300
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(0 < r["taken"] % r["size"] for r in own) <= 1  # one document is cut
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2), "doc_id").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    mixed = mixing.mixed_documents(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("words")).collect()
    assert {r["doc_id"]: r["words"] for r in mixed} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert {r["doc_id"]: r["n"] for r in mixed} == {r["doc_id"]: r["copies"] + (r["taken"] % r["size"] > 0) for r in got if r["taken"]}


def test_one_long_document(spark):
    """A source of one document that is longer than its budget gives just the budget's words; nothing of the mix is missing."""
    long = "  ".join(f"w{k}" for k in range(20_000))
    rows = [(1, long, "a", 7, "x")] + [(k, " ".join(["v"] * 50), "b", None, "x") for k in range(2, 202)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, `a.b` string")
    for weights in ((5, 2, 1), (1, 5)):
        want = {r["source"]: r["n"] for r in mixing.mix(docs, "source", weights=weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        got = mixing.mixed_documents(docs, weights)
        assert got.columns == docs.columns
        assert {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()} == want
        for r in got.where("doc_id = 1").collect():
            assert long.startswith(r["text"]) and r["text"][-1] != " " and r["n_chars"] == (7 if r["text"] == long else len(r["text"]))
        assert sum(want.values()) >= sum(mixing.source_targets(spark.createDataFrame([("a", 20_000), ("b", 10_000)], "_source string, size long"), weights).agg(F.sum("target")).first()) - 2


def test_equal_rows_are_dealt_out(spark):
    """40,000 equal rows without an id spread over all ranges, and the cut among them is exact."""
    rows = spark.range(0, 40_000, 1, 6).select(F.lit("s").alias("_source"), F.lit(None).cast("long").alias("_id"), F.lit(3).cast("long").alias("size"))
    found = mixing.running_total(rows, "_source", [F.col("_id")], "size", "_before")
    assert sorted(r["_before"] for r in found.collect()) == list(range(0, 120_000, 3))
    spread = mixing.shipped(rows).withColumn("_equal", F.monotonically_increasing_id()).repartitionByRange(4, "_source", "_id", "_equal").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 20_000


def test_odd_rows(spark):
    docs = documents(spark)
    assert mixing.mix(docs, "doc_id").count() == docs.count()
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0), "doc_id").count() == 0
    nothing = documents(spark, [(1, None), (2, " ")])
    assert [r["taken"] for r in mixing.mix(nothing, "doc_id").collect()] == [0, 0]


def test_sql(spark, oracle):
    assert oracle(spark, "op3_mixing") > 0
