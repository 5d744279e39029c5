"""Index and ranking against a plain model."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from almanac.operators import search


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def ranked(texts, query, k):
    docs = {i: split(t) for i, t in texts}
    mean = max(sum(map(len, docs.values())), 1) / max(len(docs), 1)
    scores = {}
    for w in dict.fromkeys(split(query)):
        df = float(sum(w in d for d in docs.values()))
        weight = float(math.floor(math.log(1.0 + (len(docs) - df + 0.5) / (df + 0.5)) * 1e6))
        for i, d in docs.items():
            if tf := float(d.count(w)):
                scores[i] = scores.get(i, 0) + math.floor(weight * (tf * (search.K1 + 1)) / (tf + search.K1 * (1 - search.B + search.B * len(d) / mean)))
    return [(n + 1, i, s) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]


@pytest.mark.parametrize("few", [search.BROADCAST_TERMS, 0])
def test_against_model(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search, "BROADCAST_TERMS", few)
    rng = random.Random(1)
    pool = ["wine", "Wine", "jazz", "the", "été", "42", "park", "in", "a-b"]
    texts = [(f"d{k}", rng.choice([None, "", "!?", *(" ".join(rng.choices(pool, k=n)) for n in (1, 3, 9, 200))])) for k in range(120)]
    index = search.SearchIndex(spark, str(tmp_path)).build(spark.createDataFrame(texts, "id string, text string").withColumn("term", F.lit(1)), 4)
    asks = [("q1", "wine in the park"), ("q2", "jazz jazz JAZZ"), ("q3", "absent"), ("q4", None), ("q5", "ÉTÉ 42 absent"), ("q6", "a b")]
    queries = spark.createDataFrame(asks, "query string, text string")
    got = {}
    for r in index.search(queries, 7).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    want = {q: x for q, t in asks if (x := ranked(texts, t, 7))}
    assert {q: sorted(x) for q, x in got.items()} == want
    times = {}
    for q, t in asks:
        for i, text in texts:
            d, w = split(text), split(t)
            if n := sum(d[k : k + len(w)] == w for k in range(len(d))) if w else 0:
                times[q, i] = n
    assert {(r["query"], r["id"]): r["times"] for r in index.phrases(queries).collect()} == times and times


def test_empty(spark, tmp_path):
    index = search.SearchIndex(spark, str(tmp_path)).build(spark.createDataFrame([], "id string, text string"), 4)
    asks = spark.createDataFrame([("q", "wine")], "query string, text string")
    assert index.search(asks).count() == 0 and index.phrases(asks).count() == 0


def test_reads_asked_shards(spark, tmp_path):
    texts = spark.range(200).select(F.col("id").cast("string"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    index = search.SearchIndex(spark, str(tmp_path)).build(texts, 8)
    found = index.search(spark.createDataFrame([("q", "word7")], "query string, text string"))
    assert [r["id"] for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard#\d+ = \d+", plan) and "WindowGroupLimit" in plan


def test_asked_twice(spark, tmp_path):
    """A query that comes twice is one query; its words meet in a text's row, not as rows for each query and place."""
    texts = [("a", "the wine and the wine"), ("b", "wine the"), ("c", "")]
    index = search.SearchIndex(spark, str(tmp_path)).build(spark.createDataFrame(texts, "id string, text string"), 4)
    found = index.phrases(spark.createDataFrame([("q", "the wine"), ("q", "the wine"), ("r", "the absent")], "query string, text string"))
    assert [tuple(r) for r in found.collect()] == [("q", "a", 2)]
    rows = {(r["term"], r["id"], r["length"]): r["places"] for r in index._postings().collect()}
    assert rows == {("the", "a", 5): [0, 3], ("wine", "a", 5): [1, 4], ("and", "a", 5): [2], ("wine", "b", 2): [0], ("the", "b", 2): [1]}


def test_alike_texts_score_once(spark, tmp_path):
    """Of texts that score alike for every query, k are scored, and the first ids win."""
    texts = spark.range(500).selectExpr("lpad(id, 3, '0') AS id", "concat('red wine ', id) AS text")
    index = search.SearchIndex(spark, str(tmp_path)).build(texts, 4)
    found = index.search(spark.createDataFrame([("q", "red wine"), ("r", "wine 7")], "query string, text string"), 3)
    assert [r["id"] for r in found.orderBy("query", "rank").collect()] == ["000", "001", "002", "007", "000", "001"]
    assert re.search(r"WindowGroupLimit \[length#\d+, _found#\d+\]", found._jdf.queryExecution().executedPlan().toString())
