"""Exact dedup against brute force, with colliding digests and odd rows."""

import re
from collections import defaultdict

import pytest
from helpers import PROSE, documents
from pyspark.sql import functions as F

from almanac.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[ \t-\r]", "", t or "")].append((-len(t or ""), d is None, d))
    out = []
    for t, own in groups.items():
        best = min(own, key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(d, best[2], len(own)) for _, _, d in own]
    return sorted(map(repr, out))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_brute_force(spark, digest):
    docs = documents(spark).repartition(3)
    docs = docs.unionByName(documents(spark, [(100 + k, "hot text") for k in range(200)] + [(500 + k, f"text {k % 20}") for k in range(60)]))
    got = exact_dedup.find_copies(docs, digest).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == brute(rows)
    assert sum(r["kept"] for r in got) == len({re.sub(r"[ \t-\r]", "", t or "") for _, t in rows})


def test_dropped_rows(spark):
    docs = documents(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"[ \t-\r]", "", r["text"] or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[ \t-\r]", "", r["text"] or "") for r in docs.collect()})
    assert {r["doc_id"] for r in left.where(F.col("text").startswith(PROSE)).collect()} == {7}  # the longest original
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0 and exact_dedup.find_copies(docs.limit(0)).count() == 0


def test_sql(spark, oracle):
    assert oracle(spark, "op4_exact_dedup") > 0
