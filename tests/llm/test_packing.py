"""Packing: constraints, whole results, bins near the bound."""

import zlib

import numpy as np
import pytest
from helpers import documents

from almanac.llm import packing
from almanac.llm.common import public_tokenizer


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit(score):
    rng = np.random.default_rng(1)
    need = np.stack([rng.integers(1, 60, 400), np.ones(400), rng.integers(1, 900, 400)], axis=1).astype(float)
    cap = np.array([100.0, 4.0, 2000.0])
    bins = packing.best_fit(need, cap, np.array([1.0, 0.5, 0.5]), score)
    loads = np.stack([np.bincount(bins, need[:, d]) for d in range(3)], axis=1)
    assert (loads <= cap + 1e-6).all()
    assert bins.max() + 1 <= 1.35 * (need.sum(axis=0) / cap).max()
    assert list(packing.best_fit(np.empty((0, 3)), cap, np.ones(3))) == []


def test_documents(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    rows = packing.packed_digest(docs, 64).collect()
    tok = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % 64 + 1
        for p, a in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[a : first if p == 0 else a + 64]
            want.append((r["doc_id"] or -1, p, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.packed_digest(docs.limit(0)).count() == 0


def test_other_capacities(spark):
    items = spark.createDataFrame([(k, 0, 1 + k % 9, "x") for k in range(100)], "doc_id long, piece int, length long, kept string")
    rows = packing.pack(items, 30, max_docs=3, max_attention=100, shards=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert len(rows) == 100 and all(len(x) <= 3 and sum(x) <= 30 and sum(v * v for v in x) <= 100 for x in by.values())


def test_real_ids(spark):
    found = packing.pack_documents(documents(spark), public_tokenizer("byte_bpe_50k.json"), 2, 64)
    assert all(len(r["ids"]) == 4 * r["length"] for r in found.collect())
