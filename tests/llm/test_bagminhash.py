"""Signatures are unbiased; classes agree with brute force over all pairs."""

from collections import Counter

import numpy as np
import pytest
from helpers import LONG, PROSE, documents

from almanac.llm import bagminhash as bmh


@pytest.mark.parametrize("most", [1, 5, 40])
def test_unbiased(most):
    rng = np.random.default_rng(most)
    miss, spread = [], []
    for _ in range(80):
        element = rng.integers(1, 2**62, 60).astype(np.uint64)
        a = rng.integers(0, most + 1, 60)
        b = np.where(rng.random(60) < 0.7, a, rng.integers(0, most + 1, 60))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sign = bmh.signatures(np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2)
        miss.append((sign[0] == sign[1]).mean() - true)
        spread.append(true * (1 - true) / bmh.M)
    assert abs(np.mean(miss)) < 4 * np.sqrt(np.mean(spread) / 80)
    assert np.sqrt(np.mean(np.square(miss))) < 1.3 * np.sqrt(np.mean(spread))


def test_signature_of_one_text_alone_or_among_others():
    texts = [PROSE.encode(), b"", b"two words", LONG.encode(), PROSE.encode() * 3]
    doc, key, times = bmh.shingles(texts)
    both = bmh.signatures(key, times, doc, 5)
    for k, text in enumerate(texts):
        d, e, t = bmh.shingles([text])
        assert np.array_equal(bmh.signatures(e, t, d, 1)[0], both[k])
    assert np.bincount(doc, times, 5).tolist() == [max(0, min(len(x.split()), 1), len(x.split()) - 4) for x in texts]


def near_copies():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for base in range(25):
        text = list(rng.choice(words, rng.integers(4, 160)))
        for _ in range(rng.integers(1, 9)):
            own = list(text)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(0, len(own))] = str(rng.choice(words))
            rows.append((at, " ".join(own)))
            at += 1
    return [*rows, (at, rows[0][1]), (at + 1, rows[0][1].replace(" ", "\n")), (at + 2, None), (at + 3, ""), (at + 4, "a b"), (at + 5, "a  b"), (at + 6, LONG), (at + 7, LONG + " end")]


def similarity(a, b, size=5):
    """Weighted Jaccard similarity of the texts' multisets of word runs, by counting them."""
    runs = lambda x: Counter(tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))) if x else Counter()
    p, q = runs(a.encode().split()), runs(b.encode().split())
    both = sum((p & q).values())
    union = sum(p.values()) + sum(q.values()) - both
    return both / union if union else 0.0


def brute(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if similarity(s or "", t or "") >= 0.8:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in parent}


def test_classes(spark):
    rows = near_copies()
    want = brute(rows)
    got = bmh.near_classes(documents(spark, rows).repartition(4)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    left = bmh.first_of_each(documents(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


def test_links_across_centers(spark):
    """A chain of texts, each like the next but not like the first, is one class."""
    words = [f"v{k}" for k in range(300)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 150])) for k in range(10)]
    assert {r["class_id"] for r in bmh.near_classes(documents(spark, rows)).collect()} == set(brute(rows).values())


def test_many_blocks(spark, monkeypatch):
    """Small blocks and matrices give the same classes."""
    monkeypatch.setattr(bmh, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(bmh, "COLUMNS", 7)
    rng = np.random.default_rng(6)
    words, rows = [f"w{k}" for k in range(900)], []
    base = list(rng.choice(words, 120))
    for k in range(60):  # around 0.8 of one another
        own = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            own[at] = str(rng.choice(words))
        rows.append((k, " ".join(own)))
    want = brute(rows)
    assert 1 < len(set(want.values())) < 50
    assert {r["doc_id"]: r["class_id"] for r in bmh.near_classes(documents(spark, rows)).collect()} == want


def test_odd_rows(spark):
    docs = documents(spark)
    got = bmh.near_classes(docs)
    assert got.count() == docs.count() and bmh.near_classes(docs.limit(0)).count() == 0
    assert bmh.first_of_each(docs).columns == docs.columns
    assert {r["class_id"] for r in got.where("doc_id IN (1, 6, 7)").collect()} == {1}
