"""Base counts against a plain reading of the rules; the estimate against planted outliers."""

import re
from collections import defaultdict

import numpy as np
from helpers import ROWS, documents

from almanac.llm import outliers

W = r"[^\x20\x09-\x0D]+"


def plain(text):
    words = re.findall(W, text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    marked = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    lines, dup, known = text.split("\n"), 0, set()
    for x in lines:
        if re.search(W, x):
            dup += x in known
            known.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


TEXTS = [
    *(t or "" for _, t in ROWS), "a b c d e f g h " * 3, "x " * 9, "x " * 8, "one\ntwo\none\n\n\n two\n one", "# * $ <|> é&é %", "a\x0bb\x0cc\rd\x1ce\x85f g", "w1 w2 w3 w4 w5 w6 w7 w8 z w1 w2 w3 w4 w5 w6 w7 w8 w9",
]


def test_base_counts():
    got = outliers.base_counts(TEXTS)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(got[c][k]) for c in names) for k in range(len(TEXTS))] == [plain(t) for t in TEXTS]


def test_windows_that_share_a_hash(monkeypatch):
    """With every hash equal, windows are still told apart by their words."""
    monkeypatch.setattr(outliers.np, "uint64", np.uint64)
    words = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 3] * 2)
    docs = np.repeat([0, 1], 18)
    assert outliers.repeated_words(words, docs, 3).tolist() == [16, 16, 0]


def test_verdicts(spark):
    rng = np.random.default_rng(2)
    vocab = [f"{a}{b}" for a in ("ba", "co", "dir", "e", "fo") for b in ("la", "ne", "s", "tir", "u", "wen")]
    rows = [(k, " ".join(rng.choice(vocab, rng.integers(60, 400))) + ".\n") for k in range(600)]
    odd = [(1000 + k, " ".join(f"{w}$$$###" for w in rng.choice(vocab, 120))) for k in range(60)]
    odd += [(2000 + k, " ".join(str(w) * 12 for w in rng.choice(vocab, 120))) for k in range(60)]
    found = outliers.judge(outliers.statistics(documents(spark, rows + odd + [(1, None), (None, "")]))).collect()
    assert len(found) == 722
    assert all(r["kept"] for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and not r["base_failed"])
    assert not any(r["kept"] for r in found if (r["doc_id"] or 0) >= 1000)
    assert all(r["base_failed"] and not r["kept"] for r in found if not r["n_words"])


def test_odd_rows(spark):
    docs = documents(spark)
    assert outliers.judge(outliers.statistics(docs)).count() == docs.count()
    assert outliers.judge(outliers.statistics(docs.limit(0))).count() == 0


def test_many_groups(spark, monkeypatch):
    """Beyond the broadcast limit the same verdicts come from salted joins."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(["alpha", "be", "gamma", "de"], 40))) for k in range(500)] + [(k, "$ " * 30) for k in range(900, 905)]
    stats = outliers.statistics(documents(spark, rows))
    want = {r["doc_id"]: r["kept"] for r in outliers.judge(stats).collect()}
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 0)
    assert {r["doc_id"]: r["kept"] for r in outliers.judge(stats).collect()} == want


def test_estimate_reaches_least_determinant(spark):
    """A cluster of a fifth of the rows: the determinant is within reach of the best of many random starts by plain numpy."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, [0.5, 0.6, 0.7, 0.8, 0.9], (400, 5)) @ (np.eye(5) + 0.3)
    x[:80] += 6
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "_group string, " + ", ".join(f"{v} double" for v in outliers.VECTOR))
    shape, n = outliers.estimate(rows)
    got = shape.first()

    def scatter(kept):
        q = np.cov(kept.T, bias=True)
        return kept.mean(0), q + np.diag(np.maximum(0, np.square(outliers.FLOOR) - np.diag(q)))

    best = np.inf
    for _ in range(60):
        c, q = scatter(x[rng.choice(400, 12, replace=False)])
        for _ in range(40):
            d = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(q), x - c)
            c, q = scatter(x[d <= np.sort(d)[299]])
        best = min(best, np.linalg.slogdet(q)[1])
    assert n == 1 and got["det_0"] <= best + 0.05
    assert np.abs(np.array([got[f"c_0_{i}"] for i in range(5)])).max() < 0.3
