"""The model's probabilities against a plain Kneser-Ney, and its verdicts on held-out labels."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LONG, PROSE, documents

from almanac.llm import quality_lm as lm


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, quality int, toxic int, text string")


def symbols(text, order=lm.ORDER):
    return [lm.START] * (order - 1) + [ord(c) for c in text] + [lm.END]


def plain_model(texts, order=lm.ORDER):
    """Interpolated modified Kneser-Ney over characters, by dictionaries: P(symbol | those before)."""
    tables = [Counter()]
    for t in texts:
        s = symbols(t, order)
        tables[0].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    while len(tables) < order:
        tables.append(Counter(g[1:] for g in tables[-1]))

    def level(counts, below):
        t = [sum(c == k for c in counts.values()) for k in range(1, 5)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] or t[1] else 0
        d = [k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] and (t[0] or t[1]) else 0 for k in (1, 2, 3)]
        d = [x if 0 < x < k else k / 2 for k, x in enumerate(d, 1)]
        total, freed = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            freed[g[:-1]] += min(d[min(c, 3) - 1], c)
        return lambda h, w: (max(counts.get((*h, w), 0) - d[min(counts.get((*h, w), 1), 3) - 1], 0) + freed[h] * below(h[1:], w)) / total[h] if h in total else below(h[1:], w)

    p = lambda h, w: 1 / (len(tables[-1]) + 1)
    for counts in reversed(tables):
        p = level(counts, p)
    return p


def plain_bits(p, text, order=lm.ORDER):
    s = symbols(text, order)
    return -sum(np.log2(p(tuple(s[i : i + order - 1]), s[i + order - 1])) for i in range(len(s) - order + 1))


@pytest.mark.parametrize("order", [2, 4, 8])
def test_grams(order):
    texts = ["", "ab", PROSE, "日本語 \U0001f600" * 3, "".join(chr(0x4E00 + k) for k in range(700))]
    got = defaultdict(list)
    for text, names, which in lm.grams(texts, order):  # more symbols than fit a number at order 8: in halves
        assert len(set(names)) == len(names)
        for t, w in zip(text.tolist(), which.tolist()):
            got[t].append(names[w])
    for k, t in enumerate(texts):
        s = symbols(t, order)
        assert got[k] == [b"".join(x.to_bytes(lm.WIDE, "big") for x in s[i : i + order]) for i in range(len(s) - order + 1)]
    assert list(lm.grams([])) == []


def test_against_plain_model(spark, monkeypatch):
    """Perplexities of all documents, by blocks of two sizes; each trusted part held out."""
    monkeypatch.setattr(lm, "LEAST_CHARS", 10)
    rows = [(k, f"{PROSE[3 * k : 3 * k + 60]} {LONG[70 * k : 70 * k + 90]}") for k in range(24)] + [(30, "日本語 zq"), (31, "q"), (32, PROSE)]
    docs = documents(spark, rows).withColumn("lang", lm.F.when(lm.F.col("doc_id") % 5 == 0, "fr").otherwise("en"))
    own = labels(spark, [(k, 1, 0) for k in range(16)])
    want = {}
    for lang in (0, 1):
        texts = {d: t for d, t in rows if (d % 5 == 0) == bool(lang)}
        p = plain_model([texts[d] for d in texts if d < 16])
        want |= {d: 2 ** (plain_bits(p, t) / (len(t) + 1)) for d, t in texts.items()}
    for size in (64_000_000, 300):
        monkeypatch.setattr(lm, "BLOCK_BYTES", size)
        monkeypatch.setattr(lm, "SLICE_BYTES", size)
        got = {r["doc_id"]: r["perplexity"] for r in lm.score(docs.repartition(5, "doc_id"), own).collect()}
        assert got == pytest.approx(want, rel=1e-9)
    fold = {r["doc_id"]: r["fold"] for r in lm.trusted_parts(docs, lm.trusted_ids(own)).collect()}
    assert sorted(fold) == list(range(16)) and set(fold.values()) == {0, 1}
    texts = {d: t for d, t in rows if d < 16 and d % 5}
    held = {d: plain_bits(plain_model([t for e, t in texts.items() if fold[e] != fold[d]]), texts[d]) for d in texts}
    mean = sum(held.values()) / sum(len(texts[d]) + 1 for d in held)
    limit = max((b + lm.PRIOR * mean) / (len(texts[d]) + 1 + lm.PRIOR) for d, b in held.items())  # Q of 13
    row = lm.score(docs, own).where("doc_id = 1").first()
    assert row["threshold"] == pytest.approx(2**limit, rel=1e-6)


def test_held_out(spark):
    """Labels of even documents train; on those of odd ones, nine of ten bad documents go and good ones stay."""
    d = "/root/testdata/sf0.1"
    docs, all_labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = lm.score(docs, all_labels.where("doc_id % 2 = 0")).join(all_labels.where("doc_id % 2 = 1"), "doc_id").where("n_chars > 0").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1 and not r["toxic"]], [r["kept"] for r in got if r["quality"] == 0]
    print("kept", np.mean(good), len(good), np.mean(bad), len(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_order_of_words(spark):
    """A text of the trusted texts' words in another order has a perplexity above the threshold."""
    rng = np.random.default_rng(4)
    parts = [["the old man", "a young girl", "my small dog"], ["walked slowly", "ran quickly", "went home"], ["through the wood.", "over the hill.", "along the river."]]
    text = lambda n: " ".join(p[rng.integers(0, 3)] for _ in range(n) for p in parts)
    rows = [(k, text(30)) for k in range(80)]
    rows += [(100 + k, " ".join(rng.permutation(text(30).split()))) for k in range(10)]
    docs = documents(spark, rows).withColumn("lang", lm.F.lit("en"))
    kept = {r["doc_id"]: r["kept"] for r in lm.score(docs, labels(spark, [(k, 1, 0) for k in range(60)])).collect()}
    assert not any(kept[k] for k in range(100, 110)) and sum(kept[k] for k in range(60, 80)) >= 18


def test_repeated_trusted_texts(spark):
    """Copies of the trusted text change neither threshold nor verdicts; near copies are left out together, mostly."""
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "san") for b in ("den", "ler", "ba", "st", "nop", "wi")]
    text = lambda: " ".join(rng.choice(words, 60))
    rows = [(k, text()) for k in range(160)] + [(500 + k, "".join(rng.choice(list("zqxj%#"), 200))) for k in range(10)]
    lang = lambda d: d.withColumn("lang", lm.F.lit("en"))
    own = [(k, 1, 0) for k in range(100)]
    once = {r["doc_id"]: (r["kept"], r["threshold"]) for r in lm.score(lang(documents(spark, rows)), labels(spark, own)).collect()}
    twice = rows + [(1000 + k, t.upper() + "  ") for k, t in rows[:100]]
    again = {r["doc_id"]: (r["kept"], r["threshold"]) for r in lm.score(lang(documents(spark, twice)), labels(spark, own + [(1000 + k, 1, 0) for k in range(100)])).collect()}
    assert all(again[k][0] == v[0] and again[k][1] == pytest.approx(v[1], rel=1e-9) for k, v in once.items())
    near = [(2000 + k, t + " extra") for k, t in rows[:100]]
    parts = {r["doc_id"]: r["fold"] for r in lm.trusted_parts(documents(spark, rows[:100] + near), spark.createDataFrame([(k,) for k, _ in rows[:100] + near], "doc_id long")).collect()}
    assert len(parts) == 200 and np.mean([parts[k] == parts[2000 + k] for k in range(100)]) > 0.9


@pytest.mark.parametrize("texts", [[PROSE, PROSE + " end"], [PROSE] * 2, [PROSE + " a", "the " + PROSE, PROSE]])
def test_near_equal_trusted_texts_keep_themselves(spark, monkeypatch, texts):
    """Where n-grams have counts of two or three only, discounts stay below the counts and the trusted texts stay."""
    monkeypatch.setattr(lm, "LEAST_CHARS", 100)
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, PROSE[k : k + 120]) for k in range(20)]
    docs = documents(spark, rows).withColumn("lang", lm.F.lit("en"))
    got = {r["doc_id"]: r for r in lm.score(docs, labels(spark, [(k, 1, 0) for k in range(len(texts))])).collect()}
    assert all(got[k]["kept"] for k in range(len(texts))) and all(got[k]["perplexity"] < 8 for k in range(len(texts)))


def test_odd_rows(spark):
    docs = documents(spark)
    none = labels(spark, [])
    for own in (none, labels(spark, [(1, 1, 0), (1, 1, 0), (5, 1, None), (8, 1, 1), (None, 1, 0), (9, None, 0)])):
        rows = lm.score(docs, own).collect()
        assert len(rows) == docs.count() and all(r["kept"] for r in rows if r["doc_id"] == 1)
        assert not any(r["kept"] for r in rows if not r["n_chars"])
        assert {r["lang"] for r in rows} == {r["lang"] for r in docs.collect()}
        assert lm.score(docs.limit(0), own).count() == 0
        good = lm.good_documents(docs, own)
        assert good.schema == docs.schema and good.count() == sum(r["kept"] for r in rows)
    assert {r["doc_id"] for r in lm.trusted_ids(labels(spark, [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, None), (None, 1, 0)])).collect()} == {3}


def test_shuffled_labels_and_languages(spark, monkeypatch):
    """Joins in place of broadcasts give the same; a changed partition is an error, not another result."""
    monkeypatch.setattr(lm, "LEAST_CHARS", 1000)
    rows = [(k, PROSE[k : k + 150]) for k in range(40)]
    docs, own = documents(spark, rows), labels(spark, [(k, 1, 0) for k in range(30)])
    want = {r["doc_id"]: (round(r["perplexity"], 6), r["kept"]) for r in lm.score(docs, own).collect()}
    monkeypatch.setattr(lm, "BROADCAST_IDS", -1)
    monkeypatch.setattr(lm, "BROADCAST_LANGUAGES", -1)
    assert {r["doc_id"]: (round(r["perplexity"], 6), r["kept"]) for r in lm.score(docs, own).collect()} == want and len(want) == 40
