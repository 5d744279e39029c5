"""The audit against its SQL and against a brute-force version on odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import PROSE, documents

from almanac.llm import divergence as dv


def brute(rows, least=3, top=200):
    """(lang, source, text) rows to the report, by dictionaries and whole numbers of any size."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(dv.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for _, _, t in rows]
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (lang, source, _), own in zip(rows, words):
        counts[lang, source].update(own)
        docs[lang].update(set(own))
        langs[lang].add(source)
    found = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = lambda n, of: 1 + 10**9 * (n + 1) // (of + len(kept))  # noqa: B023, E731
        own = {s: {t: p(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: p(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((own[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, these in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(these)]
    return sorted(found)


def rows_of(n=160):
    rng = np.random.default_rng(2)
    words = [*PROSE.split(), "été", "Éa", "x", "日本", "\U0001f600a", "￮b", "word" * 20, "A_b9c"]
    rows = [(["en", "fr", None, ""][k % 4], f"s{rng.integers(0, 9)}" if k % 7 else None, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(n)]
    return [*rows, ("de", "one", "only"), ("de", "two", None), ("it", "s", "a a a"), *[("es", "all", PROSE)] * 5, ("es", "none", ""), ("es", "else", "quick quick")]


@pytest.mark.parametrize("blocks", [(2048, 256, 100_000), (3, 2, 100_000), (5, 4, -1)])
def test_against_brute_force(spark, monkeypatch, blocks):
    """One block and many, one tile and many, broadcast sizes and joined ones: the same whole numbers."""
    monkeypatch.setattr(dv, "BLOCK_TERMS", blocks[0])
    monkeypatch.setattr(dv, "TILE_SOURCES", blocks[1])
    monkeypatch.setattr(dv, "BROADCAST_LANGUAGES", blocks[2])
    rows = rows_of()
    docs = spark.createDataFrame([(k, *r, 7, "clash", "clash") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, term string, tile string").repartition(5)
    for top in (200, 4):
        got = sorted(tuple(r) for r in dv.divergence(docs, top=top).collect())
        assert got == brute(rows, top=top)
    if blocks[0] == 3:
        assert sorted(tuple(r) for r in dv.divergence(docs, least=30).collect()) == brute(rows, least=30)


def test_shares():
    for n, total in ((0, 1), (5, 6), (7, 9), (10**12, 10**13 + 7), (0, 8 * 10**15), (8 * 10**15 - 1, 8 * 10**15)):
        assert int(dv.share(np.array([n]), np.array([total]))[0]) == 1 + 10**9 * (n + 1) // total


def test_odd_rows(spark):
    docs = documents(spark)
    got = sorted(tuple(r) for r in dv.divergence(docs).collect())
    assert got == brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()]) and len(got) > 5
    assert dv.divergence(docs.limit(0)).count() == 0
    none = documents(spark, [(1, None), (2, " ")])
    assert [tuple(r)[2:5:2] for r in dv.divergence(none).collect()] in ([], [("pair", 0)] * 2)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, oracle, sf):
    assert oracle(spark, "op12_source_divergence", f"/root/testdata/{sf}") > 0
