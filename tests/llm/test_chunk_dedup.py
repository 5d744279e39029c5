"""Shared passages against brute force; removed text survives; texts that share no passage are left alone."""

import numpy as np
from helpers import LONG, PROSE, documents

from almanac.llm import chunk_dedup as cd


def test_gear():
    points = np.array([ord(c) for c in PROSE + "日本\U0001f600"], dtype=np.uint32)
    values = cd._mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    want = [sum(int(values[at - j]) << j for j in range(min(cd.REACH, at + 1))) % 2**32 for at in range(len(points))]
    assert cd.gear(points).tolist() == want


def _cuts(text):
    points, _, sizes = cd.collapsed([text])
    return cd.boundaries(points, sizes).tolist()


def test_boundaries():
    rng = np.random.default_rng(1)
    text = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 5000))  # no white space at all
    for own in (text, LONG[:20_000], "x" * 5000, "ab " * 2000, "Hati " * 700):
        cuts = _cuts(own)
        assert cuts[0] == 0 and cuts[-1] == len(" ".join(own.split())) + own.endswith(" ")
        assert np.diff(cuts).max() <= 2 * cd.WIDTH
    assert np.diff(_cuts(text)).max() <= cd.WIDTH and len(_cuts("x" * 5000)) < 100
    more = _cuts(text[:2000] + "中間" + text[2000:])
    moved = {c for c in _cuts(text) if c < 2000} | {c + 2 for c in _cuts(text) if c >= 2000}
    assert len(moved & set(more)) > 0.97 * len(moved)
    # Alone or among others, a text has the same windows; a run of white space is one space.
    both, alone = cd.windows([PROSE * 3, "", text, LONG[:3000]]), cd.windows([text])
    assert [d for k, d in zip(both["text"], both["digest"]) if k == 2] == alone["digest"]
    assert cd.windows([(PROSE * 3).replace(" ", " \n ")])["digest"] == cd.windows([PROSE * 3])["digest"]
    assert len(cd.windows([])["digest"]) == 0 and len(cd.windows(["", "short"])["digest"]) == 0


def test_spans_are_the_windows_text():
    text = f"  {PROSE}\n\n\U0001f600 {PROSE[::-1]} \t {LONG[:900]}"
    got = cd.windows([text])
    for a, b, digest in zip(got["start"], got["stop"], got["digest"]):
        flat = "".join(chr(c) for c in cd.collapsed([text[a:b]])[0])
        assert cd.blake2b(flat.encode("utf-32-le"), digest_size=16).digest() == digest and len(flat) >= cd.LEAST


def test_digests_of_thue_morse():
    """Strings on which every polynomial hash modulo 2**64 fails."""
    bit = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = bit.translate(str.maketrans("ab", "ba"))
    assert not set(cd.windows([bit])["digest"]) & set(cd.windows([other])["digest"]) or bit[:96] in other


def shared(a, b, least):
    """Places of a where `least` characters follow that b holds, by brute force."""
    held = {b[k : k + least] for k in range(len(b) - least + 1)}
    return [k for k in range(len(a) - least + 1) if a[k : k + least] in held]


def corpus(seed, unspaced=False):
    rng = np.random.default_rng(seed)
    if unspaced:
        text = lambda n: "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 3000, 6 * n))
    else:
        text = lambda n: " ".join(f"{rng.integers(0, 10**5):x}" for _ in range(n))
    passages, line = [text(n) for n in (45, 60, 120, 300)], text(12)
    rows = []
    for k in range(100):
        body = f"{text(80)} {line} {text(100)}"
        if k % 3 == 0:
            body += f" {passages[k % 4]} {text(30)}"
        if k % 10 == 1:
            body = f"{passages[1]} {passages[3]} {text(50)}"
        rows.append((k, body))
    return rows


def test_all_shared_passages(spark):
    """Each place where SURE characters are shared lies in or beside a passage; nothing else is reported."""
    for unspaced in (False, True):
        rows = corpus(5, unspaced)
        got = cd.repeated_passages(documents(spark, rows).repartition(4)).collect()
        texts, spans = dict(rows), {}
        for r in got:
            spans.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
        everyone = {d: {t[k : k + cd.SURE] for k in range(len(t) - cd.SURE + 1)} for d, t in rows}
        holders = {}
        for d, grams in everyone.items():
            for g in grams:
                holders.setdefault(g, set()).add(d)
        for d, t in rows:
            places = [k for k in range(len(t) - cd.SURE + 1) if len(holders[t[k : k + cd.SURE]]) > 1]
            covered = np.zeros(len(t) + 1, dtype=bool)
            for a, b in spans.get(d, []):
                assert not covered[a:b].any()
                covered[a:b] = True
            for k in places:
                assert covered[k : k + cd.SURE].sum() >= cd.LEAST
        for r in got:
            if r["removed"]:  # held whole by first_doc
                assert texts[r["doc_id"]][r["start"] : r["stop"]] in texts[r["first_doc"]]
                assert r["first_doc"] < r["doc_id"]
        assert {d for d, _ in rows if d % 3 and d % 10 != 1} & set(spans) == set()
        # Passage 2 is in the documents that divide by 3 and leave 2 by 4.
        own = [r for r in got if r["doc_id"] == 6]
        assert own and all(not r["removed"] for r in own) and all(1 < r["n_docs"] <= sum(k % 12 == 6 for k in range(100)) for r in own)


def test_no_stitched_passages(spark):
    """A text of short phrases, each from another document, is no copy of any."""
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"{rng.integers(0, 10**6):x}" for _ in range(n))
    rows = [(k, text(60)) for k in range(8)]
    rows.append((9, " ".join(" ".join(t.split()[20:30]) for _, t in rows)))
    assert cd.repeated_passages(documents(spark, rows)).count() == 0


def test_removed_text_survives(spark):
    """Chains of copies: what is cut out of a text is somewhere in what is left, and copies of a passage go but for one."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{'aeiou'[k % 5]}{k:x}" for k in range(3000)]
    prose = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 3000, n))
    passages = [prose(120) for _ in range(5)]
    rows = [(k, prose(400)) for k in range(10)]
    rows += [(20 + k, f"{prose(60)} {passages[k % 5]} {prose(60)}") for k in range(30)]
    x, y, z = prose(90), prose(90), prose(90)
    rows += [(60, f"{passages[0]} {passages[1]} {prose(50)}"), (61, f"{x} {y}"), (62, f"{x} {y} {z}"), (63, f"{' '.join(y.split()[-30:])} {z}"), (64, f"{z} {x}")]
    docs = documents(spark, rows).repartition(4)
    got = cd.repeated_passages(docs).collect()
    assert not {r["doc_id"] for r in got} & set(range(10))
    texts, gone = dict(rows), {k: np.zeros(len(t), dtype=bool) for k, t in rows}
    for r in got:
        if r["removed"]:
            assert not gone[r["doc_id"]][r["start"] : r["stop"]].any()
            gone[r["doc_id"]][r["start"] : r["stop"]] = True
    left = {r["doc_id"]: r["text"] for r in cd.without_repeats(docs).collect()}
    assert left == {k: "".join(c for c, g in zip(t, gone[k]) if not g) for k, t in rows}
    lost, stay = set(), set()
    for k, t in rows:
        cuts = _cuts(t)
        for a, b in zip(cuts, cuts[1:]):
            (lost if gone[k][a:b].all() else stay).add(t[a:b])
    assert lost and lost <= stay
    for k in range(25, 50):
        size = len(passages[k % 5])
        assert size - 3 * cd.WIDTH <= gone[k].sum() <= size + 2
    assert not any(gone[k].any() for k in range(20, 25)) and gone[62].sum() > 0.7 * len(x + y) and gone[63].sum() > 0.6 * len(z)


def test_one_hot_passage(spark, monkeypatch):
    """Hot digests take a way of their own to the same result."""
    rows = corpus(7)
    docs = documents(spark, rows).repartition(3)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(cd.repeated_passages(docs))
    for hot in (1, 100, 100_000):
        monkeypatch.setattr(cd, "HOT", min(hot, 100_000))
        assert key(cd.repeated_passages(docs)) == want and want
    monkeypatch.setattr(cd, "HOT", 100)
    more = key(cd.repeated_passages(docs, within=True))
    monkeypatch.setattr(cd, "HOT", 1)
    assert key(cd.repeated_passages(docs, within=True)) == more


def test_within(spark):
    twice = LONG[:400]
    docs = documents(spark, [(1, f"{PROSE} {twice} {PROSE[::-1]} {twice}"), (2, "x" * 3000)])
    assert cd.repeated_passages(docs).count() == 0
    got = cd.repeated_passages(docs, within=True).collect()
    one = [r for r in got if r["doc_id"] == 1]
    assert {r["removed"] for r in one} == {True, False} and all(r["first_doc"] == r["doc_id"] and r["n_docs"] == 1 for r in got)
    assert sum(r["n_chars"] for r in got if r["doc_id"] == 2 and r["removed"]) > 2500


def test_odd_rows(spark):
    long = LONG[:2000]
    docs = documents(spark, [(1, long), (1, long), (2, None), (3, ""), (None, long), (4, LONG[5000:9000]), (5, LONG[5000:9000] + " tail"), (6, LONG[20_000:21_000]), (6, LONG[20_000:21_000] + " \U0001f600 tail")])
    got = cd.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["removed"], r["first_doc"]) for r in got} == {(1, False, 1), (None, True, 1), (4, False, 4), (5, True, 4), (6, False, 6), (6, True, 6)}
    assert all(r["n_docs"] == 2 for r in got)
    left = cd.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count() and left.where("text IS NULL").count() == 1
    assert cd.repeated_passages(docs.limit(0)).count() == 0 and cd.without_repeats(docs.limit(0)).count() == 0
