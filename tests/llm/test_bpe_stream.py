"""The transducer against the tokenizers library and against merging one by one."""

import hashlib
import random

import numpy as np
import pytest
from helpers import documents
from test_tokens import TEXTS

from almanac.llm import bpe_stream as bpe
from almanac.llm.common import public_tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def plain(rules, symbols):
    """Merge one by one: the lowest rank, the leftmost first."""
    rank = {(a, b): (k, m) for k, (a, b, m) in enumerate(rules)}
    s = list(symbols)
    while True:
        found = min(((rank[p][0], k) for k, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
        if found is None:
            return s
        k = found[1]
        s[k : k + 2] = [rank[s[k], s[k + 1]][1]]


def random_merges(rng, letters, n):
    """A merge list in which each merge takes tokens of earlier ones and makes a new one."""
    names, rules = [chr(97 + k) for k in range(letters)], []
    for _ in range(n):
        a, b = rng.choice(names), rng.choice(names)
        if len(a + b) <= 12 and a + b not in names:
            rules.append((a, b))
            names.append(a + b)
    number = {t: k for k, t in enumerate(names)}
    size = {k: len(t) for t, k in number.items()}
    return [(number[a], number[b], number[a + b]) for a, b in rules], size


def bare(rules, size):
    m = bpe.Merges.__new__(bpe.Merges)
    key = np.array([a << 32 | b for a, b, _ in rules], dtype=np.int64)
    order = np.argsort(key)
    m.key, m.rank, m.made = key[order], order.astype(np.int64), np.array([x for _, _, x in rules], dtype=np.int64)[order]
    m.size = np.array([size[k] for k in range(len(size))], dtype=np.int64)
    m.lookahead, m.longest = bpe.lookahead(rules, size), int(m.size.max())
    return m


@pytest.mark.parametrize("seed", range(60))
def test_random_merge_lists(seed):
    """Merging in rounds, and in portions of any size, gives what merging one by one gives; nothing beyond the lookahead changes."""
    rng = random.Random(seed)
    rules, size = random_merges(rng, rng.randint(1, 3), rng.randint(2, 40))
    m = bare(rules, size)
    letters = [k for k in size if size[k] == 1]
    for _ in range(25):
        text = [rng.choice(letters) for _ in range(rng.randint(1, 90))]
        want = plain(rules, text)
        both = m.merge(np.array(text * 2), np.repeat([3, 8], len(text)))
        assert both[0].tolist() == want * 2 and both[1].tolist() == [3] * len(want) + [8] * len(want)
        machine, got, k, most = bpe.Transducer(m), [], 0, 0
        while k < len(text) - 1:
            step = rng.randint(1, 7)
            got += machine.feed(np.array(text[k : min(k + step, len(text) - 1)])).tolist()
            k, most = min(k + step, len(text) - 1), max(most, len(machine.held))
        assert got + machine.finish(text[-1]).tolist() == want and most <= m.lookahead + m.longest + 7
        # Boundaries that end before the lookahead are in the tokens of every continuation.
        here = np.cumsum(m.size[plain(rules, text)])
        for _ in range(4):
            more = np.cumsum(m.size[plain(rules, text + [rng.choice(letters) for _ in range(rng.randint(1, 30))])])
            least = len(text) - m.lookahead
            assert [x for x in here if x <= least] == [x for x in more if x <= least]


def test_lookahead_is_reached():
    """a b, then what begins with it: a chain of three ranks moves the boundary over three tokens."""
    a, b, c, d = range(4)
    rules = [(c, d, 4), (b, c, 5), (a, b, 6)]
    assert bpe.lookahead(rules, dict.fromkeys(range(4), 1) | {4: 2, 5: 2, 6: 2}) == 3
    assert plain(rules, [a, b, c]) == [a, 5] and plain(rules, [a, b, c, d]) == [6, 4]
    assert bpe.lookahead([], {}) == 0


@pytest.mark.parametrize("name", FILES)
def test_same_as_library(name, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizer(name)
    whole = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    letters = list("abcdeéßñÄst'.,!$ \n\tIX19_-日́")
    texts = TEXTS + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 400, 200)] + ["<|endoftext|>" * 3, "a<|endoftext|> b <|startoftext|><|endoftext|", "transcend" * 4000, "ab" * 9000 + "." * 9000]
    texts += ["".join(chr(c) for c in rng.integers(0x20, 0xD7FF, 300)) for _ in range(20)]
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    back = [whole.decode(x, skip_special_tokens=False) for x in want]
    for portion, limit in ((4096, 300_000), (256, 40)):
        monkeypatch.setattr(bpe, "PORTION", portion)
        enc, dec = bpe.Encoder(path, limit), bpe.Decoder(path)
        for k in range(0, len(texts), 15):
            got = [np.frombuffer(x, dtype="<u4") for x in enc.encode(texts[k : k + 15])]
            assert [x.tolist() for x in got] == want[k : k + 15]
            assert [dec.decode(x) for x in got] == back[k : k + 15]
    odd = [int(k) for k in rng.integers(0, 49_000, 3000)]  # broken characters
    assert bpe.Decoder(path).decode(np.array(odd)) == whole.decode(odd, skip_special_tokens=False)
    assert enc.merges.lookahead < 200


def digests(texts, path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    for t in texts:
        ids = whole.encode(t, add_special_tokens=False).ids
        yield len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.op11_bpe_stream(spark, f"/root/testdata/{sf}").collect()}
    assert got == dict(zip(docs, digests(docs.values(), public_tokenizer("word_bpe_49k.json"))))


def test_odd_rows(spark):
    docs, path = documents(spark), public_tokenizer("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *next(digests([r["text"] or ""], path))) for r in docs.collect())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["ids"]), hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows)
    assert got == want
    assert bpe.encode(docs.limit(0), path).count() == 0
    none = spark.createDataFrame([(1, None), (2, []), (None, [49407])], "doc_id long, ids array<int>")
    assert [(r["doc_id"], r["text"]) for r in bpe.decode(none, path).collect()] == [(1, ""), (2, ""), (None, "<|endoftext|>")]


def test_files_that_are_not_supported(tmp_path):
    import json

    spec = json.load(open(public_tokenizer("word_bpe_49k.json")))
    for change in ({"dropout": 0.1}, {"ignore_merges": True}, {"merges": [["th", "in"]]}, {"merges": [["t", "h"], ["t", "h"]]}):
        with pytest.raises(ValueError):
            bpe.Merges(spec | {"model": spec["model"] | change})
