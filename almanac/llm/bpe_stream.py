"""Operator 11: byte-pair encoding as a streaming transducer of bounded lookahead, and its decoding.

The model sees each pre-token as a stream of symbols. The merge list itself
bounds how far the symbols to come can reach back: lookahead() follows the
chains of merges that hand a change on to the left. So a stream's tokens are
emitted as soon as they end that many symbols before the newest one, and a
transducer holds no more than the lookahead, the longest token and one portion,
whatever the length of the text. A boundary between tokens is crossed by no
merge, so what follows an emitted token is encoded as if it began there.

Merging is done on arrays, for many short pre-tokens or one portion of a long
one at a time: of each, the pair of the lowest rank is merged wherever it occurs.

Decoding feeds the tokens' bytes to a state machine that gives text as soon as
a character is whole and keeps at most the bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import public_tokenizer, read_table, shipped, shipped_file, text_of, text_slices
from .tokens import _BYTE_LEVEL, _LATIN, _SEPARATORS, _TAIL, _WORDS, _byte_letters, _rule

#: Symbols fed at once and merged together at most; pieces of text in each of a cache's two generations, and characters of a piece that is cached.
PORTION, CACHED, LONGEST = 4096, 300_000, 64
_NONE = np.int64(1 << 40)


def lookahead(rules: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Symbols after which no continuation changes what stands before: for merges (left, right, made) in order of rank, each of which takes tokens of earlier ones and makes a new one.

    Two continuations of one text are merged rank by rank. They agree up to a
    boundary, first the text's end. A rank moves that boundary only if its left
    token is the last one before it and its right token begins there in one of
    the two: then it moves to the left token's begin. The rank that moves it
    next, a later one, has a right token that begins with that left token, held
    there by a merge that is no earlier. So the boundary moves at most by the
    largest sum of left tokens over such chains. size: symbols of each token.
    """
    moved: dict[int, tuple[list[int], list[int]]] = {}  # by left token: ranks, and the farthest that a chain up to each of them moves
    begins: dict[int, dict[int, int]] = {}  # of each token, what it has begun with, and the rank that took that up
    most = 0
    for rank, (left, right, made) in enumerate(rules):
        before = moved[right][1][-1] if right in moved else 0
        for token, until in begins.get(right, {}).items():
            ranks, sums = moved.get(token, ([], []))
            k = bisect_right(ranks, until)
            before = max(before, sums[k - 1] if k else 0)
        here = size[left] + before
        most = max(most, here)
        ranks, sums = moved.setdefault(left, ([], []))
        ranks.append(rank)
        sums.append(max(here, sums[-1]) if sums else here)
        begins[made] = {**begins.get(left, {}), left: rank}
    return most


class Merges:
    """A tokenizer file's merge list as sorted arrays, with the lookahead that it needs."""

    def __init__(self, spec: dict):
        model = spec["model"]
        parts = [spec.get("pre_tokenizer") or {}, *(spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or not any(p.get("type") == "ByteLevel" for p in parts):
            raise ValueError("only byte-level BPE models without dropout, prefixes and ignored merges")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.vocab, bare = vocab, lambda t: len(t.removesuffix(suffix)) if suffix and t != suffix else len(t)
        letters = _byte_letters().values()
        if any(c not in vocab or c + suffix not in vocab for c in letters):
            raise ValueError("a byte has no token")
        #: Symbols by letter, within a word and at its end.
        self.inner, self.final = (np.zeros(512, np.int64) for _ in range(2))
        for c in letters:
            self.inner[ord(c)], self.final[ord(c)] = vocab[c], vocab[c + suffix]
        rules: list[tuple[int, int, int]] = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            rules.append((vocab[a], vocab[b], vocab[a + b]))
        known = {vocab[c] for c in letters} | {vocab[c + suffix] for c in letters}
        for a, b, made in rules:
            if a not in known or b not in known or made in known:
                raise ValueError("each merge must take tokens of earlier merges and make a new one")
            known.add(made)
        self.size = np.ones(max(vocab.values()) + 1, np.int64)
        for t, k in vocab.items():
            self.size[k] = bare(t)
        rank = {(a, b): (k, made) for k, (a, b, made) in enumerate(rules)}
        key = np.array([a << 32 | b for a, b in rank], dtype=np.int64)
        order = np.argsort(key)
        self.key, value = key[order], np.array(list(rank.values()), dtype=np.int64)[order]
        self.rank, self.made = value[:, 0], value[:, 1]
        self.lookahead = lookahead(rules, dict(enumerate(self.size.tolist())))
        self.longest = int(self.size.max())

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words' symbols (word: ascending numbers), with the word of each.

        In each round, each word's pairs of its lowest rank are merged, in a run
        of equal tokens from the left. What a merge makes is taken up only by
        later ranks, so this is merging one by one. Words without a pair are done.
        """
        done = []
        rank, made = self._pairs(symbols, word)
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(begin, len(symbols)))
            low = np.minimum.reduceat(rank, begin)
            if not (low < _NONE).all():
                out = np.repeat(low == _NONE, count)
                done.append((symbols[out], word[out]))
                symbols, word, rank, made = symbols[~out], word[~out], rank[~out], made[~out]
                count, low = count[low < _NONE], low[low < _NONE]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, count)
            at = np.arange(len(hit))
            run = at - np.maximum.accumulate(np.where(hit, -1, at))  # 1, 2, … along neighbouring hits
            hit &= (run & 1) == 1
            gone = np.concatenate([[False], hit[:-1]])
            symbols = np.where(hit, made, symbols)[~gone]
            word, rank, made, changed = word[~gone], rank[~gone], made[~gone], hit[~gone]
            # Pairs at a merged token and before it are looked up anew.
            near = np.flatnonzero(changed | np.concatenate([changed[1:], [False]]))
            rank[near], made[near] = self._pairs(symbols, word, near)
        if not done:
            return symbols, word
        symbols, word = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pair that begins at each place."""
        at = np.arange(len(symbols)) if at is None else at
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self._ranked(symbols[at], symbols[after])
        rank[(after == at) | (word[after] != word[at])] = _NONE
        return rank, made


class Transducer:
    """Symbols of one pre-token in, tokens out, as soon as they are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, np.empty(0, np.int64)

    def _merged(self, symbols: np.ndarray) -> np.ndarray:
        return self.merges.merge(symbols, np.zeros(len(symbols), np.int64))[0]

    def feed(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that no further symbol can change. The pre-token's last symbol goes to finish()."""
        self.held = np.concatenate([self.held, symbols])
        if len(self.held) <= self.merges.lookahead + self.merges.longest:
            return self.held[:0]
        tokens = self._merged(self.held)
        ends = np.cumsum(self.merges.size[tokens])
        stable = int(np.searchsorted(ends, len(self.held) - self.merges.lookahead, side="right"))
        self.held = self.held[int(ends[stable - 1]) if stable else 0 :]
        return tokens[:stable]

    def finish(self, last: int) -> np.ndarray:
        """The tokens left, with the pre-token's last symbol."""
        tokens, self.held = self._merged(np.append(self.held, last)), self.held[:0]
        return tokens


class Encoder:
    """Texts to ids as the tokenizers library gives them (special tokens in a text count as such), in bounded memory."""

    def __init__(self, path: str, limit: int = CACHED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normal, self.cut, self.merges = whole.normalizer, whole.pre_tokenizer, Merges(spec)
        self.rule, self.lowers = _rule(path)
        added = spec.get("added_tokens") or []
        if any(not t["special"] or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only plain special tokens")
        self.special = {t["content"]: t["id"] for t in added}
        self.mark = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if added else None
        self.letters, self.limit, self.cache, self.old = _byte_letters(), limit, {}, {}

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece of text, as byte letters."""
        core = piece.rstrip(_TAIL)
        if self.rule != "whole" and len(core) != len(piece) and core and core[-1].isalpha() and core[-1] <= _LATIN:
            return self.words(core) + self.words(piece[len(core) :])  # a Latin letter ends before ASCII punctuation
        letters = piece[1:] if self.rule == "byte" and piece[0] == " " else piece
        if self.rule != "whole" and letters.isalpha() and (letters.isascii() or (max(letters) <= _LATIN and "İ" not in letters)):
            # One pre-token: up to U+024F, NFC changes no letter and lowering one gives one.
            piece = piece.lower() if self.lowers else piece
            return [piece if piece.isascii() and letters is piece else piece.encode().decode("latin-1").translate(self.letters)]
        text = self.normal.normalize_str(piece) if self.normal else piece
        return [w for w, _ in self.cut.pre_tokenize_str(text)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each pre-token's ids as little-endian 32-bit integers: short ones together, long ones by a transducer each."""
        found: list[bytes] = [b""] * len(words)
        begin = 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (size + len(words[end]) <= 16 * PORTION or end == begin):
                size += len(words[end]) if len(words[end]) <= PORTION else 0
                end += 1
            short = [k for k in range(begin, end) if 0 < len(words[k]) <= PORTION]
            if short:
                letters = np.frombuffer("".join(words[k] for k in short).encode("utf-32-le"), dtype="<u4")
                sizes = np.array([len(words[k]) for k in short])
                symbols = self.merges.inner[letters]
                last = np.cumsum(sizes) - 1
                symbols[last] = self.merges.final[letters[last]]
                tokens, word = self.merges.merge(symbols, np.repeat(np.arange(len(short)), sizes))
                raw, ends = tokens.astype("<u4").tobytes(), np.cumsum(np.bincount(word, minlength=len(short))).tolist()
                for k, a, b in zip(short, [0, *ends], ends):
                    found[k] = raw[4 * a : 4 * b]
            for k in range(begin, end):
                if len(words[k]) > PORTION:
                    found[k] = b"".join(self._long(words[k]))
            begin = end
        return found

    def _long(self, word: str) -> Iterator[bytes]:
        machine = Transducer(self.merges)
        for a in range(0, len(word) - 1, PORTION):
            letters = np.frombuffer(word[a : min(a + PORTION, len(word) - 1)].encode("utf-32-le"), dtype="<u4")
            yield machine.feed(self.merges.inner[letters]).astype("<u4").tobytes()
        yield machine.finish(int(self.merges.final[ord(word[-1])])).astype("<u4").tobytes()

    def _fill(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of all the pieces; those of at most LONGEST characters are kept for later texts."""
        here: dict[str, bytes] = {}
        todo = []
        for p in set(pieces):
            ids = self.cache.get(p)
            if ids is None:
                ids = self.old.get(p)
                if ids is None:
                    todo.append(p)
                    continue
                self.cache[p] = ids
            here[p] = ids
        words = [self.words(p) for p in todo]
        number: dict[str, int] = {}
        for own in words:
            for w in own:
                number.setdefault(w, len(number))
        coded = self.encode_words(list(number))
        for p, own in zip(todo, words):
            here[p] = ids = b"".join([coded[number[w]] for w in own])
            if len(p) <= LONGEST:
                self.cache[p] = ids
        if len(self.cache) > self.limit:
            self.cache, self.old = {}, self.cache
        return here

    def _pieces(self, text: str) -> list[str]:
        if not text or self.rule == "whole":
            return [text] if text else []
        if self.rule == "byte":
            return _BYTE_LEVEL.findall(text)
        return _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()  # split() also cuts at U+001C to U+001F

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; call with slices of bounded size."""
        parts: list[list] = []
        for t in texts:
            own: list = []
            at = 0
            for m in self.mark.finditer(t) if self.mark else ():
                own += [self._pieces(t[at : m.start()]), self.special[m[0]]]
                at = m.end()
            parts.append([*own, self._pieces(t[at:] if at else t)])
        known = self._fill(p for own in parts for x in own if isinstance(x, list) for p in x).__getitem__
        return [b"".join([b"".join(map(known, x)) if isinstance(x, list) else x.to_bytes(4, "little") for x in own]) for own in parts]


class Decoder:
    """Ids to text: portions of ids in, text out, with at most one unfinished character held."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoding for {kind}")
        #: Bytes of each token, and what stands between tokens: without a decoder, tokens' names with blanks between.
        self.between = b"" if kind else b" "
        back = {c: b for b, c in _byte_letters().items()}
        raw = lambda t: bytes(back[c] for c in t) if kind and all(c in back for c in t) else t.encode()
        self.bytes = {k: raw(t) for t, k in vocab.items()}
        self.start()

    def start(self) -> None:
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that these ids complete; ids without a token are left out."""
        own = [b for b in map(self.bytes.get, ids) if b is not None]
        if not own:
            return ""
        data = self.between.join(own)
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.state.decode(data)

    def finish(self) -> str:
        """What an unfinished character at the end stands for."""
        text = self.state.decode(b"", final=True)
        self.start()
        return text

    def decode(self, ids: np.ndarray) -> str:
        parts = [self.feed(ids[a : a + PORTION].tolist()) for a in range(0, len(ids), PORTION)]
        return "".join([*parts, self.finish()])


_MADE: dict[tuple, object] = {}


def _once(kind, name: str):
    """One encoder or decoder for a worker process."""
    path = SparkFiles.get(name)
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


def encode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs: the ids of its whole text.

    A null or empty text has an empty array. Repeated rows stay. An empty table
    gives no rows. Other columns of docs are ignored.
    """
    name = shipped_file(docs.sparkSession, tokenizer_file)

    def run(batches):
        coder = _once(Encoder, name)
        for batch in batches:
            for a, b, texts in text_slices(batch):
                coded = coder.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), ids], names=["doc_id", "ids"])

    return shipped(docs).select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids): the text of each row's ids, special tokens included; null ids count as none."""
    name = shipped_file(tokens.sparkSession, tokenizer_file)

    def run(batches):
        coder = _once(Decoder, name)
        for batch in batches:
            column, first = batch["ids"], 0
            # Runs of rows of a bounded number of ids.
            sizes = np.array([len(x) if x.is_valid else 0 for x in column], dtype=np.int64)
            total = np.cumsum(sizes)
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + 500_000, side="right")))
                own = column.slice(first, end - first)
                flat, at, texts = own.flatten().to_numpy(zero_copy_only=False), 0, []
                for n in sizes[first:end].tolist():
                    texts.append(coder.decode(flat[at : at + n]))
                    at += n
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, end - first), own, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                first = end

    return shipped(tokens).select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op11_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizer("word_bpe_49k.json")
    rows = decode(encode(read_table(spark, sf_dir, "documents"), file), file)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
