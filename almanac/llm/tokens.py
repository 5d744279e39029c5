"""Exact token ids of whole texts, with a bounded cache of word pieces.

A text is cut only where the tokenizer itself always cuts, each distinct piece
is encoded once by the tokenizers library, and a text's ids are its pieces'
ids in order. tests/llm/test_tokens.py holds the result against encoding
whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: ASCII punctuation without the apostrophe, which begins contractions.
_TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = "\u024f"
#: Characters of a piece that is cached at most, which bounds the cache's bytes.
LONGEST = 64
_WORDS, _SEPARATORS = re.compile(f"[^{_SPACE}]+"), re.compile("[\x1c-\x1f]")
#: Runs of characters other than white space with one space before them, or white space, as byte-level BPE cuts them.
_BYTE_LEVEL = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _rule(path: str) -> tuple[str, bool]:
    """How texts may be cut for this file: 'byte', 'word' or 'whole', and whether it lowers letters."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    parts = [pre, *pre.get("pretokenizers", [])]
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte", False
    norms = (norm or {}).get("normalizers", [])
    kinds = [x["type"] for x in norms]
    spaces = all(x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in norms if x["type"] == "Replace")  # no replacement reaches across a cut
    split = next((p for p in parts if p.get("type") == "Split"), None)
    drops = split and split.get("behavior") == "Removed" and split.get("invert") and "\\s" in json.dumps(split)
    if drops and spaces and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
        return "word", "Lowercase" in kinds
    return "whole", False


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """Pieces to their ids; a piece that is missing is looked up among the older ones or encoded."""

    def __init__(self, encode_piece, old: dict):
        super().__init__()
        self.encode_piece, self.old = encode_piece, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    """Texts to little-endian ids.

    At most `limit` pieces are cached in each of two generations: when the young
    one is full it becomes the old one, and what is used again moves back.
    """

    def __init__(self, path: str, dtype: str = "<u4", limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.rule, self.lowers = _rule(path)
        self.dtype, self.limit, self.cache = np.dtype(dtype), limit, _Cache(self._piece, {})
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError("ids don't fit the type")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(_TAIL)
        if len(core) != len(piece) and core and core[-1].isalpha() and core[-1] <= _LATIN:
            # A Latin letter ends before ASCII punctuation in either rule.
            return self.cache[core] + self.cache[piece[len(core) :]]
        # Up to U+024F, NFC changes no letter, and lowering one gives one letter, but for U+0130.
        letters = piece[1:] if piece[0] == " " else piece
        if letters.isalpha() and (letters.isascii() or (max(letters) <= _LATIN and "\u0130" not in letters)):
            # One pre-token, straight from the model.
            if self.lowers and (low := piece.lower()) != piece:
                return self.cache[low]
            word = piece if letters is piece and piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            return array(self.code, [t.id for t in self.tokenize(word)]).tobytes()
        return self._whole(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; call with slices of bounded size."""
        if self.rule == "whole":
            return [self._whole(x) for x in texts]
        if self.rule == "byte":
            split = _BYTE_LEVEL.findall
        else:  # split() also cuts at U+001C to U+001F, which are no white space here
            split = lambda x: _WORDS.findall(x) if _SEPARATORS.search(x) else x.split()
        if len(self.cache) > self.limit:
            self.cache = _Cache(self._piece, dict(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, split(x))) for x in texts]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder for a worker process; tasks that follow use its cache again."""
    key = (path, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, dtype)
    return _ENCODERS[key]
