"""Static range asymmetric numeral system over blocks of token ids.

One frequency table serves all blocks. A block is encoded by `LANES`
interleaved 64-bit states that put 32-bit words in one stream, and holds the
states and the stream's place every `EVERY` steps, so that each part between
two checkpoints can be decoded by itself. numpy works on all lanes of many
blocks, or of many checkpoints, at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS, LANES, EVERY, LOW = 18, 64, 256, np.uint64(1 << 31)
MAGIC = b"ALRB"
#: magic, version, lanes, bits, documents, tokens, steps between checkpoints, checkpoints, words, crc32 of the body, crc32 of the ids
HEAD = struct.Struct("<4sHHIQQIIQII")


class Table:
    """Frequencies scaled to a sum of 2**bits; each id that occurs keeps at least 1."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        if int(self.freq.sum()) != 1 << bits:
            raise ValueError("frequencies don't sum to the table's size")
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.pad = int(np.argmax(freq))

    @classmethod
    def fit(cls, counts: np.ndarray, bits: int = BITS) -> Table:
        counts = np.asarray(counts, dtype=np.float64)
        seen = counts > 0
        if not seen.any():
            counts, seen = np.ones(1), np.ones(1, dtype=bool)
        if seen.sum() > 1 << bits:
            raise ValueError("more ids than slots")
        freq = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))), 0).astype(np.int64)
        over = int(freq.sum()) - (1 << bits)
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        while over > 0:  # take from the largest, where it costs least
            for k in order:
                take = min(over, int(freq[k] - 1) // 2 or int(freq[k] > 1))
                freq[k] -= take
                over -= take
                if not over:
                    break
        return cls(freq, bits)


def encode(blocks: list[np.ndarray], table: Table, lanes: int = LANES, every: int = EVERY) -> list[tuple]:
    """Per block: states at the checkpoints, places of the checkpoints in the words, words."""
    n = len(blocks)
    steps = np.array([-(-len(b) // lanes) for b in blocks], dtype=np.int64)
    order = np.argsort(-steps, kind="stable")
    top = int(steps.max(initial=0))
    ids = np.full((top, n, lanes), table.pad, dtype=np.uint32)
    for k, b in enumerate(order):
        flat = np.full(steps[b] * lanes, table.pad, dtype=np.uint32)
        flat[: len(blocks[b])] = blocks[b]
        ids[: steps[b], k] = flat.reshape(-1, lanes)
    active = np.searchsorted(-steps[order], -np.arange(top), side="left")  # blocks with more than s steps
    x = np.full((n, lanes), LOW, dtype=np.uint64)
    words = np.zeros((top, n, lanes), dtype=np.uint32)
    put = np.zeros((top, n, lanes), dtype=bool)
    states = np.zeros((-(-top // every), n, lanes), dtype=np.uint64)
    shift, bits, half = np.uint64(63 - table.bits), np.uint64(table.bits), np.uint64(32)
    for s in range(top - 1, -1, -1):
        k = active[s]
        f, c, xs = table.freq[ids[s, :k]], table.cum[ids[s, :k]], x[:k]
        big = xs >= (f << shift)
        words[s, :k] = xs.astype(np.uint32)
        put[s, :k] = big
        xs = np.where(big, xs >> half, xs)
        q = xs // f
        x[:k] = (q << bits) + (xs - q * f) + c
        if s % every == 0:
            states[s // every, :k] = x[:k]
    out: list[tuple] = [()] * n
    for k, b in enumerate(order):
        own = put[: steps[b], k]
        before = np.concatenate([[0], np.cumsum(own.sum(axis=1))])[: steps[b]][::every].astype(np.uint64)
        out[b] = (states[: len(before), k], before, words[: steps[b], k][own])
    return out


def decode(parts: list[tuple[np.ndarray, np.ndarray, int]], table: Table, lanes: int = LANES) -> list[np.ndarray]:
    """Per part (states, words from its checkpoint on, steps): ids of all its steps, in order."""
    if not parts:
        return []
    steps = np.array([p[2] for p in parts], dtype=np.int64)
    order = np.argsort(-steps, kind="stable")
    top = int(steps.max())
    pool = np.concatenate([*(parts[p][1] for p in order), np.zeros(1, np.uint32)])
    sizes = np.array([len(parts[p][1]) for p in order], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.stack([parts[p][0] for p in order]).astype(np.uint64)
    out = np.empty((top, len(parts), lanes), dtype=np.uint32)
    active = np.searchsorted(-steps[order], -np.arange(top), side="left")
    bits, low, half = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
    for s in range(top):
        k = active[s]
        xs = x[:k]
        slot = xs & low
        ids = table.slots[slot]
        out[s, :k] = ids
        xs = table.freq[ids] * (xs >> bits) + slot - table.cum[ids]
        need = np.flatnonzero(xs < LOW)  # in order of the parts, and of the lanes in each
        some = np.bincount(need // lanes, minlength=k)
        word = pool[np.repeat(at[:k] - np.cumsum(some) + some, some) + np.arange(len(need))]
        flat = xs.reshape(-1)
        flat[need] = (flat[need] << half) | word
        x[:k] = xs
        at[:k] += some
    back: list[np.ndarray] = [np.empty(0, np.uint32)] * len(parts)
    for k, p in enumerate(order):
        back[p] = out[: steps[p], k].reshape(-1)
    return back


def pack_block(doc_ids: list, ids: list[np.ndarray], coded: tuple, table: Table) -> bytes:
    """The bytes of a block: head, document ids and lengths, checkpoints, words."""
    states, before, words = coded
    raw = np.concatenate(ids).astype("<u4").tobytes() if ids else b""
    body = b"".join([
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        np.array([len(x) for x in ids], dtype="<u4").tobytes(),
        states.astype("<u8").tobytes(), before.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ])
    head = HEAD.pack(MAGIC, 1, LANES, table.bits, len(doc_ids), len(raw) // 4, EVERY, len(before), len(words), zlib.crc32(body), zlib.crc32(raw))
    return head + body


def unpack_blocks(payloads: list[bytes], table: Table) -> list[tuple[list, list[np.ndarray]]]:
    """Per block: document ids and their arrays of token ids. Raises on a wrong checksum."""
    heads, parts, owner = [], [], []
    for k, payload in enumerate(payloads):
        magic, version, lanes, bits, docs, tokens, every, marks, n_words, crc, ids_crc = HEAD.unpack_from(payload)
        body = memoryview(payload)[HEAD.size :]
        if magic != MAGIC or version != 1 or lanes != LANES or bits != table.bits or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        at = 0

        def take(dtype: str, n: int):
            nonlocal at
            got = np.frombuffer(body, dtype=dtype, count=n, offset=at)
            at += got.nbytes
            return got

        ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        states, before, words = take("<u8", marks * lanes).reshape(marks, lanes), take("<u8", marks), take("<u4", n_words)
        steps = -(-tokens // lanes)
        ends = [*before[1:].tolist(), n_words]
        for c in range(marks):
            parts.append((states[c], words[int(before[c]) : int(ends[c])], min(every, steps - c * every)))
            owner.append(k)
        heads.append(([None if z else int(d) for d, z in zip(ids, null)], lengths, tokens, ids_crc))
    found: list[list[np.ndarray]] = [[] for _ in payloads]
    for k, got in zip(owner, decode(parts, table)):
        found[k].append(got)
    out = []
    for (ids, lengths, tokens, ids_crc), got in zip(heads, found):
        flat = (np.concatenate(got) if got else np.empty(0, np.uint32))[:tokens]
        if zlib.crc32(flat.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("wrong ids after decoding")
        out.append((ids, np.split(flat, np.cumsum(lengths.astype(np.int64))[:-1]) if ids else []))
    return out
