"""Operator 2: vector best-fit packing of token pieces into sequences.

A bin has residual capacities for tokens, documents and attention cost (the sum
of squared lengths). An item goes to the open bin that can take it under every
constraint and scores best: the least weighted norm of what would be left
('norm'), or the largest weighted dot product of item and residual ('dot').
Items are dealt to shards at random and each shard packs its own, longest
first, so a shard wastes at most about one bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import public_tokenizer, read_table, shipped, stage, text_of, text_slices
from .tokens import encoder

#: Items of a shard at most, on average; a shard is packed in one task.
SHARD_ITEMS = 5_000


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, size: int, *keep: str) -> DataFrame:
    """(doc_id, *keep, piece, start, length, ids): documents of more than `size` ids are cut into pieces of
    `size`, the first of which may be shorter; ids are little-endian unsigned 32-bit integers.

    A null text is empty and gives one piece with end_id only. Repeated rows
    give repeated pieces. An empty table gives none.
    """
    names = ["doc_id", *keep]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {"doc_id": "long"}

    def run(batches):
        enc, end = encoder(tokenizer_file), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for a, b, texts in text_slices(batch):
                row, piece, start, length, ids = [], [], [], [], []
                for k, x in enumerate(enc.encode(texts)):
                    x += end
                    n = len(x) // 4
                    first = (n - 1) % size + 1
                    for p, at in enumerate([0, *range(first, n, size)]):
                        to = first if p == 0 else at + size
                        row.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(to - at)
                        ids.append(x[4 * at : 4 * to])
                own = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a).take(own) for c in names), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=[*names, "piece", "start", "length", "ids"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *keep, text_of(docs).alias("text"))
    return shipped(rows).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", piece int, start long, length long, ids binary")


def best_fit(need: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> np.ndarray:
    """Bin of each row of need (items by dimensions), in the order given. Items must fit an empty bin."""
    n, dims = need.shape
    share = need / capacity
    left = np.empty((max(n, 1), dims))  # residual shares of the open bins
    name = np.empty(max(n, 1), dtype=np.int64)
    least = share.min(axis=0) if n else np.zeros(dims)
    opened, bins = 0, 0
    out = np.empty(n, dtype=np.int64)
    eps = 1e-12
    for i in range(n):
        item, open_ = share[i], left[:opened]
        fits = np.flatnonzero((open_ >= item - eps).all(axis=1))
        if len(fits):
            rest = open_[fits]
            value = ((rest - item) ** 2 @ weights) if score == "norm" else -(rest * item) @ weights
            at = int(fits[np.argmin(value)])
        else:
            at = opened
            left[at], name[at] = 1.0, bins
            opened, bins = opened + 1, bins + 1
        out[i] = name[at]
        left[at] -= item
        if (left[at] < least - eps).any():  # nothing that is left can go in
            opened -= 1
            left[at], name[at] = left[opened], name[opened]
    return out


def pack(items: DataFrame, capacity: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm", shards: int | None = None) -> DataFrame:
    """items (doc_id, piece, length and any columns) with sequence_id and offset.

    Every sequence holds at most `capacity` tokens, `max_docs` items and
    `max_attention` as the sum of squared lengths. Items as long as the capacity
    fill a sequence each and are not shuffled. Offsets are gapless from 0.
    Repeated items are packed as often as they occur. Lengths must be from 1 to
    the capacity, and one item must fit by itself. Columns of items that are
    named as the two added ones (or _shard) are replaced.
    """
    items = items.drop("sequence_id", "offset", "_shard")
    limit, w = np.array([capacity, max_docs, max_attention], dtype=float), np.asarray(weights, dtype=float)
    spark, names = items.sparkSession, items.columns
    items = stage(items, "pieces")  # read twice below, made once
    full = items.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = items.where(F.col("length") < capacity)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))  # by the staged row, so equal rows are spread as well

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        length = frame["length"].to_numpy(dtype=float)
        bins = best_fit(np.stack([length, np.ones(len(frame)), length**2], axis=1), limit, w, score)
        frame["sequence_id"] = frame["_shard"].to_numpy() * 2**32 + bins
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"
    return full.unionByName(shipped(part).withColumn("_shard", mixed.cast("long")).groupBy("_shard").applyInPandas(run, schema))


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, size: int) -> DataFrame:
    """Whole documents as packed pieces with their ids; the token capacity alone binds."""
    pieces = token_pieces(docs, tokenizer_file, end_id, size)
    return pack(pieces, size, max_docs=size, max_attention=size * size, shards=shards_for(docs))


def shards_for(docs: DataFrame) -> int:
    """As many shards as keep one at SHARD_ITEMS items; a document has at most one piece below the capacity."""
    return max(1, -(-docs.count() // SHARD_ITEMS))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(read_table(spark, sf_dir, "documents"))


def packed_digest(docs: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces of docs by byte-level BPE with end id 2, their checksums, sequences and offsets."""
    pieces = token_pieces(docs, public_tokenizer("byte_bpe_50k.json"), 2, size)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim, size, max_docs=size, max_attention=size * size, shards=shards_for(docs))
