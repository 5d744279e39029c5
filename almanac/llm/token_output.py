"""Operator 1: token ids as binary blocks in a static range asymmetric numeral system.

A token file is a folder of three Parquet tables, which Spark's writers commit
whole or not at all: `table` (shared frequencies), `blocks` (see rans.py; each
holds whole consecutive documents and decodes by itself) and `index` (tokens
and documents before each part). Documents stand in ascending doc_id order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import new_path, public_tokenizer, read_table, shipped, stage, text_of, text_slices
from .tokens import encoder

BLOCK_TOKENS, BLOCKS_AT_ONCE = 65_536, 32


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(doc_id, tie, n_tokens, ids, counts): ids of each whole text and end_id, as compressed 16- or 32-bit integers.

    tie orders rows that share a doc_id. A null text is empty: its only id is
    end_id. Each task adds a row with n_tokens -1 that holds only counts, its
    number of each id.
    """
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1)
    wide = vocab > 65_536
    dtype = "<u4" if wide else "<u2"
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        import zstandard

        total = np.zeros(vocab, dtype="<i8")
        enc, end, press = encoder(tokenizer_file, dtype), np.array([end_id], dtype=dtype).tobytes(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b, texts in text_slices(batch):
                ids = [x + end for x in enc.encode(texts)]
                total += np.bincount(np.frombuffer(b"".join(ids), dtype=dtype), minlength=vocab)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["tie"].slice(a, b - a), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int32()), pa.array([press.compress(x) for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())],
                    schema=schema,
                )
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, -1, None, press.compress(total.tobytes())), schema.types)], schema=schema)

    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return shipped(rows).mapInArrow(run, "doc_id long, tie long, n_tokens int, ids binary, counts binary")


def _ids_of(batch, wide: bool) -> list[np.ndarray]:
    import zstandard

    un, dtype = zstandard.ZstdDecompressor(), "<u4" if wide else "<u2"
    return [np.frombuffer(un.decompress(x.as_py()), dtype=dtype) for x in batch["ids"]]


def write_token_file(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Write docs (doc_id, text; other columns are ignored) as a token file at path.

    Nulls: a null text is empty, null doc_ids come first. Repeated doc_ids stay
    as they are, ordered by a hash of the text. An empty table makes a file
    without blocks.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocab = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1)
    wide = vocab > 65_536
    tokens = stage(tokenize(docs, tokenizer_file, end_id), "tokens")

    def count(batches):
        import zstandard

        total = np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            for x in batch["counts"]:
                total += np.frombuffer(zstandard.decompress(x.as_py()), dtype="<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    # At most one row for each id of the vocabulary comes to the driver.
    counts = np.zeros(vocab, dtype=np.int64)
    for row in shipped(tokens).where("n_tokens < 0").select("counts").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    table = rans.Table.fit(counts)
    freq = table.freq.astype(np.int64)

    def blocks(batches):
        code, part = rans.Table(freq), TaskContext.get().partitionId()
        names = ["part", "block", "first", "n_docs", "n_tokens", "payload"]
        held, done, docs_of, ids_of, size, first, number = [], 0, [], [], 0, 0, 0

        def flush():
            nonlocal held, number
            coded = rans.encode([np.concatenate(x[1]) for x in held], code)
            rows = [(part, number + k, x[2], len(x[0]), sum(map(len, x[1])), rans.pack_block(x[0], x[1], c, code)) for k, (x, c) in enumerate(zip(held, coded))]
            number += len(held)
            held = []
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), _ids_of(batch, wide)):
                docs_of.append(doc)
                ids_of.append(ids)
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    alone = size > 2 * BLOCK_TOKENS  # blocks coded together take the room of the longest each
                    if alone and held:
                        yield flush()
                    held.append((docs_of, ids_of, first))
                    first, docs_of, ids_of, done, size = first + size, [], [], done + size, 0
                    if alone or len(held) == BLOCKS_AT_ONCE or done >= BLOCKS_AT_ONCE * BLOCK_TOKENS:
                        done = 0
                        yield flush()
        if docs_of:
            held.append((docs_of, ids_of, first))
        if held:
            yield flush()

    ordered = tokens.where("n_tokens >= 0").select("doc_id", "tie", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    shipped(ordered).mapInArrow(blocks, "part int, block int, first long, n_docs long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(t), int(freq[t])) for t in np.flatnonzero(freq)], "token int, freq long").coalesce(1).write.parquet(f"{path}/table")
    # One row for each part, of which there are as many as shuffle partitions.
    before_tokens, before_docs, index = 0, 0, []
    for row in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("t"), F.sum("n_docs").alias("d")).orderBy("part").collect():
        index.append((row["part"], before_tokens, before_docs))
        before_tokens, before_docs = before_tokens + row["t"], before_docs + row["d"]
    spark.createDataFrame(index, "part int, tokens_before long, docs_before long").coalesce(1).write.parquet(f"{path}/index")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids as little-endian unsigned 32-bit integers.

    Blocks decode apart from one another, and within a block the stretches
    between checkpoints decode together; a wrong checksum fails the task.
    """
    rows = spark.read.parquet(f"{path}/table").collect()  # bounded by the vocabulary
    freq = np.zeros(max(r["token"] for r in rows) + 1, dtype=np.int64)
    for r in rows:
        freq[r["token"]] = r["freq"]
    base = {r["part"]: r["tokens_before"] for r in spark.read.parquet(f"{path}/index").collect()}  # bounded by the partitions
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        code = rans.Table(freq)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                own = batch.slice(a, BLOCKS_AT_ONCE)
                for part, first, (docs, ids) in zip(own["part"].to_pylist(), own["first"].to_pylist(), rans.unpack_blocks(own["payload"].to_pylist(), code)):
                    sizes = np.array([len(x) for x in ids], dtype=np.int64)
                    starts = base[part] + first + np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], schema=schema)

    return shipped(spark.read.parquet(f"{path}/blocks")).select("part", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-file")
    write_token_file(read_table(spark, sf_dir, "documents"), path, public_tokenizer("word_bpe_49k.json"), end_id=2)
    back = read_token_file(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
