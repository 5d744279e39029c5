"""Token files: exact round trips, blocks that decode apart, damage, odd rows."""

import zlib

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from almanac.llm import rans, token_output
from almanac.llm.common import new_path, public_tokenizer


def test_codec():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, n).clip(1, 40_000).astype(np.uint32) for n in (1, 63, 64, 65, 5000, 70_000)]
    table = rans.Table.fit(np.bincount(np.concatenate(blocks)))
    assert int(table.freq.sum()) == 1 << rans.BITS
    payloads = [rans.pack_block([None, 7], [b[:1], b[1:]], c, table) for b, c in zip(blocks, rans.encode(blocks, table))]
    for order in (range(6), [4], [5, 0]):
        for k, (docs, ids) in zip(order, rans.unpack_blocks([payloads[k] for k in order], table)):
            assert docs == [None, 7] and np.array_equal(np.concatenate(ids), blocks[k])
    big, entropy = payloads[-1], np.bincount(blocks[-1]) / len(blocks[-1])
    entropy = -(entropy[entropy > 0] * np.log2(entropy[entropy > 0])).sum() * len(blocks[-1]) / 8
    assert len(big) < 1.1 * entropy + 3000
    with pytest.raises(ValueError):
        rans.unpack_blocks([big[:-5] + bytes([big[-5] ^ 1]) + big[-4:]], table)


@pytest.mark.parametrize("counts", [[5], [0, 1, 0, 10**12], np.ones(2**18), []])
def test_table(counts):
    table = rans.Table.fit(np.array(counts))
    assert int(table.freq.sum()) == 1 << rans.BITS and (table.freq[: len(counts)] > 0).tolist() == [c > 0 for c in counts]


def test_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    file = public_tokenizer("word_bpe_49k.json")
    docs = documents(spark).repartition(3)
    path = new_path(spark, "t")
    token_output.write_token_file(docs, path, file, 2)
    got = token_output.read_token_file(spark, path).withColumn("crc", F.crc32("ids")).collect()
    tok = Tokenizer.from_file(file)
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
    rows = [(r["doc_id"], ids(r["text"])) for r in docs.collect()]
    assert sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in got) == sorted((d or -1, x) for d, x in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["crc"] == zlib.crc32(bytes(r["ids"])) and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    empty = new_path(spark, "t")
    token_output.write_token_file(docs.limit(0), empty, file, 2)
    assert token_output.read_token_file(spark, empty).count() == 0
