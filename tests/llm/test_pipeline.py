"""The pipeline's stages on a small table, each against what it should keep."""

import re

from helpers import documents
from test_bagminhash import brute, near_copies

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rows = [(d, t) for d, t in near_copies()]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    steps, at = dict(pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert list(steps) == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing"]

    good = steps["quality_classifier"](spark, at, str(tmp_path)).cache()
    assert good.columns == at.columns and {r["doc_id"] for r in at.collect()} - {r["doc_id"] for r in good.collect()} >= {d for d, t in rows if not t}
    one = steps["exact_dedup"](spark, good, str(tmp_path)).cache()
    plain = [re.sub(r"[ \t-\r]", "", r["text"]) for r in one.collect()]
    assert one.columns == at.columns and len(plain) == len(set(plain)) == len({re.sub(r"[ \t-\r]", "", r["text"]) for r in good.collect()})
    near = steps["near_dedup"](spark, one, str(tmp_path)).cache()
    own = [(r["doc_id"], r["text"]) for r in one.orderBy("doc_id").collect()]
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(brute(own).values()))
    mixed = steps["mixing"](spark, near, str(tmp_path)).cache()
    assert mixed.columns == at.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    packed = steps["packing"](spark, mixed, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted({r["doc_id"] for r in mixed.collect()})
    assert pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_odd_and_empty(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for at in (docs, docs.limit(0)):
        for name, step in pipeline.STAGES:
            own = step(spark, at, str(tmp_path))
            assert (own.count() > 0) == (at.count() > 0), name
            if name != "packing":
                assert own.columns == docs.columns


def _left(step, docs, path):
    return sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in step(docs.sparkSession, docs, path).select("doc_id", "text").collect()), key=str)


def test_verdicts_go_by_row(spark, tmp_path):
    """A repeated doc_id costs no row its place: what is rejected, or a copy, is the row itself."""
    from helpers import LONG, PROSE

    steps, junk = dict(pipeline.STAGES), "ZQ#%" * (len(PROSE) // 4) + "Z" * (len(PROSE) % 4)
    rows = [(k, PROSE[k:] + PROSE[:k]) for k in range(0, 200, 5)]
    spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, [*rows, (501, PROSE), (501, junk), (None, PROSE), (None, junk)]).withColumn("lang", pipeline.quality_lm.F.lit("en"))
    got = _left(steps["quality_classifier"], docs, str(tmp_path))
    assert len(got) >= len(rows) - 2 and (False, 501, PROSE) in got and (True, None, PROSE) in got and not any(r[2] == junk for r in got)

    a, b = PROSE, LONG[:3000]
    assert _left(steps["near_dedup"], documents(spark, [(5, a), (10, a), (10, b)]), "") == sorted([(False, 5, a), (False, 10, b)], key=str)
    assert len(_left(steps["near_dedup"], documents(spark, [(7, a)] * 3), "")) == 1
    assert _left(steps["near_dedup"], documents(spark, [(None, a)] * 3 + [(9, a + " more")]), "") == [(False, 9, a + " more")]
    assert len(_left(steps["near_dedup"], documents(spark, [(None, a)] * 3 + [(None, None), (None, ""), (3, "")]), "")) == 4
    assert _left(steps["exact_dedup"], documents(spark, [(5, a), (10, a + " "), (10, b), (10, b)]), "") == sorted([(False, 10, a + " "), (False, 10, b)], key=str)
