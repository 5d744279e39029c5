"""Operator 4: exact dedup by skew-safe combining.

Rows are combined in each task first (Spark's partial aggregation), digests
that hold over a thousandth of all rows are salted, salted groups are merged,
and the winners of the salts are merged once more. Content, not only its
digest, is a grouping key in each of these steps. Afterwards each row finds its
group by the digest alone where the steps have shown that all rows of the
digest have one content, and by digest and content where they have not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_once, read_table, stage, text_of

#: A digest with more than 1/HOT of all rows is hot, so at most HOT digests are broadcast.
HOT, SALTS = 1000, 64


def normalised(docs: DataFrame) -> Column:
    """The text without white space (space, U+0009 to U+000D)."""
    return F.regexp_replace(text_of(docs), r"[ \t-\r]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.length(text_of(docs)).cast("long").alias("n_chars"), norm.alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def _best() -> Column:
    """The row that stays: most characters, then smallest doc_id, null last."""
    return F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, digest, keep_id, group_size, kept.

    Texts are equal when they are without white space; null is empty. Of rows
    that also share doc_id and length, one stays. A group's rows may hold any
    share of the table. An empty table gives no rows.
    """
    slim = stage(_rows(docs, digest).groupBy("digest", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("times")), "digests")
    total = slim.agg(F.sum("times")).first()[0] or 0
    sizes = slim.groupBy("digest").agg(F.sum("times").alias("n"))
    hot = stage(sizes.where(F.col("n") * HOT > total).select("digest"), "hot")  # fewer than HOT rows

    rows = _rows(docs, digest)
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").groupBy("digest", "content").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
    salted = rows.join(F.broadcast(hot), "digest", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(SALTS)))
    merged = salted.groupBy("digest", "content", "salt").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
    merged = merged.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    groups = cold.unionByName(merged)
    found = stage(groups.select("digest", F.sha2("content", 512).alias("check"), "best", "n"), "groups")

    one = found.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("best").alias("best"), F.min("n").alias("n"))
    sure = one.where("contents = 1")
    members = _placed(slim.join(F.broadcast(hot), "digest", "left_anti").join(sure, "digest"))
    members = members.unionByName(_placed(slim.join(F.broadcast(sure.join(F.broadcast(hot), "digest", "left_semi")), "digest")))
    mixed = stage(one.where("contents > 1").select("digest"), "collisions")
    if not mixed.isEmpty():  # different texts share a digest: find the rows' groups by content
        own = rows.join(mixed, "digest", "left_semi").groupBy("digest", "content", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("times"))
        of = own.groupBy("digest", "content").agg(_best().alias("best"), F.sum("times").alias("n"))
        members = members.unionByName(_placed(own.join(of, ["digest", "content"])))
    # Equal rows (doc_id, length, digest) were counted as one; the first of them may stay.
    return members.withColumn("nth", F.explode(F.expr("sequence(1L, times)"))).withColumn("kept", F.col("kept") & (F.col("nth") == 1)).drop("nth", "times")


def _placed(rows: DataFrame) -> DataFrame:
    stays = rows["doc_id"].eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.less"))
    return rows.select("doc_id", "n_chars", "digest", "times", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that agree in doc_id, length and digest, one."""
    kept = stage(find_copies(docs).where("kept").select("doc_id", "n_chars", "digest"), "kept")
    keys = {"doc_id": docs["doc_id"].cast("long"), "n_chars": F.length(text_of(docs)).cast("long"), "digest": sha256(normalised(docs))}
    again = docs.select(*(c.alias(k) for k, c in keys.items())).groupBy(*keys).count().where("count > 1").drop("count")  # usually none
    return keep_once(docs, keys, kept, stage(again, "again"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_copies(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) = 1 AS kept,
       text_sha256
FROM t
"""
