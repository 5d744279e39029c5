"""Operator 3: mixing sources to target weights.

Documents get hash-random keys and are range-sorted by source and key, running
totals of their sizes are summed over the ranges, and each source is cut at its
exact budget, after whole epochs where the budget exceeds the source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WORD, read_table, shipped, stage, text_of

#: Weights of the sources in their order, repeating, and the most epochs of a source.
WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Rows of sources' sums and targets that may be broadcast (a few numbers and a name each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, name: str) -> DataFrame:
    """df staged, and broadcast where it has few rows."""
    df = stage(df, name)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def running_total(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of its group before it in the order given.

    Rows are dealt by ranges of group and order, so a large group spans many
    tasks; each task sums its own range, and the sums of the ranges (a row for
    each range and group) are added up. Rows with equal group and order are
    dealt out too, by a number of their own. group must not be null.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_within", T.LongType())])

    def run(batches):
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.array(batch[group].to_pylist(), dtype=object)
            size = np.array(batch[value].to_pylist(), dtype=np.int64)
            before = np.cumsum(size) - size
            new = np.concatenate([[groups[0] != last], groups[1:] != groups[:-1]])
            # Each group starts again at 0, the first of a batch where the last batch left it.
            start = np.where(new, before, 0)
            begun = np.maximum.accumulate(np.where(new, np.arange(len(size)), -1))
            within = before - np.where(begun >= 0, start[begun], -carry)
            last, carry = groups[-1], int(within[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array([part] * len(size), pa.int32()), pa.array(within)], names=[*names, "_part", "_within"])

    dealt = shipped(df).withColumn("_equal", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_equal")
    local = stage(dealt.sortWithinPartitions(group, *order).mapInArrow(run, schema), "ranges")
    sums = local.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = _small(sums.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_base")), "range-sums")
    return local.join(sums, [group, "_part"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_part", "_within", "_base")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(_source, source_size, target) from rows (_source, size): sources in order weigh `weights`, repeating.

    Targets share the sum of all sizes; none exceeds epochs times its source, and
    the excess goes to the others by weight until none is above. Only two sums
    a round come to the driver.
    """
    of = stage(sizes.groupBy("_source").agg(F.sum("size").alias("source_size")), "sources").withColumns({"_all": F.lit("all"), "_one": F.lit(1).cast("long")})
    ranked = running_total(of, "_all", [F.col("_source")], "_one", "_rank").drop("_all", "_one")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = stage(ranked.withColumn("_weight", weight.cast("long")), "weights")
    level, most = None, F.col("source_size") * epochs
    while True:
        full = F.lit(False) if level is None else most < F.lit(level) * F.col("_weight")
        total, held, w = ranked.agg(F.sum("source_size"), F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))).first()
        now = float((total or 0) - (held or 0)) / float(w) if w else 0.0
        if level is not None and now <= level:
            break
        level = now
    target = F.when(most < F.lit(level) * F.col("_weight"), most.cast("double")).otherwise(F.col("_weight") * F.lit(level))
    return ranked.select("_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *keep: str, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(*keep, size, source_size, target, taken, copies) for each row of docs.

    size is the number of words (null text: 0), target the budget of the row's
    source, taken the words the mix takes with repeats; the document at the cut
    gives just the words that are left. copies is how often the whole document
    is taken. Sources are ordered by code point, the null source is the last one.
    Ties of the hash key (repeated doc_ids) are ordered by doc_id, size and a hash
    of the text; rows equal in all of these are taken in any order. An empty table gives no rows; where all sizes are 0, all targets are.
    """
    found = _mixed(docs, keep, weights, epochs, seed)
    return found.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), "size", "source_size", "target", "taken", "copies")


def _mixed(docs: DataFrame, keep: tuple[str, ...], weights: tuple[int, ...], epochs: int, seed: str) -> DataFrame:
    """mix() with the columns to keep named _keep_0 and so on."""
    source = docs["source"].cast("string")
    rows = docs.select(
        *(docs[f"`{c}`"].alias(f"_keep_{i}") for i, c in enumerate(keep)),
        F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source)).alias("_source"),
        F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")))).alias("_key"),
        docs["doc_id"].cast("long").alias("_id"),
        F.xxhash64(text_of(docs)).alias("_text_hash"),
    )
    rows = running_total(rows, "_source", [F.col("_key"), F.col("_id"), F.col("size"), F.col("_text_hash")], "size", "_before")
    targets = source_targets(rows.select("_source", "size"), weights, epochs)
    return _cut(rows, targets)


def _cut(rows: DataFrame, targets: DataFrame) -> DataFrame:
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    own = rows.join(_small(targets, "targets"), "_source").withColumns({"_budget": budget, "_epochs": whole})
    rest = F.col("_budget") - F.col("_epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return own.withColumns({"_words": part, "taken": F.col("size") * F.col("_epochs") + part, "copies": (F.col("_epochs") + (F.col("_before") + F.col("size") <= rest).cast("long")).cast("int")})


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows of docs, each as often as the mix takes it; together they have just the words that mix() tells as taken.

    The document at a source's cut comes once more with the words that are left:
    its text ends after them, and n_chars, where it is a column of whole numbers,
    is the length of that. Other columns and rows are as they are.
    """
    names = tuple(docs.columns)
    found = _mixed(docs, names, weights, epochs, seed)
    cut = (F.col("_words") > 0) & (F.col("_words") < F.col("size"))
    found = found.withColumn("_times", F.col("copies") + cut.cast("int")).where("_times > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _times)")))
    last = cut & (F.col("_copy") > F.col("copies"))
    text = F.col(f"_keep_{names.index('text')}")
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each part but the last ends with a word
    found = found.withColumn("_begin", F.when(last, F.array_join(F.slice(ends, F.lit(1), F.col("_words").cast("int")), "")))
    value = {"text": F.when(last, F.col("_begin")).otherwise(text)}
    if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)):
        own = F.col(f"_keep_{names.index('n_chars')}")
        value["n_chars"] = F.when(last & own.isNotNull(), F.length("_begin").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return found.select(*(value.get(c, F.col(f"_keep_{i}")).alias(c) for i, c in enumerate(names)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || doc_id) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS held, coalesce(sum(weight) OVER w, 0)::BIGINT AS gone
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (total - held)::DOUBLE / (weights - gone)::DOUBLE AS level, held,
         3 * source_size < (total - held)::DOUBLE / (weights - gone)::DOUBLE * weight AS below
  FROM r
), level AS (
  SELECT level FROM l WHERE NOT below ORDER BY held LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size < level * weight THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM s, level
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id))::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END)
        + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - before)))::BIGINT AS taken
FROM p
"""
