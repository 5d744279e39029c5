"""Operator 6: quality rules and robust multivariate outliers.

Base statistics of each document make a vector of transformed values. For each
language and source, the minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps over all its documents from two starts;
the one of smaller determinant goes on until the determinants settle. Documents
too far from the centre by Mahalanobis distance are rejected. Every step is a
grouped aggregate over the slim table of vectors; only sums are exchanged, so
one group may hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shipped, stage, text_of, text_slices

#: Windows of words that count as repeated when they occur twice in a text.
WINDOW = 8
#: Share of rows a concentration step keeps, rows of a group at least, groups that may be broadcast.
KEEP, LEAST, BROADCAST_GROUPS = 0.75, 100, 20_000
#: Steps of every start, steps of the better one at most, change of all log-determinants at which it stops.
STEPS, MOST_STEPS, SETTLED = 4, 20, 1e-3
#: Chi-square quantiles of 5 degrees of freedom: 0.75, for consistency, and 1 - 1e-9, for the verdict.
CHI_KEEP, CHI_CUT = 6.6257, 52.4
#: Least standard deviation of each transformed value.
FLOOR = (0.03, 0.10, 0.10, 0.12, 0.12)
VECTOR = ("v_distinct", "v_chars", "v_symbols", "v_lines", "v_repeats")
_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeated_words(words: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, its words in windows of WINDOW words that occur at least twice in it.

    words are codes of words and docs their documents, ascending. Windows that
    agree in a hash are compared word by word.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(n_docs, dtype=np.int64)
    inside = np.flatnonzero(docs[:n] == docs[WINDOW - 1 :])
    with np.errstate(over="ignore"):
        key = docs[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(WINDOW):
            key = (key ^ words[inside + j].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    if not len(same):
        return np.zeros(n_docs, dtype=np.int64)
    a, b = inside[order[same]], inside[order[same + 1]]
    equal = docs[a] == docs[b]
    for j in range(WINDOW):
        equal &= words[a + j] == words[b + j]
    starts = np.concatenate([a[equal], b[equal]])
    if not equal.all():  # a hash stands for several windows: compare those by content
        run = np.isin(sorted_key, sorted_key[same[~equal]])
        seen: dict[tuple, list[int]] = {}
        for at in inside[order[run]]:
            seen.setdefault((docs[at], *words[at : at + WINDOW]), []).append(at)
        starts = np.concatenate([starts, *(np.array(x) for x in seen.values() if len(x) > 1)]).astype(np.int64)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.unique(starts)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return np.bincount(docs[np.cumsum(marks[:-1]) > 0], minlength=n_docs)


def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, n_distinct, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    codes: dict[bytes, int] = {}
    words, n_words, distinct, chars, symbols, lines = [], [], [], [], [], []
    for text in texts:
        raw = text.encode()
        own = raw.split()  # bytes are split at ASCII white space only
        words.append(np.fromiter((codes.setdefault(w, len(codes)) for w in own), dtype=np.int64, count=len(own)))
        n_words.append(len(own))
        distinct.append(len(set(own)))
        chars.append(len(text) - len(raw) + len(raw.translate(None, _SPACES)))
        symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
        real = [x for x in raw.split(b"\n") if x.translate(None, _SPACES)]
        lines.append(len(real) - len(set(real)))
    n = np.array(n_words, dtype=np.int64)
    docs = np.repeat(np.arange(len(texts)), n)
    flat = np.concatenate(words) if words else np.empty(0, np.int64)
    return {"n_words": n, "n_distinct": np.array(distinct, np.int64), "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeated_words(flat, docs, len(texts))}


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, n_distinct, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the vector).

    A null text has no words, which fails; null languages and sources are groups
    of their own.
    """
    names = ["n_words", "n_distinct", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch):
                got = base_counts(texts)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in ("doc_id", "lang", "source")), *(pa.array(got[c]) for c in names)], names=["doc_id", "lang", "source", *names])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), text_of(docs).alias("text"))
    rows = shipped(rows).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in names))
    n = F.col("n_words")
    # Logarithms of counts against the logarithm of the length, so that a long clean text is no outlier.
    share = lambda c: F.log(F.col(c) + 1) / F.log(n + 20)
    values = (F.log(F.col("n_distinct") + 1) / F.log(F.greatest(n, F.lit(1)) + 1), F.log((F.col("word_chars") + 5) / (n + 1)), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"))
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return rows.withColumns({"base_failed": failed} | dict(zip(VECTOR, values)))


def _moments(keep: Column, start: int) -> list[Column]:
    out = [F.sum(keep.cast("double")).alias(f"m_{start}")]
    for i, a in enumerate(VECTOR):
        out.append(F.sum(F.when(keep, F.col(a))).alias(f"s_{start}_{i}"))
        out += [F.sum(F.when(keep, F.col(a) * F.col(b))).alias(f"q_{start}_{i}_{j}") for j, b in enumerate(VECTOR[: i + 1])]
    return out


def _shape_columns(start: int) -> list[str]:
    """Columns of a start's shape: centre, inverse scatter, logarithm of the scatter's determinant."""
    p = range(len(VECTOR))
    return [*(f"c_{start}_{i}" for i in p), *(f"p_{start}_{i}_{j}" for i in p for j in range(i + 1)), f"det_{start}"]


def _shape(*starts: int):
    """Sums of a group to the shape of each start."""
    p = len(VECTOR)
    names = [n for s in starts for n in _shape_columns(s)]

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                row = [r["_group"]]
                for s in starts:
                    m = max(r[f"m_{s}"] or 0.0, 1.0)
                    c = np.array([r[f"s_{s}_{i}"] or 0.0 for i in range(p)]) / m
                    q = np.zeros((p, p))
                    for i in range(p):
                        for j in range(i + 1):
                            q[i, j] = q[j, i] = (r[f"q_{s}_{i}_{j}"] or 0.0) / m - c[i] * c[j]
                    q = np.nan_to_num(q)
                    q += np.diag(np.maximum(0.0, np.square(FLOOR) - np.diag(q)))
                    inv = np.linalg.inv(q)
                    row += [*c, *(inv[i, j] for i in range(p) for j in range(i + 1)), np.linalg.slogdet(q)[1]]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["_group", *names])

    return run, "_group string, " + ", ".join(f"{n} double" for n in names)


def _distance(start: int) -> Column:
    """Squared Mahalanobis distance by a start's shape."""
    d = [F.col(a) - F.col(f"c_{start}_{i}") for i, a in enumerate(VECTOR)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i + 1):
            total = total + d[i] * d[j] * F.col(f"p_{start}_{i}_{j}") * (1 if i == j else 2)
    return total


def _with(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Join a row of each group to its rows: broadcast up to a number of groups, else salted against hot groups."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "_group")
    salts = 32
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*VECTOR), F.lit(salts)).cast("int")).join(groups, ["_group", "_salt"]).drop("_salt")


def _concentrate(rows: DataFrame, shape: DataFrame, n_groups: int, *starts: int) -> DataFrame:
    """Each start's shape from the share KEEP of a group's rows that is nearest by its last shape; all starts in one pass."""
    far = _with(rows, shape, n_groups).select("_group", *VECTOR, *(_distance(s).alias(f"_d_{s}") for s in starts))
    cut = stage(far.groupBy("_group").agg(*(F.percentile_approx(f"_d_{s}", KEEP, 2000).alias(f"_cut_{s}") for s in starts)), "cuts")
    sums = _with(far, cut, n_groups).groupBy("_group").agg(*(m for s in starts for m in _moments(F.col(f"_d_{s}") <= F.col(f"_cut_{s}"), s)))
    run, schema = _shape(*starts)
    return stage(shipped(sums).mapInPandas(run, schema), "shape")


def estimate(rows: DataFrame) -> tuple[DataFrame, int]:
    """The minimum-covariance-determinant shape (columns of start 0) of each _group of rows (_group, the vector), and the number of groups.

    One start has medians and spreads by quartiles without covariances, the other
    the mean and covariance of all rows. After STEPS steps a group goes on with
    the start of smaller determinant, until no determinant changes any more.
    """
    p = len(VECTOR)
    q = stage(rows.groupBy("_group").agg(*(F.percentile_approx(a, [0.25, 0.5, 0.75], 2000).alias(f"quartiles_{i}") for i, a in enumerate(VECTOR)), *_moments(F.lit(True), 1)), "starts")
    centre = [F.col(f"quartiles_{i}")[1].alias(f"c_0_{i}") for i in range(p)]
    spread = lambda i: F.greatest(F.lit(FLOOR[i]), (F.col(f"quartiles_{i}")[2] - F.col(f"quartiles_{i}")[0]) / 1.349)
    inverse = [(F.pow(spread(i), -2) if i == j else F.lit(0.0)).alias(f"p_0_{i}_{j}") for i in range(p) for j in range(i + 1)]
    run, schema = _shape(1)
    sums = q.drop(*(f"quartiles_{i}" for i in range(p)))
    shape = stage(q.select("_group", *centre, *inverse).join(shipped(sums).mapInPandas(run, schema), "_group"), "shape")
    n_groups = shape.count()
    for _ in range(STEPS):
        shape = _concentrate(rows, shape, n_groups, 0, 1)
    second = F.col("det_1") < F.col("det_0")
    shape = stage(shape.select("_group", *(F.when(second, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(_shape_columns(0), _shape_columns(1)))), "shape")
    for _ in range(MOST_STEPS - STEPS):
        last, shape = shape, _concentrate(rows, shape, n_groups, 0)
        change = shape.join(last.select("_group", F.col("det_0").alias("_last")), "_group").agg(F.max(F.abs(F.col("det_0") - F.col("_last")))).first()[0]
        if (change or 0.0) <= SETTLED:
            break
    return shape, n_groups


def judge(stats: DataFrame) -> DataFrame:
    """statistics() with distance, group_key and kept: false where the base rules fail or the distance is too large.

    Centre and scatter are estimated from rows that pass the base rules. Groups
    of fewer than LEAST such rows join their language's rest, and those the rest
    of all. With none at all, the base rules alone decide.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    lang, both = name("lang"), F.concat_ws("\t", name("lang"), name("source"))
    stats = stage(stats.withColumns({"_lang": lang, "_both": both}), "statistics")
    sizes = stats.groupBy("_lang", "_both").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    small = stage(sizes.withColumn("_small", F.col("n") < LEAST), "group-sizes")
    rest = small.where("_small").groupBy("_lang").agg(F.sum("n").alias("rest"))
    keys = small.join(rest, "_lang", "left")
    group = F.when(~F.col("_small"), F.col("_both")).when(F.col("rest") >= LEAST, F.concat("_lang", F.lit("\t*"))).otherwise(F.lit("*"))
    keys = stage(keys.select("_both", group.alias("_group")), "group-keys")
    n_keys = keys.count()
    rows = stats.join(F.broadcast(keys), "_both") if n_keys <= BROADCAST_GROUPS else stats.join(keys, "_both")
    rows = stage(rows.drop("_lang", "_both"), "vectors")
    good = rows.where(~F.col("base_failed"))

    shape, n_groups = estimate(good)
    # The kept rows' scatter is too small by a factor that a normal sample's distances give. It only ever widens the cut:
    # where the least deviations FLOOR decide, distances are below a normal sample's, and clean rows must not suffer for it.
    far = _with(good, shape, n_groups).select("_group", _distance(0).alias("_d"))
    factor = far.groupBy("_group").agg((F.greatest(F.percentile_approx("_d", KEEP, 2000), F.lit(1e-9)) / CHI_KEEP).alias("_factor"))
    final = stage(shape.join(factor, "_group"), "shape")
    # Outer join: a group without rows that pass has no shape.
    if n_groups <= BROADCAST_GROUPS:
        judged = rows.join(F.broadcast(final), "_group", "left")
    else:
        judged = _with(good, final, n_groups).unionByName(rows.where("base_failed"), allowMissingColumns=True)
    distance = _distance(0) / F.greatest(F.col("_factor"), F.lit(1.0))
    return judged.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CHI_CUT)).withColumnRenamed("_group", "group_key")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(statistics(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
