"""Operator 10: substring dedup by content-defined chunks.

A gear rolling hash runs over each text's characters. A chunk boundary is
where the hash is the least of a stretch of WIDTH places, so boundaries depend
on the characters nearby alone, come back in step after an insertion, and are
at most WIDTH apart in any script, with or without spaces. From each boundary
on, the shortest series of whole chunks with at least LEAST characters is a
window; windows are compared by 128-bit BLAKE2 digests over the whole corpus.
A window that two documents hold is thus a passage that each holds in one
piece, and neighbouring windows with neighbouring places in one and the same
document make one longer passage.

Of a window's places the first one (least doc_id) stays. The other places'
chunks may go: each has an equal chunk at an earlier place, so the earliest of
them is never removed.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_table, shipped, stage, text_of, text_slices

#: Greatest distance of boundaries, characters of a window at least, and characters that the gear hash sees.
WIDTH, LEAST, REACH = 64, 96, 16
#: Every passage of so many characters that two documents share holds a whole window, wherever the boundaries fall.
SURE = WIDTH + REACH + LEAST + WIDTH
#: A digest with more than 1/HOT of all windows is hot, so there are fewer than HOT of them.
HOT, SALTS = 10_000, 1024
_PLACE = ("doc_id", "tie", "seq")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gear(points: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each code point: h = 2 h + value of the code point, over the last REACH of them."""
    with np.errstate(over="ignore"):
        h = (_mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        for k in (1, 2, 4, 8):  # sums of 2, 4, 8, REACH shifted terms
            more = np.zeros_like(h)
            more[k:] = h[:-k] << k
            h = h + more
    return h


def collapsed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' code points with each run of white space as one space; each one's place in its text; sizes of the texts."""
    raw = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    points = np.concatenate(raw) if raw else np.empty(0, "<u4")
    first = np.cumsum(sizes) - sizes
    space = (points == 32) | ((points >= 9) & (points <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[first[sizes > 0]] = True
    text = np.repeat(np.arange(len(texts)), sizes)[keep]
    own = np.where(space, np.uint32(32), points)[keep]
    return own, np.flatnonzero(keep) - first[text], np.bincount(text, minlength=len(texts)).astype(np.int64)


def boundaries(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the chunk boundaries in the joined texts: each text's begin and end, and before each least hash of WIDTH places.

    Where equal least hashes come within WIDTH (text with a short period), one boundary for each WIDTH places stays.
    """
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # Each text is hashed after the same REACH characters, whatever text goes before it.
    lead = np.arange(len(points)) + REACH * (text + 1)
    padded = np.full(len(points) + REACH * len(sizes), 32, dtype=np.uint32)
    padded[lead] = points
    h = gear(padded)[lead]
    cuts = np.empty(0, np.int64)
    if len(points) >= WIDTH:
        least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while k < WIDTH:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        inside = text[: len(least)] == text[WIDTH - 1 :]
        cuts = np.unique(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if len(cuts):
        new = np.ones(len(cuts), dtype=bool)
        new[1:] = (h[cuts[1:]] != h[cuts[:-1]]) | (np.diff(cuts) >= WIDTH) | (text[cuts[1:]] != text[cuts[:-1]])
        step = (cuts - cuts[np.flatnonzero(new)][np.cumsum(new) - 1]) // WIDTH
        new[1:] |= step[1:] != step[:-1]
        cuts = cuts[new]
    return np.unique(np.concatenate([cuts, ends - sizes, ends]))


def windows(texts: list[str]) -> dict[str, np.ndarray | list[bytes]]:
    """All windows of all texts in order: text, seq in it, start and stop in its code points, digest."""
    points, place, sizes = collapsed(texts)
    cuts, ends = boundaries(points, sizes), np.cumsum(sizes)
    at = np.searchsorted(cuts, cuts + LEAST, side="left")
    begin = cuts[at < len(cuts)]
    end = cuts[at[at < len(cuts)]]
    text = np.searchsorted(ends, begin, side="right")
    good = (text < len(sizes)) & (end <= ends[np.minimum(text, len(sizes) - 1)]) if len(sizes) else np.zeros(0, bool)
    begin, end, text = begin[good], end[good], text[good]
    view = memoryview(np.ascontiguousarray(points, dtype="<u4")).cast("B") if len(points) else b""
    digests = [blake2b(view[a:b], digest_size=16).digest() for a, b in zip((4 * begin).tolist(), (4 * end).tolist())]
    seq = np.arange(len(text)) - np.searchsorted(text, text, side="left")
    return {"text": text, "seq": seq, "start": place[begin], "stop": place[end - 1] + 1, "digest": digests}


def window_rows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, tie, seq, start, stop): a row for each window; tie tells texts with one doc_id apart, h1 and h2 are the digest."""

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, 1_000_000):
                got = windows(texts)
                own = pa.array(got["text"])
                digest = np.frombuffer(b"".join(got["digest"]), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[:, 0]), pa.array(digest[:, 1]), *(batch[c].slice(a, b - a).take(own) for c in ("doc_id", "tie")), *(pa.array(got[c].astype(np.int32)) for c in ("seq", "start", "stop"))],
                    names=["h1", "h2", *_PLACE, "start", "stop"],
                )

    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return shipped(rows).mapInArrow(run, "h1 long, h2 long, doc_id long, tie long, seq int, start int, stop int")


def _first():
    """The first of a window's places: least doc_id, null last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), *_PLACE))


def _shared(docs: DataFrame, within: bool) -> DataFrame:
    """Windows that occur in several documents (within: or in several places): _PLACE, start, stop, first, n_docs.

    Digests that hold many of the windows are few. They are summed in the tasks
    before any shuffle, and the sums go back to their windows by broadcast. All
    windows meet by digest in one shuffle, into which the hot digests go salted.
    """
    rows = window_rows(docs)
    top = rows.agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(h1, {HOT}, {10 * HOT})").alias("top"))
    top = top.select("total", F.explode("top").alias("x")).where(F.col("x.count") * HOT > F.col("total"))
    hot = F.broadcast(stage(top.select(F.col("x.item").alias("h1"), F.lit(True).alias("hot")), "hot-windows"))  # fewer than HOT rows
    rows = rows.join(hot, "h1", "left")

    each = rows.where("hot").groupBy("h1", "h2", "doc_id", "tie").agg(F.min("seq").alias("seq"), F.countDistinct("seq").alias("p") if within else F.lit(0).alias("p"))
    sums = each.groupBy("h1", "h2").agg(_first().alias("s_first"), F.count(F.lit(1)).alias("s_docs"), F.sum("p").alias("s_places"))
    sums = F.broadcast(stage(sums, "hot-firsts"))  # as many rows as hot digests

    digest = W.partitionBy("h1", "h2", "salt")
    rows = rows.select("h1", "h2", F.when(F.col("hot"), F.pmod("tie", F.lit(SALTS))).otherwise(F.lit(-1)).cast("int").alias("salt"), *_PLACE, "start", "stop")
    rows = rows.withColumns({"first": _first().over(digest), "n": F.dense_rank().over(digest.orderBy("doc_id", "tie")), "p": F.dense_rank().over(digest.orderBy(*_PLACE)) if within else F.lit(0)})
    rows = rows.withColumns({"n_docs": F.max("n").over(digest), "places": F.max("p").over(digest)}).join(sums, ["h1", "h2"], "left")
    best = lambda own, all_: F.when(F.col("salt") < 0, F.col(own)).otherwise(F.col(all_))
    found = rows.select(*_PLACE, "start", "stop", best("first", "s_first").alias("first"), best("n_docs", "s_docs").cast("long").alias("n_docs"), best("places", "s_places").alias("places"))
    return found.where((F.col("n_docs") > 1) | (F.col("places") > 1)).drop("places")


def repeated_passages(docs: DataFrame, within: bool = False) -> DataFrame:
    """(doc_id, text_hash, start, stop, n_chars, first_doc, n_docs, removed): passages of a document that other documents hold too.

    start and stop are code points of the text, stop exclusive. Runs of white
    space count as one space. Every passage of at least SURE characters that
    two documents share is found, but for up to WIDTH + REACH characters at its
    begin and WIDTH at its end. A passage with removed = true is held whole by
    the document first_doc, which has its windows first; one with removed =
    false is what this document holds first, and stays. No character is in two
    rows of a text, so where passages overlap the later one is cut and may be
    shorter than LEAST. n_docs is the number of documents that hold the
    passage's rarest window. within: also a text's repetitions of itself.

    Rows with one doc_id and different texts are documents of their own, told
    apart by text_hash; rows that agree in both are one document, so they are
    no repetition. Rows without a doc_id come last in the order of first
    places. Null and short texts have no windows. An empty table gives no rows.
    """
    found = _shared(docs, within).repartition("doc_id", "tie").dropDuplicates(list(_PLACE))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tie") == F.col("tie"))
    own = (same & (F.col("first.seq") == F.col("seq"))) if within else same
    document = W.partitionBy("doc_id", "tie")
    order = document.orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    on = (F.col("seq") == before("seq") + 1) & (F.col("own") == before("own"))
    along = F.col("first.doc_id").eqNullSafe(before("first.doc_id")) & (F.col("first.tie") == before("first.tie")) & (F.col("first.seq") == before("first.seq") + 1)
    found = found.withColumn("own", own).withColumn("new", (~F.coalesce(on & (F.col("own") | along), F.lit(False))).cast("int"))
    found = found.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = found.groupBy("doc_id", "tie", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("own").alias("own"), F.first("first.doc_id").alias("first_doc"), F.min("n_docs").alias("n_docs"))
    # What goes is cut where an earlier passage to go reaches into it, what stays where a passage to go does.
    order = document.orderBy("run")
    gone = lambda c: F.when(~F.col("own"), F.col(c))
    runs = runs.withColumns({"low": F.max(gone("stop")).over(order.rowsBetween(W.unboundedPreceding, -1)), "high": F.min(gone("start")).over(order.rowsBetween(1, W.unboundedFollowing))})
    start, stop = F.greatest("start", F.coalesce("low", F.lit(0))), F.when(F.col("own"), F.least("stop", F.coalesce("high", "stop"))).otherwise(F.col("stop"))
    runs = runs.select("doc_id", F.col("tie").alias("text_hash"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), (stop - start).cast("long").alias("n_chars"), "first_doc", "n_docs", (~F.col("own")).alias("removed"))
    return runs.where("n_chars > 0")


def without_repeats(docs: DataFrame, within: bool = False) -> DataFrame:
    """docs with the passages to be removed cut out of their texts; all rows and columns stay, null texts stay null."""
    spans = repeated_passages(docs, within).where("removed").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_tie")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    names, at = docs.columns, docs.columns.index("text")
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(text_of(docs)).alias("_hash"))
    own = own.join(spans, own["_id"].eqNullSafe(spans["_doc"]) & (own["_hash"] == spans["_tie"]), "left").select("_row", "_spans")

    def run(batches):
        for batch in batches:
            columns = [batch["_row"].field(k) for k in range(len(names))]
            texts = columns[at].to_pylist()
            for k, cut in enumerate(batch["_spans"].to_pylist()):
                if cut:
                    ends = [0, *(x["stop"] for x in cut)]
                    texts[k] = "".join(texts[k][a:b] for a, b in zip(ends, [*(x["start"] for x in cut), len(texts[k])]))
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return shipped(own).mapInArrow(run, docs.schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
