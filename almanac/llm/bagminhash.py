"""Operator 7: near-duplicates by BagMinHash.

A document is the multiset of its runs of five words. Each run with each of the
dyadic blocks of weight levels ([0,1), [1,2), [2,4) …) owns a Poisson process;
its points fall on levels of the block and on components of the signature, and a
component keeps the earliest point below the weight. So a weight takes a few
processes and not one for each unit. Points are made in order of time, and only
until they can no longer be a minimum. Two documents
agree in a component with a probability that is their weighted Jaccard
similarity. Bands of the signature propose pairs; the multiset overlap of the
texts decides.

Texts with the same words are one node throughout. Linking takes two rounds.
First each bucket compares its members with its smallest one, so a group of
many near copies takes as many comparisons as members. Then the members outside
a bucket's largest component are compared with the bucket's other components,
in blocks of a bounded number of texts: a block counts the runs that its texts
share by products of small matrices, and gives only links that join components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_once, read_table, shipped, stage, text_of, text_slices

SHINGLE, SIMILAR = 5, 0.8
#: Bands and rows: a pair of similarity 0.8 shares no band with probability 6e-5.
BANDS, ROWS = 32, 6
M = BANDS * ROWS
#: A signature's sketch has a bit for each component; of two texts with similarity 0.8, a tenth of the bits differ
#: (19, standard deviation 4.2), and more than this many with probability 1e-5.
BITS_APART = 38
HOT, SALTS = 1000, 32
#: Texts and word runs of one side of a block, on average; and columns of its matrices.
BLOCK_TEXTS, BLOCK_RUNS, COLUMNS = 400, 200_000, 4096
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def levels(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dyadic blocks of weight levels that each integer weight reaches into: index, low end of the block.

    The blocks are [0,1), [1,2), [2,4), [4,8) …; low end 0 stands for the first.
    """
    index, low = [np.arange(len(weight))], [np.zeros(len(weight), np.uint64)]
    at, begin = np.flatnonzero(weight > 1), 1
    while len(at):
        index.append(at)
        low.append(np.full(len(at), begin, np.uint64))
        begin *= 2
        at = at[weight[at] > begin]
    return np.concatenate(index), np.concatenate(low)


def signatures(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """BagMinHash signatures (documents by m, bits of the earliest times) of distinct (document, element) rows.

    A block's process has its size as rate. Each point descends by random bits
    to one level of the block and counts where the weight is above that level,
    so equal levels of different weights see the same points.
    """
    with np.errstate(over="ignore"):
        index, low = levels(weights)
        doc, weight = docs[index], weights[index].astype(np.uint64)
        size = np.maximum(low, np.uint64(1))
        seed = _mix(elements[index] ^ _mix(low * _STEP + np.uint64(1)))
        time = np.zeros(len(seed))
        best = np.full(n_docs * m, np.inf)
        k = np.uint64(0)
        while len(seed):
            k += np.uint64(1)
            bits = _mix(seed + k * _STEP)
            place = _mix(bits + _STEP)
            time = time - np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / size
            level = low + ((place >> np.uint64(32)) & (size - np.uint64(1)))
            hit = (level < weight) | (low == 0)
            np.minimum.at(best, (doc * m + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64))[hit], time[hit])
            last = best.reshape(n_docs, m).max(axis=1)  # no later point can be a minimum
            go = time < last[doc]
            seed, time, doc, weight, size, low = seed[go], time[go], doc[go], weight[go], size[go], low[go]
    return best.view(np.uint64).reshape(n_docs, m)


def bands(signature: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = signature.reshape(len(signature), n_bands, -1)
    with np.errstate(over="ignore"):
        key = np.arange(n_bands, dtype=np.uint64)[None, :] * _STEP + np.uint64(7)
        for r in range(rows.shape[2]):
            key = _mix(key ^ rows[:, :, r])
    return key.view(np.int64)


def _word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words (same word, same key on any machine) and the number of words of each text."""
    codes: dict[bytes, int] = {}
    n, flat = [], []
    for raw in texts:
        own = raw.split()
        n.append(len(own))
        flat.append(np.fromiter((codes.setdefault(w, len(codes)) for w in own), dtype=np.int64, count=len(own)))
    if not codes:
        return np.empty(0, np.uint64), np.array(n, dtype=np.int64)
    import xxhash

    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes), dtype=np.uint64, count=len(codes))
    return keys[np.concatenate(flat)], np.array(n, dtype=np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """A bit of each component, as 64-bit integers."""
    bits = (_mix(signature) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, run of `size` words): document, key, how often. A shorter text is one run of all its words; one without words has none."""
    word, n = _word_keys(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    with np.errstate(over="ignore"):
        pad = np.concatenate([word, np.zeros(size, np.uint64)])
        key, at = np.zeros(len(word), np.uint64), np.arange(len(word))
        end = np.repeat(np.cumsum(n), n)
        for j in range(size):
            inside = at + j < end
            key = _mix((key ^ np.where(inside, pad[at + j], np.uint64(0))) * _MIX1 + np.uint64(j + 1))
    first = np.repeat(np.cumsum(n) - n, n)
    full = (at + size <= end) | (at == first)
    doc, key = doc[full], key[full]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], key[starts], np.diff(np.append(starts, len(key)))


def folded(doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets: each key once for each time it occurs, as different elements. Document, element."""
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        return np.repeat(doc, times), _mix(np.repeat(key, times) + _mix(nth.astype(np.uint64) * _STEP))


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether multisets of a and b runs, of which they share `both`, have a similarity of at least 0.8."""
    union = a + b - both
    return (union > 0) & (both >= SIMILAR * union)


def _words_digest(text: Column) -> Column:
    """16 bytes that stand for the sequence of words."""
    joined = F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))
    return F.substring(F.unhex(F.sha2(joined, 256)), 1, 16)


def band_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, keys, bits): the node is the digest of the text's words, size its number of word runs; keys and bits are null without words."""

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, 600_000):
                raw = [x.encode() for x in texts]
                doc, key, times = shingles(raw)
                size = np.bincount(doc, times, len(raw)).astype(np.int32)
                sign = signatures(key, times, doc, len(raw))
                lists = []
                for x in (bands(sign), sketch(sign)):
                    offsets = pa.array(np.arange(0, x.shape[1] * (len(raw) + 1), x.shape[1]), pa.int32())
                    lists.append(pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)), mask=pa.array(size == 0)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["node"].slice(a, b - a), pa.array(size), *lists], names=["doc_id", "node", "size", "keys", "bits"])

    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _words_digest(text).alias("node"), text.alias("text"))
    return shipped(rows).mapInArrow(run, "doc_id long, node binary, size int, keys array<long>, bits array<long>")


def _maybe(x: str, y: str) -> Column:
    """Whether two nodes' columns (size, s0, s1, …; with the prefixes x and y) leave room for a similarity of 0.8."""
    apart = sum((F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))) for k in range(M // 64)), F.lit(0))
    a, b = F.col(f"{x}size"), F.col(f"{y}size")
    return (apart <= BITS_APART) & (F.least(a, b) >= SIMILAR * F.greatest(a, b))


def _runs(rows: DataFrame) -> DataFrame:
    """(node, runs) from (node, text): the text's multiset of word runs as sorted 64-bit elements."""

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, 600_000):
                doc, element = folded(*shingles([x.encode() for x in texts]))
                element = element[np.lexsort((element, doc))]
                ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
                own = [x.tobytes() for x in np.split(element, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a), pa.array(own, pa.binary())], names=["node", "runs"])

    return shipped(rows).mapInArrow(run, "node binary, runs binary")


def _spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with facts (at most one row for each key); the keys of over 1/HOT of the `total` rows are spread over SALTS by a column of rows.

    Only the hot keys themselves are broadcast, fewer than HOT of them; their
    facts are copied to each salt. counts (key, n) are the rows of each key, where
    they are known already.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.where(F.col("n") * HOT > total).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = facts.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _verified(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough. runs: (node, runs), one row for each node."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part, keep = batch.slice(k, 500), []
                for x, y in zip(part["s"], part["t"]):
                    p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                    both = np.sort(np.concatenate([p, q]), kind="stable")
                    keep.append(bool(similar(np.count_nonzero(both[1:] == both[:-1]), len(p), len(q))))
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one, two = runs.select(F.col("node").alias("a"), F.col("runs").alias("s")), runs.select(F.col("node").alias("b"), F.col("runs").alias("t"))
    return _spread_join(shipped(pairs), two, "b", "a", pairs.count()).join(one, "a").select("a", "b", "s", "t").mapInArrow(run, "a binary, b binary")


def block_links(root: np.ndarray, runs: list[bytes]) -> list[tuple[int, int]]:
    """Links between similar texts of different roots, as many as join what the block's texts join.

    runs are the texts' sorted elements. Shared elements are counted by matrix
    products over a bounded number of columns.
    """
    n, sets = len(runs), [np.frombuffer(x, dtype=np.uint64) for x in runs]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    element, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    name = np.cumsum(times > 1) - 1
    seen = times[column] > 1  # an element of one text is shared with none
    row, column = np.repeat(np.arange(n), size)[seen], name[column[seen]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), dtype=np.float32)  # whole numbers below 2**24
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [begin, begin + COLUMNS])
        own = np.zeros((n, int(column[y - 1]) + 1 - begin), dtype=np.float32)
        own[row[x:y], column[x:y] - begin] = 1
        both += own @ own.T
    a, b = np.nonzero(similar(both, size[:, None], size[None, :]) & (root[:, None] != root[None, :]))
    parent, links = {r: r for r in root.tolist()}, []
    for p, q in zip(a.tolist(), b.tolist()):
        if p < q:
            at = []
            for x in (root[p], root[q]):
                x = int(x)
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                at.append(x)
            if at[0] != at[1]:
                parent[max(at)] = min(at)
                links.append((p, q))
    return links


def _across(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Links (a, b) between members (key, node, root, largest, size) of a key with different roots.

    A key's members are dealt to slices: those of its largest root, and the
    rest. Each slice of the rest meets every slice, in a block of its own, so a
    block holds two slices, and a member is copied once for each block.
    """
    big = F.col("root") == F.col("largest")
    slices = lambda c: F.ceil(F.greatest(F.sum(F.when(c, 1).otherwise(0)) / BLOCK_TEXTS, F.sum(F.when(c, F.col("size")).otherwise(0)) / BLOCK_RUNS)).cast("int")
    counts = stage(members.groupBy("key").agg(slices(~big).alias("rest"), slices(big).alias("most"), F.count(F.lit(1)).alias("n")), "slices")
    rows = _spread_join(members, counts.drop("n"), "key", "node", members.count(), counts).withColumn("own", F.when(big, F.col("rest") + F.pmod(F.xxhash64("node"), F.col("most"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(big, F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1))
    rows = rows.select("node", "root", "size", "key", "own", F.explode(others).alias("other"))
    rows = rows.select("node", "root", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block")).join(runs, "node")

    def run(batches):
        at, nodes, roots, own = None, [], [], []

        def links():
            number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
            found = block_links(np.array([number[r] for r in roots]), own) if len(number) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p] for p, _ in found], pa.binary()), pa.array([nodes[q] for _, q in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for block, node, root, x in zip(*(part[c].to_pylist() for c in ("block", "node", "root", "runs"))):
                    if block != at:
                        if nodes:
                            yield links()
                        at, nodes, roots, own = block, [], [], []
                    nodes.append(node)
                    roots.append(root)
                    own.append(x)
        if nodes:
            yield links()

    dealt = rows.select("block", "node", "root", "runs").repartition("block").sortWithinPartitions("block")
    return shipped(dealt).mapInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links (a, b) the smallest node that it is connected with.

    Large-star and small-star rounds over staged tables until nothing changes;
    each halves the distance to the root, and no group of links is collected.
    """
    both = lambda t: t.select("a", "b").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, seen = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        least, n = both(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), edges.count()
        large = _spread_join(both(edges).where("b > a"), least, "a", "b", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _spread_join(large, least, "a", "b", n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = stage(small.where("a <> b").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, node, keys, …), one for each of docs, and nodes (node, first, n, root): first is the node's smallest doc_id, n its number of rows."""
    rows = stage(band_keys(docs), "bands")
    nodes = rows.where("keys IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    nodes = stage(nodes, "nodes")
    sketches = nodes.select("node", "size", *(F.col("bits")[k].alias(f"s{k}") for k in range(M // 64)))
    facts = ["size", *(f"s{k}" for k in range(M // 64))]
    prefixed = lambda df, p: df.select(F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in facts))

    # Buckets with more than one node; most have one and are gone after the first sum.
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    center = stage(buckets.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centers")
    shared = stage(_spread_join(buckets, center.drop("n"), "key", "node", BANDS * nodes.count(), center), "buckets")
    pairs = shared.select(F.col("node").alias("a"), F.col("center").alias("b")).where("a <> b").distinct()
    pairs = stage(pairs, "candidates")
    pairs = _spread_join(pairs, prefixed(sketches, "b"), "b", "a", pairs.count()).join(prefixed(sketches, "a"), "a").where(_maybe("a_", "b_")).select("a", "b")
    pairs = stage(pairs, "pairs")

    # Word runs of the nodes that share a bucket; the text of the smallest doc_id stands for each.
    holder = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("first").alias("_first"))
    text = text_of(docs)
    own = docs.select(_words_digest(text).alias("node"), docs["doc_id"].cast("long").alias("_id"), text.alias("text"))
    texts = own.join(holder, "node").where(F.col("_id").eqNullSafe(F.col("_first"))).groupBy("node").agg(F.min("text").alias("text"))
    runs = stage(_runs(texts), "runs")

    links = stage(_verified(pairs, runs), "similar")
    found = stage(components(links), "roots")
    # What shares a bucket but no component yet.
    crowded = shared.select("key", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = crowded.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    largest = stage(largest, "largest")
    crowded = stage(_spread_join(crowded, largest.drop("n"), "key", "node", shared.count(), largest).join(nodes.select("node", "size"), "node"), "crowded")
    more = stage(_across(crowded, runs), "similar")
    if not more.isEmpty():
        found = stage(components(links.unionByName(more)), "roots")

    return rows, nodes.join(found, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size) for each row of docs: the class is the smallest doc_id that a row is linked with.

    Texts with the same sequence of words (of at least one) are one node; nodes
    are linked when their similarity is at least 0.8, also through others. Null
    and empty texts and those of white space are in no class but their own row's:
    class_id is the doc_id, which may be null. An empty table gives no rows.
    """
    rows, classes = _linked(docs)
    classes = stage(classes, "roots")
    sums = classes.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    classes = stage(_spread_join(classes, sums, "root", "node", classes.count()).select("node", "class_id", "class_size", "n"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.where(F.col("n") * HOT > total).drop("n")  # fewer than HOT nodes
    has = rows.where("keys IS NOT NULL").select("doc_id", "node")
    out = has.join(F.broadcast(hot), "node").unionByName(has.join(F.broadcast(hot.select("node")), "node", "left_anti").join(classes.drop("n"), "node"))
    none = rows.where("keys IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.select("doc_id", "class_id", "class_size").unionByName(none)


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, with the class's smallest doc_id (null last), and all rows without words.

    Other rows with that doc_id go by their own class: a repeated doc_id costs
    no row of another class. Of rows that repeat doc_id and words, one stays.
    """
    rows, nodes = _linked(docs)
    keep = nodes.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("x")).select(F.col("x.first").alias("doc_id"), F.col("x.node").alias("node"))
    keep = stage(keep, "kept")
    counts = rows.where("keys IS NOT NULL").groupBy("doc_id", "node").count().where("count > 1")
    wordless = rows.where("keys IS NULL").select("doc_id", "node").distinct()
    keys = {"doc_id": docs["doc_id"].cast("long"), "node": _words_digest(text_of(docs))}
    return keep_once(docs, keys, keep.unionByName(wordless), stage(counts.drop("count"), "again"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))
