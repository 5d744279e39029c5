"""Operator 12: how the sources of a language differ in their terms.

Terms are counted in each task, summed by term, and kept where enough documents
of the language have them. A language's kept terms are dealt to blocks. A block
is a dense int64 matrix of groups (sources) by terms; each group's row is
held against all rows at once, which gives a partial matrix of all pairs, and
the partial matrices are summed. Where a language has many sources, its blocks
are also dealt to tiles of two ranges of sources each. The terms that a group
has more often than its language go to a heap for each group and task; heaps
are merged in two steps. All arithmetic is on integers.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_table, shipped, stage, text_slices

#: A term; only A to Z are lowered.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term needs, ranks of the term report, and the unit of shares.
LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Terms of a block on average, sources of one side of a tile on average, cells of a product at once.
BLOCK_TERMS, TILE_SOURCES, AT_ONCE = 2048, 256, 1_000_000
#: Counts that a task holds, and bytes of text that it counts, before it gives them out.
HELD, HELD_BYTES = 250_000, 1 << 30
#: Languages that may be broadcast with their sizes (each is a few numbers); more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
SALTS = 64


def _columns(docs: DataFrame) -> DataFrame:
    """(lang, source, text) with nulls as ''."""
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed over a part of a task's rows."""

    def run(batches):
        find, held, size, read = re.compile(TERM).findall, {}, 0, 0

        def rows():
            for (lang, source), own in held.items():
                if not own:
                    continue
                values = np.array(list(own.values()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(list(own)), pa.array(values >> 32), pa.array(values & 0xFFFFFFFF)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for a, b, texts in text_slices(batch):
                groups = zip(batch["lang"].slice(a, b - a).to_pylist(), batch["source"].slice(a, b - a).to_pylist())
                for group, text in zip(groups, texts):
                    own, raw = held.setdefault(group, {}), text.encode()
                    before = len(own)
                    for term, n in Counter(find(raw.lower().decode())).items():  # of bytes, only A to Z are lowered
                        own[term] = own.get(term, 0) + (n << 32) + 1  # occurrences above, documents below: both are under 2**31 between two outputs
                    size, read = size + len(own) - before, read + len(raw)
                    if size > HELD or read > HELD_BYTES:
                        yield from rows()
                        held, size, read = {}, 0, 0
        yield from rows()

    return shipped(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): the terms kept, a row for each source that has one; lang_n over all sources, first in one row of each term."""
    parts = term_counts(docs).repartition("lang", "term")  # each task has combined its own already
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = W.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_n": F.sum("n").over(own), "lang_docs": F.sum("docs").over(own), "least": F.min("source").over(own)})
    return counts.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("first"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact for totals under 9e15: a long division of three digits of a thousand each."""
    digits, rest = divmod(np.asarray(count, np.int64) + 1, total)
    for _ in range(3):
        step, rest = divmod(rest * 1000, total)
        digits = digits * 1000 + step
    return digits + 1


def pair_matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)**2 / q) for each row of p against each row of q."""
    found = np.zeros((len(p), len(q)), np.int64)
    step = max(1, AT_ONCE // max(1, q.size))
    for a in range(0, len(p), step):
        apart = p[a : a + step, None, :] - q[None, :, :]
        found[a : a + step] = (apart * apart // q[None, :, :]).sum(axis=2)
    return found


def _with_sizes(rows: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """rows with their language's sizes; where there are too many languages to broadcast, rows of a large one are spread over salts."""
    if few:
        return rows.join(F.broadcast(sizes), "lang")
    salted = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")


def _tiles(rows: DataFrame, block: Column) -> DataFrame:
    """rows (lang, source, blocks, ranges, …), once for each tile of the block in which their source is on a side."""
    own = F.pmod(F.xxhash64("source"), F.col("ranges")).cast("int")
    rows = rows.withColumns({"_block": block, "_own": own, "_other": F.explode(F.sequence(F.lit(0), (F.col("ranges") - 1).cast("int")))})
    return rows.withColumns({"tile": F.struct("lang", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), F.col("_block").alias("block")), "side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_own", "_other", "_block")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the report of each (lang, source) group of docs.

    Part 'pair' has a row for each other source of the language: by how much the
    group's shares of the kept terms differ from that source's. Part 'term' has
    the `top` terms that the group has and has more often than its language.
    Null text, lang and source count as ''. A language without kept terms has
    pairs of value 0. Repeated rows count each. Ranks go by value, then by the
    item's UTF-8 bytes. An empty table gives no rows. Other columns are ignored.
    """
    rows = _columns(docs)
    kept = stage(kept_terms(rows, least), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    groups = stage(groups.withColumn("total", F.coalesce("total", F.lit(0).cast("long"))), "groups")
    facts = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(sizes, "lang", "left").na.fill(0)
    facts = facts.select("lang", "lang_total", "terms", F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).alias("blocks"), F.ceil(F.col("sources") / TILE_SOURCES).alias("ranges"))
    facts = stage(facts, "languages")
    few = facts.count() <= BROADCAST_LANGUAGES

    cells = _tiles(_with_sizes(kept.drop("first"), facts, few), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    heads = _tiles(_with_sizes(groups, facts, few).withColumn("_b", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))), F.col("_b"))
    heads = heads.select("tile", F.lit(0).alias("kind"), "side", "source", F.lit(None).cast("string").alias("term"), "total", F.col("lang_total").alias("lang_n"), "terms")
    cells = cells.select("tile", F.lit(1).alias("kind"), "side", "source", "term", F.col("n").alias("total"), "lang_n", F.lit(0).cast("long").alias("terms"))
    dealt = heads.unionByName(cells).repartition("tile").sortWithinPartitions("tile", "kind")
    found = stage(shipped(dealt).select("tile.lang", "tile.x", "tile.y", "tile.block", "kind", "side", "source", "term", "total", "lang_n", "terms").mapInArrow(_reporter(top), "part string, lang string, source string, item string, value long, found long, of long, none long, task int"), "partial-reports")

    group = ["lang", "source"]
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").groupBy(*group, "item").agg((F.sum("value") + (F.max("of") - F.sum("found")) * F.max("none")).alias("value")).withColumn("rank", place(*group))
    terms = found.where("part = 'term'").withColumn("_salt", F.pmod("task", F.lit(SALTS)))
    terms = terms.withColumn("_place", place(*group, "_salt")).where(F.col("_place") <= top).withColumn("rank", place(*group)).where(F.col("rank") <= top)
    return pairs.select(*group, F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select(*group, F.lit("term").alias("part"), "item", "value", "rank"))


class _Heap:
    """The largest (value, item), of equal values the smallest items, at most `top` of them."""

    def __init__(self, top: int):
        self.top, self.held = top, []

    def add(self, values: np.ndarray, items: list[str]) -> None:
        if len(values) > self.top:  # those below the own top can't stay
            least = np.partition(values, len(values) - self.top)[len(values) - self.top]
            which = np.flatnonzero(values >= least).tolist()
            values, items = values[which], [items[k] for k in which]
        new = [(-v, x) for v, x in zip(values.tolist(), items)]  # Python compares strings by code point, as UTF-8 bytes do
        self.held = heapq.nsmallest(self.top, self.held + new) if len(self.held) + len(new) > self.top else self.held + new


def _reporter(top: int):
    names = ["part", "lang", "source", "item", "value", "found", "of", "none", "task"]

    def run(batches):
        task = TaskContext.get().partitionId()
        heaps: dict[tuple[str, str], _Heap] = {}
        at, sums, rows = None, None, []  # the tile's language and ranges, its sources and sum so far, the block's rows

        def out(part, lang, sources, items, values, found=0, of=0, none=None):
            n = len(items)
            none = np.zeros(n, np.int64) if none is None else none
            return pa.RecordBatch.from_arrays([*map(pa.array, ([part] * n, [lang] * n, sources, items)), *(pa.array(x, pa.int64()) for x in (values, [found] * n, [of] * n, none)), pa.array([task] * n, pa.int32())], names=names)

        def pairs():
            """The sums of a tile, both ways. A term that no source of the tile has stands in none of its matrices; `none` is what each such term adds."""
            (lang, x, y), (sides, both, found, totals, terms) = at, sums
            p = [share(np.zeros(len(t), np.int64), t + terms)[:, None] if terms else np.ones((len(t), 1), np.int64) for t in totals]
            for a, b, matrix in ((0, 1, both[0]), (1, 0, both[1])):
                if matrix is not None and sides[b]:
                    apart = pair_matrix(p[a], p[b])
                    for k, s in enumerate(sides[a]):
                        which = [j for j, t in enumerate(sides[b]) if t != s]
                        if which:
                            yield out("pair", lang, [s] * len(which), [sides[b][j] for j in which], matrix[k, which], found, terms, apart[k, which])

        def heap_rows():
            for (lang, source), h in heaps.items():
                if h.held:
                    yield out("term", lang, [source] * len(h.held), [x for _, x in h.held], [-v for v, _ in h.held])
            heaps.clear()

        def block():
            """Add the block of `rows` to its tile's sums and heaps."""
            nonlocal sums
            head = {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}
            rows.clear()
            n = int((head["kind"] == 0).sum())
            listed = sorted(zip(head["side"][:n].tolist(), head["source"][:n].tolist(), head["total"][:n].tolist()))  # in one order in all blocks
            sides = [[x for t, x, _ in listed if t == s] for s in (0, 1)]
            totals = [np.array([x for t, _, x in listed if t == s], dtype=np.int64) for s in (0, 1)]
            terms, lang_total = int(head["terms"][0]), int(head["lang_n"][0])
            cell = {c: v[n:] for c, v in head.items()}
            index: dict[str, int] = {}
            column = np.array([index.setdefault(t, len(index)) for t in cell["term"]], dtype=np.int64)
            names_ = list(index)
            shares = []
            for s in (0, 1) if at[1] != at[2] else (0,):
                number, own = {x: k for k, x in enumerate(sides[s])}, np.flatnonzero(cell["side"] == s)
                p = np.repeat(share(np.zeros(len(sides[s]), np.int64), totals[s] + terms)[:, None] if terms else np.ones((len(sides[s]), 1), np.int64), len(names_), axis=1)
                row = np.array([number[x] for x in cell["source"][own]], dtype=np.int64)
                if len(own):
                    p[row, column[own]] = share(cell["total"][own], totals[s][row] + terms)
                    if s == 0 and at[1] == at[2]:  # each cell is in one such tile
                        q = share(cell["lang_n"][own], np.int64(lang_total + terms))
                        mine = p[row, column[own]]
                        value, more = (mine - q) ** 2 // q, mine > q
                        for k in np.unique(row[more]).tolist():
                            which = np.flatnonzero(more & (row == k))
                            heaps.setdefault((at[0], sides[s][k]), _Heap(top)).add(value[which], [names_[c] for c in column[own][which].tolist()])
                shares.append(p)
            if len(shares) == 1:
                sides[1], totals[1], add = sides[0], totals[0], (pair_matrix(shares[0], shares[0]), None)
            else:
                add = (pair_matrix(*shares), pair_matrix(*shares[::-1]))
            if sums is not None:
                add = tuple(None if a is None else a + b for a, b in zip(sums[1], add))
            sums = (sides, add, len(names_) + (0 if sums is None else sums[2]), totals, terms)

        last = None
        for batch in batches:
            columns = {c: batch[c].to_pylist() if c in ("lang", "source", "term") else batch[c].to_numpy() for c in batch.schema.names}
            keys = list(zip(columns["lang"], columns["x"].tolist(), columns["y"].tolist(), columns["block"].tolist()))
            columns = {c: np.array(v, dtype=object) if isinstance(v, list) else v for c, v in columns.items()}
            k = 0
            while k < len(keys):
                end = k + 1
                while end < len(keys) and keys[end] == keys[k]:
                    end += 1
                if keys[k] != last:
                    if rows:
                        block()
                    if keys[k][:3] != at:
                        if sums is not None:
                            yield from pairs()
                        at, sums = keys[k][:3], None
                        if len(heaps) > 4 * TILE_SOURCES:
                            yield from heap_rows()
                    last = keys[k]
                rows.append({c: columns[c][k:end] for c in ("kind", "side", "source", "term", "total", "lang_n", "terms")})
                k = end
        if rows:
            block()
        if sums is not None:
            yield from pairs()
        yield from heap_rows()

    return run


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
t AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
k AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN t USING (lang, term)),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS total FROM t GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN k ON k.lang = g.lang AND k.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, t.term, coalesce(k.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 1)) // (s.total + v.terms) AS p, 1 + (1000000000::HUGEINT * (t.lang_n + 1)) // (v.total + v.terms) AS lang_p
  FROM s JOIN v USING (lang) JOIN t USING (lang) LEFT JOIN k ON k.lang = s.lang AND k.source = s.source AND k.term = t.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT FROM p WHERE n > 0 AND p > lang_p),
n AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= 200
"""
