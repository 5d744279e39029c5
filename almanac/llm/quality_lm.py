"""Operator 5: quality by the perplexity of an interpolated modified Kneser-Ney model.

The model predicts each character from the ORDER - 1 before it, for each
language, over an open alphabet, and is trained on all trusted documents.

The n-grams of all texts are counted in blocks of texts (one for each task).
Their sums, the sums of their contexts and the probabilities of each order, on
top of those of the order below, come from joins of tables that are sharded by
n-gram. The blocks' n-grams are joined with the probabilities, and each block
meets its n-grams again in one task, which adds up its documents. So what is
shuffled of the model is the distinct n-grams of each block, and no table is
held whole by any task or the driver.

A document is rejected when its perplexity is above a quantile of what its
language's trusted documents show when they are left out of the training. Of
trusted documents with the same words one counts, and a document's part of the
trusted text is chosen by its rarest run of words, so that what is left out
takes its near copies along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, shipped, stage, text_of, text_slices

#: Characters of an n-gram. A begin and an end of text are symbols beyond Unicode; a symbol takes WIDE bytes.
ORDER, START, END, WIDE = 4, 0x110000, 0x110001, 3
#: Text bytes of a block, unless the input's partitions are larger; those of a block where there are fewer blocks than cores; text bytes held at once.
BLOCK_BYTES, SMALL_BYTES, SLICE_BYTES = 64_000_000, 2_000_000, 1_500_000
#: Trusted characters a language needs for a model of its own; the rest share one of all languages.
LEAST_CHARS = 20_000
#: Trusted ids (32 MB) and languages that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_LANGUAGES = 4_000_000, 100_000
#: Threshold: quantile Q of the trusted rates, each by a model of the other parts of the trusted text.
Q, FOLDS = 0.98, 2
#: Symbols at the language's mean rate that a document counts as having besides its own when it is held against the threshold: the rate of a short text says little.
PRIOR = 100
#: Words of the runs by which near copies are held together.
RUN = 5
POOL = "*"
#: Counts of the model of all trusted text and of those that leave out one part.
_COUNTS = ("n", *(f"n_{k}" for k in range(FOLDS)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct doc_ids with quality 1 in all their rows and toxic 1 in none; null ids are left out."""
    of = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    found = of.agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
    return found.where("q = 1 AND t = 0").select("doc_id")


def trusted_parts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, fold) of the trusted documents that count: of those with the same words in any case, the one with the smallest id.

    fold is by the smallest hash of a document's runs of RUN words, which near
    copies mostly share; in a language whose documents all share it, by the
    document's own hash. ids may be broadcast by the caller.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _lang(docs).alias("lang"), text_of(docs).alias("text")).join(ids, "doc_id", "left_semi")
    own = own.select("doc_id", "lang", F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - RUN + 1, F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice("words", k, F.lit(RUN)), " ")))
    fold = lambda c: F.pmod(F.xxhash64(c), F.lit(FOLDS)).cast("int")
    own = own.select("doc_id", "lang", F.sha2(F.array_join("words", " "), 256).alias("same"), fold(F.array_min(runs)).alias("fold"))
    own = stage(own.groupBy("same").agg(F.min(F.struct("doc_id", "lang", "fold")).alias("x")).select("same", "x.*"), "trusted-folds")
    one = stage(own.groupBy("lang").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).where("a = b").select("lang", F.lit(True).alias("one")), "one-fold")
    own = own.join(F.broadcast(one) if one.count() <= BROADCAST_LANGUAGES else one, "lang", "left")
    return own.groupBy("doc_id").agg(F.min(F.when(F.col("one"), fold(F.col("same"))).otherwise(F.col("fold"))).alias("fold"))


def grams(texts: list[str], order: int = ORDER):
    """Ranges of n-gram places of the texts: the text of each place, the range's distinct n-grams as bytes, and which of them stands at each place.

    Symbols are numbered within a range, so that an n-gram is one integer; a
    range that has too many for that is halved.
    """
    raw = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    begin = np.cumsum(sizes + order) - (sizes + order)
    points = np.full(int((sizes + order).sum()), START, dtype=np.int32)  # a slice has far fewer than 2**31 places
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    place = np.arange(len(text), dtype=np.int32) + np.repeat((begin - (np.cumsum(sizes + 1) - (sizes + 1))).astype(np.int32), sizes + 1)  # where each text's n-grams begin
    for at, x in zip((begin + order - 1).tolist(), raw):
        points[at : at + len(x)] = x
    points[begin + order - 1 + sizes] = END
    bits, todo = 64 // order, [(0, len(place))] if len(place) else []
    number = np.zeros(END + 1, dtype=np.uint64)
    while todo:
        a, b = todo.pop()
        own = points[place[a] : place[b - 1] + order]
        seen = np.zeros(END + 1, dtype=bool)
        seen[own] = True
        symbols = np.flatnonzero(seen)
        if len(symbols) > 2**bits:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        number[symbols] = np.arange(len(symbols), dtype=np.uint64)
        own = number[own]
        code = np.zeros(b - a, dtype=np.uint64)
        for j in range(order):
            code = (code << np.uint64(bits)) | own[place[a:b] - place[a] + j]
        distinct, which = np.unique(code, return_inverse=True)
        mask = np.uint64(2**bits - 1)
        wide = np.stack([symbols[(distinct >> np.uint64(bits * (order - 1 - j))) & mask] for j in range(order)], axis=1).astype(">u4")
        flat = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, order, 4)[:, :, 4 - WIDE :]).tobytes()
        yield text[a:b], [flat[k : k + order * WIDE] for k in range(0, len(flat), order * WIDE)], which


def _by_model(models: list[str]) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for k, m in enumerate(models):
        at.setdefault(m, []).append(k)
    return at


def block_grams(texts: DataFrame, pooled: bool) -> DataFrame:
    """(block, model, g, c_0, …): the distinct n-grams of each block's texts, and how often each part of the trusted text has them there."""

    def run(batches):
        block, found, counts = 0, {}, {}

        def add(model: str, own: list[str], fold: np.ndarray):
            index, old = found.setdefault(model, {}), counts.get(model, np.zeros((0, FOLDS), np.int64))
            for text, names, which in grams(own):
                at = np.array([index.setdefault(g, len(index)) for g in names])
                old = np.concatenate([old, np.zeros((max(0, len(index) - len(old)), FOLDS), np.int64)])
                for k in range(FOLDS):
                    old[at, k] += np.bincount(which[fold[text] == k], minlength=len(names))
            counts[model] = old

        for batch in batches:
            block = batch["block"][0].as_py() if batch.num_rows else block  # the same in all rows of a task
            for a, b, own in text_slices(batch, SLICE_BYTES):
                fold = batch["fold"].slice(a, b - a).to_numpy()
                for model, at in _by_model(batch["model"].slice(a, b - a).to_pylist()).items():
                    add(model, [own[k] for k in at], fold[at])
                    trusted = [k for k in at if fold[k] >= 0]
                    if pooled and model != POOL and trusted:
                        add(POOL, [own[k] for k in trusted], fold[trusted])
        for model, index in found.items():
            names = list(index)
            for a in range(0, len(names), 50_000):
                own = names[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(own), pa.int32()), pa.array([model] * len(own)), pa.array(own, pa.binary()), *(pa.array(counts[model][a : a + 50_000, k]) for k in range(FOLDS))],
                    names=["block", "model", "g", *(f"c_{k}" for k in range(FOLDS))],
                )

    return shipped(texts).select("block", "model", "fold", "text").mapInArrow(run, "block int, model string, g binary, " + ", ".join(f"c_{k} long" for k in range(FOLDS)))


def _discounts(counts: DataFrame, few: bool) -> DataFrame:
    """For each model and count column the three discounts of modified Kneser-Ney, from the numbers of n-grams seen 1 to 4 times, and the number of n-grams."""
    sums = [F.sum((F.col(c) == k).cast("double")).alias(f"{c}_t{k}") for c in _COUNTS for k in range(1, 5)]
    t = counts.groupBy("model").agg(*sums, *(F.sum((F.col(c) > 0).cast("double")).alias(f"{c}_seen") for c in _COUNTS))
    found = []
    for c in _COUNTS:
        n = lambda k: F.col(f"{c}_t{k}")  # noqa: B023, E731
        y = F.try_divide(n(1), n(1) + 2 * n(2))
        for k in (1, 2, 3):  # half the count where the numbers give no discount between none and all of it
            d = k - (k + 1) * y * F.try_divide(n(k + 1), n(k))
            found.append(F.when((d > 0) & (d < k), d).otherwise(k / 2).alias(f"{c}_d{k}"))
    t = t.select("model", *found, *(f"{c}_seen" for c in _COUNTS))
    return F.broadcast(t) if few else t


def probabilities(counts: DataFrame, order: int = ORDER, few: bool = True) -> DataFrame:
    """(model, g, p_n, p_n_0, …): the probability of each n-gram's last symbol after the others, by the model of each count column.

    counts: (model, g, n, n_0, …), one row for each n-gram, which may have zero
    counts. Orders below use continuation counts: the number of different
    symbols seen before. The lowest order is interpolated with equal shares of
    all symbols seen in its model and one for any other. A model without
    trusted text has null probabilities. few: there are few models.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = F.expr(f"substring(g, {WIDE + 1}, {WIDE * k})").alias("g")
        tables[k] = stage(tables[k + 1].groupBy("model", shorter).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in _COUNTS)), f"grams-{k}")
    below = None
    for k in range(1, order + 1):
        rows = tables[k].join(_discounts(tables[k], few), "model")
        cut = lambda c: F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, F.col(f"{c}_d1")).when(F.col(c) == 2, F.col(f"{c}_d2")).otherwise(F.col(f"{c}_d3"))
        rows = rows.withColumns({"context": F.expr(f"substring(g, 1, {WIDE * (k - 1)})"), **{f"{c}_cut": F.least(cut(c), F.col(c).cast("double")) for c in _COUNTS}})
        sums = rows.groupBy("model", "context").agg(*(F.sum(x).alias(y) for c in _COUNTS for x, y in ((c, f"{c}_all"), (f"{c}_cut", f"{c}_freed"))))
        rows = rows.join(F.broadcast(sums) if few and k == 1 else sums, ["model", "context"])  # one context for each model
        if k > 1:
            rows = rows.withColumn("rest", F.expr(f"substring(g, {WIDE + 1}, {WIDE * (k - 1)})"))
            rows = rows.join(below.withColumnRenamed("g", "rest"), ["model", "rest"])
        found = []
        for c in _COUNTS:
            low = F.col(f"p_{c}") if k > 1 else F.when(F.col(f"{c}_seen") > 0, 1 / (F.col(f"{c}_seen") + 1))
            own = (F.col(c) - F.col(f"{c}_cut") + F.col(f"{c}_freed") * low) / F.col(f"{c}_all")
            found.append(F.when(F.col(f"{c}_all") > 0, own).otherwise(low).alias(f"p_{c}"))
        below = stage(rows.select("model", "g", *found), f"probabilities-{k}")  # each order is a plan of its own
    return below


def _payload(batch: pa.RecordBatch) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _scored(texts: DataFrame, bits: DataFrame, whole: bool = False) -> DataFrame:
    """texts (block, row, model, fold, text) as (row, model, fold, n_chars, bits, held), whole: and text; by bits (block, model, g, b_n, b_n_0, …).

    held is by the model that leaves out the row's part; null for rows that are
    in no part. The blocks are texts' partitions, as in block_grams(); where a
    partition has other rows the second time, the task fails.
    """
    row = texts.schema["row"].dataType
    n_blocks = max(1, texts.rdd.getNumPartitions())
    values = [f"b_{c}" for c in _COUNTS]
    fields = ["row", "model", "fold", "n_chars", "bits", "held"] + ["text"] * whole
    types = [row, T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DoubleType()] + [T.StringType()] * whole
    schema = "block int, kind int, model string, g binary, " + ", ".join(f"{v} double" for v in values) + ", payload binary"

    def pack(batches):
        for batch in batches:
            for a, b, _ in text_slices(batch, SLICE_BYTES // 2):
                columns = {"block": batch["block"].slice(a, 1), "kind": pa.array([1], pa.int32()), "model": pa.nulls(1, pa.string()), "g": pa.nulls(1, pa.binary())}
                columns |= {v: pa.nulls(1, pa.float64()) for v in values} | {"payload": pa.array([_payload(pa.RecordBatch.from_struct_array(batch.slice(a, b - a).to_struct_array()))], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches):
        import zstandard

        at, tables = None, {}
        for batch in batches:
            kind = batch["kind"].to_numpy()
            blocks = batch["block"].to_numpy()
            k = 0
            while k < batch.num_rows:
                if blocks[k] != at:
                    at, tables = blocks[k], {}
                same = (blocks[k:] == at) & (kind[k:] == kind[k])
                end = k + (len(same) if same.all() else int(np.argmin(same)))
                if kind[k] == 0:
                    own = batch.slice(k, end - k)
                    numbers = np.stack([own[v].to_numpy(zero_copy_only=False) for v in values], axis=1)
                    grams_ = own["g"].to_pylist()
                    for model, rows in _by_model(own["model"].to_pylist()).items():
                        index, parts = tables.setdefault(model, ({}, []))
                        for r in rows:
                            index[grams_[r]] = len(index)
                        parts.append(numbers[rows])
                else:
                    for payload in batch["payload"].slice(k, end - k):
                        for part in pa.ipc.open_stream(zstandard.decompress(payload.as_buffer())):
                            yield _sums(part, tables, at)
                k = end

    def _sums(part: pa.RecordBatch, tables: dict, block: int) -> pa.RecordBatch:
        texts_, fold = part["text"].to_pylist(), part["fold"].to_numpy()
        total, held = np.zeros(len(texts_)), np.full(len(texts_), np.nan)
        for model, at in _by_model(part["model"].to_pylist()).items():
            if model not in tables:
                raise RuntimeError(f"block {block} has other rows than when its n-grams were counted: stage the documents first")
            index, parts = tables[model]
            if len(parts) > 1:
                parts[:] = [np.concatenate(parts)]
            sums = np.zeros((len(at), len(values)))
            for text, names, which in grams([texts_[k] for k in at]):
                try:
                    rows = np.array([index[g] for g in names])
                except KeyError:
                    raise RuntimeError(f"block {block} has other rows than when its n-grams were counted: stage the documents first") from None
                own = parts[0][rows]
                for v in range(len(values)):
                    if v == 0 or (fold[at] == v - 1).any():
                        sums[:, v] += np.bincount(text, own[which, v], len(at))
            total[at] = sums[:, 0]
            for v in range(FOLDS):
                own = np.flatnonzero(fold[at] == v)
                held[np.array(at)[own]] = sums[own, v + 1]
        arrays = [part["row"], part["model"], part["fold"], pa.array([len(x) for x in texts_], pa.int64()), pa.array(total, from_pandas=True), pa.array(held, from_pandas=True)]
        return pa.RecordBatch.from_arrays([*arrays, part["text"]] if whole else arrays, names=fields)

    packed = shipped(texts).mapInArrow(pack, schema)
    told = bits.select("block", F.lit(0).alias("kind"), "model", "g", *values, F.lit(None).cast("binary").alias("payload"))
    met = told.unionByName(packed).repartition(n_blocks, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(fields, types)]))


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit("null"))


def judged(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """(row, lang, n_chars, perplexity, shrunk, threshold, kept) for each row of docs: see score(); row holds its columns `keep`. Without them, it holds all but the text, which comes beside it (null as '')."""
    whole = not keep
    row = F.struct(*(docs[f"`{c}`"] for c in keep or [c for c in docs.columns if c != "text"])).alias("row")
    also = ["text"] * whole
    texts = docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), _lang(docs).alias("lang"), text_of(docs).alias("text"))
    ids = stage(trusted_ids(labels), "labelled")
    ids = stage(trusted_parts(docs, F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids), "trusted")
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    languages = texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(F.col("fold") >= 0, F.length("text")).otherwise(0)).alias("trusted"))
    languages = stage(languages.withColumn("model", F.when(F.col("trusted") >= LEAST_CHARS, F.col("lang"))), "languages")
    size, trusted, n, own = languages.agg(F.sum("bytes"), F.sum("trusted"), F.count("lang"), F.count("model")).first()
    lang = F.when(F.col("lang") != "null", F.expr("substring(lang, 2)")).alias("lang")
    if not trusted:
        nothing = F.lit(None).cast("double")
        return texts.select("row", lang, F.length("text").cast("long").alias("n_chars"), nothing.alias("perplexity"), nothing.alias("shrunk"), nothing.alias("threshold"), (F.length("text") > 0).alias("kept"), *also)
    few = own <= BROADCAST_LANGUAGES
    models = languages.where("model IS NOT NULL").select("lang", "model")
    texts = texts.join(F.broadcast(models) if few else models, "lang", "left").withColumn("model", F.coalesce("model", F.lit(POOL))).drop("doc_id")
    texts = texts.withColumn("row", F.struct(F.col("row").alias("own"), "lang")).coalesce(max(1, -(-size // BLOCK_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, size // SMALL_BYTES))).withColumn("block", F.spark_partition_id())

    found = stage(block_grams(texts, n > own), "block-grams")
    total = F.col("c_0") + sum((F.col(f"c_{k}") for k in range(1, FOLDS)), F.lit(0))
    counts = found.groupBy("model", "g").agg(*(F.sum(f"c_{k}").alias(f"c_{k}") for k in range(FOLDS))).select("model", "g", total.alias("n"), *((total - F.col(f"c_{k}")).alias(f"n_{k}") for k in range(FOLDS)))
    p = probabilities(stage(counts, "grams"), few=few)
    bits = found.select("block", "model", "g").join(p, ["model", "g"]).select("block", "model", "g", *((-F.log2(f"p_{c}")).alias(f"b_{c}") for c in _COUNTS))
    rows = stage(_scored(texts, bits, whole), "scores")

    some, size = F.col("n_chars") > 0, F.col("n_chars") + 1
    rate = lambda c: (F.col(c) + PRIOR * F.col("mean")) / (size + PRIOR)
    known = rows.where(some & F.col("held").isNotNull())
    means = known.groupBy("model").agg((F.sum("held") / F.sum(size)).alias("mean"))
    means = F.broadcast(stage(means, "means")) if few else means
    limits = known.join(means, "model").groupBy("model").agg(F.percentile_approx(rate("held"), Q, 10_000).alias("limit"))
    rows = rows.join(means, "model", "left").join(F.broadcast(limits) if few else limits, "model", "left")
    kept = some & F.coalesce(rate("bits") <= F.col("limit"), F.lit(True))
    power = lambda x: F.pow(F.lit(2.0), x)
    rows = rows.select(F.col("row.own").alias("row"), F.col("row.lang").alias("lang"), "n_chars", F.when(some, power(F.col("bits") / size)).alias("perplexity"), F.when(some, power(rate("bits"))).alias("shrunk"), power(F.col("limit")).alias("threshold"), kept.alias("kept"), *also)
    return rows.withColumn("lang", lang)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, shrunk, threshold, kept) for each row of docs.

    perplexity is per character, the text's end counted as one. shrunk is that
    of the text and PRIOR symbols at its language's mean, which must not be
    above the threshold of the document's model. A null or empty text has no perplexity and is
    rejected. Null languages and those with little trusted text use the model
    of all languages. Repeated trusted texts count once. A model whose trusted documents are all in one part has
    no threshold, and its documents are kept. Without any trusted text nothing
    is known, and all texts with a character are kept. Repeated rows are scored
    alike. An empty table gives no rows. docs is read twice and must have the
    same rows in the same partitions then, as tables do; else a task fails.
    """
    found = judged(docs, labels, "doc_id")
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "lang", "n_chars", "perplexity", "shrunk", "threshold", "kept")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns; the verdict comes with each row. None of them has a null text."""
    return judged(docs, labels).where("kept").select(*(F.nullif(F.col("text"), F.lit("")).cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
