"""An extension: full-text search by an inverted index with positions, ranked by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .keyed import staged

K1, B = 1.2, 0.75
#: Shards of a new index: a term's postings are in one, in as many files as their size asks for.
SHARDS = 64
#: Terms of all queries that are broadcast to the postings; more meet them by a shuffle.
BROADCAST_TERMS = 200_000
_POSTINGS = "term string, id string, length int, places array<int>, shard int"


def words(text: Column) -> Column:
    """The runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(words: Column) -> Column:
    """(term, places) of each different word of a text, by one sort of its words; null for a text without words."""
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
        long = lambda b, i, nth: F.coalesce(F.get(b, nth + 1), F.size(s)) - i
        run = lambda b, i, nth: F.transform(F.slice(s, i + 1, long(b, i, nth)), lambda x: x["place"])
        return bind(begins, lambda b: F.transform(b, lambda i, nth: F.struct(F.get(s, i)["term"].alias("term"), run(b, i, nth).alias("places"))))

    return F.when(F.size(words) > 0, bind(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("place")))), runs))


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


class SearchIndex:
    """The index under path:

    postings/shard=7/…   term, id, length of the text in words, places of the term in it; sorted by term
    terms/               term, number of texts that have it
    texts/               one row: number of texts, of words, of shards
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, texts: DataFrame, shards: int = SHARDS) -> SearchIndex:
        """Index texts (id, text), of which each id should occur once. Null and empty texts count as texts without words; extra columns go.

        A text's postings are made in its row, so they meet nothing before they are
        dealt. A shard is dealt to tasks by size (rebalanced), so a word that a
        third of the texts have is written by several.
        """
        rows = texts.select(F.col("id").cast("string").alias("id"), words(F.col("text")).alias("_words"))
        rows.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.size("_words")), F.lit(0)).alias("words"), F.lit(shards).alias("shards")).write.mode("overwrite").parquet(f"{self.path}/texts")
        each = rows.select("id", F.size("_words").alias("length"), F.explode(postings(F.col("_words"))).alias("_p")).select("_p.term", "id", "length", "_p.places", _shard(F.col("_p.term"), shards).alias("shard"))
        dealt = each.hint("rebalance", "shard").sortWithinPartitions("shard", "term", "id")
        dealt.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").partitionBy("shard").parquet(f"{self.path}/postings")
        self._postings().groupBy("term").agg(F.count(F.lit(1)).alias("texts")).write.mode("overwrite").parquet(f"{self.path}/terms")
        return self

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    def _asked(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms (term, each once), from the shards that they fall in; a text's are in one task."""
        shards = self.spark.read.parquet(f"{self.path}/texts").first()["shards"]
        touched = [r["s"] for r in terms.select(_shard(F.col("term"), shards).alias("s")).distinct().collect()]  # at most one for each shard
        terms = F.broadcast(terms) if _few(terms) else terms
        return self._postings().where(F.col("shard").isin(touched)).drop("shard").join(terms, "term", "left_semi").repartition("id")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query, rank, id, score): the k best texts of each query (query, text), by BM25 over its different words, then id.

        A word's weight and its share of a text's score are whole millionths, so
        sums are exact in any order. Texts that are as long and have the same of all
        queries' words as often score alike, so of such texts only the k first ids
        are scored: no others can be among the k best. Texts without a word of the
        query aren't found.
        """
        facts = self.spark.read.parquet(f"{self.path}/texts").first()
        n, mean = float(facts["texts"]), max(facts["words"], 1) / max(facts["texts"], 1)
        asks = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
        known = asks.join(self.spark.read.parquet(f"{self.path}/terms"), "term")
        df = F.col("texts").cast("double")
        known = staged(known.select("query", "term", F.floor(F.log(1.0 + (n - df + 0.5) / (df + 0.5)) * 1e6).cast("double").alias("weight")), "asks")
        found = self._asked(known.select("term").distinct()).groupBy("id", "length").agg(F.sort_array(F.collect_list(F.struct("term", F.size("places").alias("tf")))).alias("_found"))
        alike = W.partitionBy("length", "_found").orderBy("id")
        texts = found.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= k).select("id", "length", F.explode("_found").alias("_f")).select("id", "length", "_f.term", F.col("_f.tf").cast("double").alias("tf"))
        part = F.floor(F.col("weight") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean)))
        scores = texts.join(F.broadcast(known) if _few(known) else known, "term").groupBy("query", "id").agg(F.sum(part).alias("score"))
        best = W.partitionBy("query").orderBy(F.desc("score"), "id")
        return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "id", "score")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """(query, id, times): how often each text has the words of a query (query, text) one after the other; texts without it aren't returned.

        The asked words of a text meet in one row, and a query meets the texts that
        have its rarest word, so a word costs a text one row however many queries
        have it.
        """
        asks = queries.select("query", words(F.col("text")).alias("_w")).where(F.size("_w") > 0).distinct()
        each = asks.select("query", "_w", F.explode(F.array_distinct("_w")).alias("term")).join(self.spark.read.parquet(f"{self.path}/terms"), "term")
        rare = each.groupBy("query", "_w").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("texts", "term")).alias("_r")).where(F.col("_n") == F.size(F.array_distinct("_w")))
        rare = staged(rare.select("query", "_w", F.col("_r.term").alias("_rare")), "asks")
        found = self._asked(rare.select(F.explode("_w").alias("term")).distinct()).groupBy("id").agg(F.collect_list(F.struct("term", "places")).alias("_found"))
        met = found.select("id", "_found", F.explode(F.array_distinct("_found.term")).alias("_rare")).join(F.broadcast(rare) if _few(rare) else rare, "_rare")
        met = met.where(F.size(F.array_except("_w", "_found.term")) == 0)
        begins = lambda w, nth: F.transform(F.flatten(F.transform(F.filter("_found", lambda f: f["term"] == w), lambda f: f["places"])), lambda p: p - nth)
        whole = F.aggregate(F.sequence(F.lit(1), F.size("_w")), begins(F.get("_w", F.lit(0)), F.lit(0)), lambda held, i: F.array_intersect(held, begins(F.get("_w", i - 1), i - 1)))
        return met.select("query", "id", F.size(whole).cast("long").alias("times")).where("times > 0")


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
