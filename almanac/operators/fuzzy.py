"""An extension: events whose names are spelled differently, by a similarity join of q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, js_trim
from .keyed import staged

Q = 3
#: Grams are counted by so many bins of their hashes; the table of counts is broadcast.
BINS = 1 << 16
#: A gram with more names than this in its block is split; so at most one gram for each so many rows is broadcast.
GRAM_ROWS = 100_000
#: In a block of up to so many names each meets each; names of larger blocks meet by their rare grams.
BLOCK_NAMES = 256


def plain_name(name: Column) -> Column:
    """The name in lower case with single spaces; null where nothing is left."""
    return F.nullif(js_trim(F.regexp_replace(F.lower(name), f"[{WS}]+", " ")), F.lit(""))


def digits(name: Column) -> Column:
    """The name's runs of digits, with a space for what is between them."""
    return F.regexp_replace(name, "[^0-9]+", " ")


def grams(name: Column, q: int = Q) -> Column:
    """The different runs of q characters of the name with q - 1 marks at either end."""
    marked = F.concat(F.lit("#" * (q - 1)), name, F.lit("#" * (q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - q + 1), lambda i: F.substring(marked, i, F.lit(q))))


def _check(percent: int) -> None:
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")


def _by_rarity(names: DataFrame, by: list[str]) -> DataFrame:
    """names with _grams, rare ones first: by how often their bin occurs, then by themselves, which is one order for all names."""
    each = names.withColumn("_gram", F.explode(grams(F.col("_name")))).withColumn("_bin", F.pmod(F.xxhash64("_gram"), F.lit(BINS)))
    often = F.broadcast(each.groupBy("_bin").agg(F.count(F.lit(1)).alias("_often")))  # at most BINS rows
    own = each.join(often, "_bin").groupBy(*by, "_name", "_n").agg(F.array_sort(F.collect_list(F.struct("_often", "_gram"))).alias("_g"))
    return own.select(*by, "_name", "_n", F.col("_g._gram").alias("_grams"))


def similar_names(rows: DataFrame, by: list[str], name: str = "name", percent: int = 70) -> DataFrame:
    """(by, a, b, shared, grams_a, grams_b): the pairs a < b of different plain names of a block whose grams' Jaccard similarity reaches percent.

    A block is the rows that agree in the columns `by` and in the name's numbers:
    day 1 and day 2 are different events however alike their names. In a block of
    up to BLOCK_NAMES names, all pairs are looked at. In larger ones, of two names
    that are similar enough, the rare ends of their gram lists share a gram
    (prefix filter), so names meet by such grams and no others; a pair is looked at once, by
    the first gram that both ends share. No pair is lost. Grams that many names
    of a block have at their rare end are split over tasks. Rows with a null in
    `by` or without a name find nothing; rows of the same plain name are one name.
    """
    _check(percent)
    names = rows.select(*(F.col(f"`{c}`") for c in by), plain_name(F.col(f"`{name}`")).alias("_name")).dropna().distinct().withColumn("_n", F.lit(1).cast("long"))
    block = [*by, "_digits"]
    each, large = _blocks(names, by)
    pairs = _all_pairs(each, block, percent)
    if large is not None:
        pairs = pairs.unionByName(_by_rare_grams(large, block, percent))
    pairs = pairs.where(_similar(F.col("shared"), F.col("a_size"), F.col("b_size"), percent))
    return pairs.select(*by, "a", "b", "shared", F.col("a_size").alias("grams_a"), F.col("b_size").alias("grams_b"))


def _blocks(names: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Of names (by, _name, _n), each once: those of blocks of up to BLOCK_NAMES, a row (block, _all, x) for each name x and all of its block, and those of larger ones, if any."""
    block = [*by, "_digits"]
    names = staged(names.withColumn("_digits", digits(F.col("_name"))), "names")
    sizes = names.groupBy(block).agg(F.count(F.lit(1)).alias("_block"))
    large = staged(sizes.where(F.col("_block") > BLOCK_NAMES).select(block), "blocks")
    some = bool(large.limit(1).count())
    small = names.join(large, block, "left_anti") if some else names
    # Names go to their block as they are, in one shuffle; lists are made behind it.
    lists = small.repartition(*block).groupBy(block).agg(F.collect_list(F.struct("_name", "_n")).alias("_names")).where(F.size("_names") > 1)
    full = lambda x: F.struct(x["_name"].alias("name"), x["_n"].alias("n"), grams(x["_name"]).alias("g"))
    # explode() would look whether there is anything to explode, and make the lists twice for that.
    each = lists.select(*block, F.transform("_names", full).alias("_all")).select(*block, "_all", F.explode_outer("_all").alias("x"))
    return each, names.join(large, block, "left_semi") if some else None


def _similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


def _shared(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x["g"], y["g"]))


def _sizes_near(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _all_pairs(each: DataFrame, block: list[str], percent: int) -> DataFrame:
    """(block, a, b, a_n, b_n, a_size, b_size, shared) of all pairs of a block that may be similar by their sizes."""
    near = lambda y: (y["name"] > F.col("x.name")) & _sizes_near(F.size(y["g"]), F.size("x.g"), percent)
    pairs = each.select(*block, "x", F.explode_outer(F.filter("_all", near)).alias("y")).where("y IS NOT NULL")
    named = [F.col(f"{c}.{f}").alias(f"{p}{n}") for c, p in (("x", "a"), ("y", "b")) for f, n in (("name", ""), ("n", "_n"))]
    return pairs.select(*block, *named, F.size("x.g").alias("a_size"), F.size("y.g").alias("b_size"), _shared(F.col("x"), F.col("y")).alias("shared"))


def _best_in_block(each: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(by, _plain, _better) of the names that have a better spelling; each looks through its block's list, so no row is made for a pair."""
    x = F.col("x")
    better = lambda y: (_order(y["n"], y["name"]) < _order(x["n"], x["name"])) & _sizes_near(F.size(y["g"]), F.size(x["g"]), percent) & _similar(_shared(x, y), F.size(x["g"]), F.size(y["g"]), percent)
    found = F.slice(F.array_sort(F.transform(F.filter("_all", better), lambda y: _order(y["n"], y["name"]))), 1, 1)
    return each.select(*by, F.col("x.name").alias("_plain"), F.explode_outer(found).alias("_o")).where("_o IS NOT NULL").select(*by, "_plain", F.col("_o.spelling").alias("_better"))


def _order(n: Column, name: Column) -> Column:
    """The less, the better: names that more rows have, then the first."""
    return F.struct((-n).alias("n"), name.alias("spelling"))


def _by_rare_grams(names: DataFrame, block: list[str], percent: int) -> DataFrame:
    """What _all_pairs() gives, but for pairs that share no gram at the rare ends of their lists; those aren't similar."""
    ends = lambda x: F.slice(x, F.lit(1), F.size(x) - F.floor((F.size(x) * percent + 99) / 100).cast("int") + 1)
    # The whole lists stay behind: a pair that passes makes them again.
    rare = staged(_by_rarity(names, block).select(*block, "_name", "_n", ends(F.col("_grams")).alias("_ends"), F.size("_grams").alias("_size")), "grams")
    rare = rare.withColumn("_gram", F.explode("_ends"))
    meet = [*block, "_gram"]
    hot = F.broadcast(rare.groupBy(meet).agg(F.ceil(F.count(F.lit(1)) / GRAM_ROWS).alias("_parts")).where("_parts > 1"))
    marked = rare.join(hot, meet, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))
    side = lambda df, p: df.select(*meet, "_part", F.col("_name").alias(p), *(F.col(c).alias(f"{p}{c}") for c in ("_n", "_ends", "_size")))
    one = side(marked.withColumn("_part", F.pmod(F.xxhash64("_name"), F.col("_parts"))), "a")
    two = side(marked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))), "b")
    pairs = one.join(two, [*meet, "_part"]).where(F.col("a") < F.col("b"))
    pairs = pairs.where(_sizes_near(F.col("a_size"), F.col("b_size"), percent))
    pairs = pairs.where(F.get(F.array_intersect("a_ends", "b_ends"), F.lit(0)) == F.col("_gram"))
    shared = F.size(F.array_intersect(grams(F.col("a")), grams(F.col("b"))))
    return pairs.select(*block, "a", "a_n", "b", "b_n", "a_size", "b_size", shared.alias("shared"))


def with_spelling(rows: DataFrame, by: list[str], name: str = "name", percent: int = 70) -> DataFrame:
    """rows with spelling: of its plain name and those similar to it in its block, the one that most rows have, then the first.

    A name without an equal or better one keeps its own; rows without a name or with
    a null in `by` get their plain name as it is.
    """
    _check(percent)
    keyed = rows.withColumn("_plain", plain_name(F.col(f"`{name}`")))
    counts = keyed.groupBy(*by, F.col("_plain").alias("_name")).agg(F.count(F.lit(1)).alias("_n")).dropna()
    each, large = _blocks(counts, by)
    own = _best_in_block(each, by, percent)
    if large is not None:
        pairs = _by_rare_grams(large, [*by, "_digits"], percent).where(_similar(F.col("shared"), F.col("a_size"), F.col("b_size"), percent))
        # Of a pair, one is the better spelling for the other.
        one, two = (_order(F.col(f"{c}_n"), F.col(c)) for c in ("a", "b"))
        worse = pairs.select(*by, F.when(one < two, F.col("b")).otherwise(F.col("a")).alias("_plain"), F.least(one, two).alias("_o"))
        own = own.unionByName(worse.groupBy(*by, "_plain").agg(F.min("_o").alias("_o")).select(*by, "_plain", F.col("_o.spelling").alias("_better")))
    # The names that have a better one grow with the rows, so they meet them by a merge join, not through the driver.
    return keyed.join(own.hint("merge"), [*by, "_plain"], "left").withColumn("spelling", F.coalesce("_better", "_plain")).select(*(F.col(f"`{c}`") for c in rows.columns), "spelling")
