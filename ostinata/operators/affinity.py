"""Co-occurrence graphs of items that share baskets.

All operators read one relation, memberships(basket, position, item, title, group) under column names
that are parameters. Pairs are formed within a basket after it has been cut down to distinct members, and
after the size cap, which is part of the meaning: a basket of n members gives n(n-1)/2 pairs.
Memberships that lie by basket already (library.spread) aren't moved for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BASKET = 250


def within_cap(memberships: DataFrame, basket: str, cap: int = MAX_BASKET) -> DataFrame:
    """Baskets with at most cap rows, all rows counted."""
    sizes = memberships.groupBy(basket).agg(F.count("*").alias("_n")).where(F.col("_n") <= cap).select(basket)
    return memberships.join(sizes, basket, "left_semi")


def cooccurrence(memberships: DataFrame, basket: str, member: str | Column, cap: int | None = MAX_BASKET, parts: int | None = None) -> DataFrame:
    """a < b and weight, the number of baskets that hold both. Absent members pair with none.

    parts: into how many parts pairs are moved before they are counted, where few of them are equal; by default they are counted first where they are formed.
    """
    m = F.col(member) if isinstance(member, str) else member
    kind = memberships.select(m.alias("m")).schema["m"].dataType
    m = F.when(m != "", m) if isinstance(kind, T.StringType) else m
    # collect_set passes over NULLs; both aggregates are of one grouping, so that each task sorts its rows once
    baskets = memberships.where(F.col(basket).isNotNull()).groupBy(basket).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set(m)).alias("s"))
    if cap is not None:
        baskets = baskets.where(F.col("_n") <= cap)
    firsts = baskets.select("s", F.posexplode("s").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    if parts is not None:
        pairs = pairs.repartition(parts, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each pair from both ends: node, other, weight."""
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def neighbours(pairs: DataFrame, seed, breadth: int | None = None, min_weight: int = 1) -> DataFrame:
    """artist, weight of the seed's neighbours, most shared first, ties by name; the seed's edges are read from both ends."""
    own = pairs.where(((F.col("a") == F.lit(seed)) | (F.col("b") == F.lit(seed))) & (F.col("weight") >= min_weight))
    out = own.select(F.when(F.col("a") == F.lit(seed), F.col("b")).otherwise(F.col("a")).alias("artist"), "weight").orderBy(F.desc("weight"), "artist")
    return out if breadth is None else out.limit(breadth)


def top_neighbours(pairs: DataFrame, breadth: int, min_weight: int = 1) -> DataFrame:
    """node, rank, other, weight of every node's strongest neighbours."""
    w = W.partitionBy("node").orderBy(F.desc("weight"), "other")
    return symmetric(pairs.where(F.col("weight") >= min_weight)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= breadth)


def baskets_per_member(memberships: DataFrame, basket: str, member: str) -> DataFrame:
    return memberships.groupBy(F.col(member).alias("member")).agg(F.count_distinct(basket).alias("n"))


def pmi(pairs: DataFrame, per_member: DataFrame, total: DataFrame, min_weight: int = 2) -> DataFrame:
    """a, b, weight, pmi: ln(P(a, b) / (P(a) P(b))). total: one row with the number of all baskets, n; a member without a count has 1."""
    p = pairs.where(F.col("weight") >= min_weight)
    p = p.join(per_member.select(F.col("member").alias("a"), F.col("n").alias("na")), "a", "left").join(per_member.select(F.col("member").alias("b"), F.col("n").alias("nb")), "b", "left")
    p = p.crossJoin(F.broadcast(total.agg(F.max("n").cast("double").alias("all_n"))))  # one row
    pa, pb = F.coalesce("na", F.lit(1)) / F.col("all_n"), F.coalesce("nb", F.lit(1)) / F.col("all_n")
    return p.select("a", "b", "weight", F.log(F.col("weight") / F.col("all_n") / (pa * pb)).alias("pmi"))
