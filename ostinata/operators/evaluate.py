"""How good a collection is: holdout recall, rankings, adjacency, concentration, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def holdout_recall(members: DataFrame, tracks: DataFrame, k: int = 5) -> DataFrame:
    """basket, held, hits, recall: the last k members of each basket, sought among all items by an artist of the rest.

    members(basket, position, item), tracks(item, artist). A basket without held members has recall 0; with k members or
    fewer nothing is left as a seed.
    """
    w = W.partitionBy("basket").orderBy(F.desc("position"))
    m = members.withColumn("_last", F.row_number().over(w) <= k).join(tracks, "item")
    held = m.where("_last").select("basket", "item", "artist").distinct()
    seed = m.where("NOT _last").select("basket", "artist").distinct()
    hit = held.join(seed.withColumn("_hit", F.lit(1)), ["basket", "artist"], "left")
    per = hit.groupBy("basket").agg(F.count_distinct("item").alias("held"), F.count_distinct(F.when(F.col("_hit") == 1, F.col("item"))).alias("hits"))
    all_ = members.select("basket").distinct().join(per, "basket", "left")
    held_, hits = F.coalesce("held", F.lit(0)), F.coalesce("hits", F.lit(0))
    return all_.select("basket", held_.alias("held"), hits.alias("hits"), F.coalesce(hits / F.nullif(held_, F.lit(0)), F.lit(0.0)).alias("recall"))


def adjacent_repeats(members: DataFrame, basket: str, position: str, artist: str) -> DataFrame:
    """basket, repeats: neighbours in order with the same artist."""
    w = W.partitionBy(basket).orderBy(position)
    return members.withColumn("_same", F.coalesce((F.col(artist) == F.lag(artist).over(w)).cast("int"), F.lit(0))).groupBy(basket).agg(F.sum("_same").alias("repeats"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """basket, hit_rate, precision, recall, average_precision, ndcg at k, and clicks (blocks of 10 gone through, 51 if none helps).

    ranked(basket, rank, item) with ranks from 1, relevant(basket, item).
    """
    rel = relevant.select("basket", "item").distinct()
    total = rel.groupBy("basket").agg(F.count("*").alias("n"))
    got = ranked.join(rel.withColumn("_rel", F.lit(1)), ["basket", "item"], "left").withColumn("_rel", F.coalesce("_rel", F.lit(0)))
    w = W.partitionBy("basket").orderBy("rank")
    got = got.withColumn("_so_far", F.sum("_rel").over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = F.col("rank") <= k
    per = got.groupBy("basket").agg(
        F.sum(F.when(at, F.col("_rel")).otherwise(0)).alias("hits"),
        F.sum(F.when(at & (F.col("_rel") == 1), F.col("_so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(at & (F.col("_rel") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"),
    )
    j = total.join(per, "basket", "left")
    best = F.least("n", F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), best.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    hits = F.coalesce("hits", F.lit(0))
    return j.select(
        "basket", (hits > 0).cast("int").alias("hit_rate"), (hits / k).alias("precision"), (hits / F.col("n")).alias("recall"),
        (F.coalesce("ap", F.lit(0.0)) / best).alias("average_precision"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(F.floor((F.col("first") - 1) / 10), F.lit(51)).cast("bigint").alias("clicks"),
    )


def r_precision(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """basket, r_precision: the share of relevant items among as many of the ranking's first as there are relevant ones."""
    rel = relevant.select("basket", "item").distinct()
    total = rel.groupBy("basket").agg(F.count("*").alias("n"))
    hits = ranked.join(rel, ["basket", "item"], "left_semi").join(total, "basket").where("rank <= n").groupBy("basket").agg(F.count_distinct("item").alias("hits"))
    return total.join(hits, "basket", "left").select("basket", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r_precision"))


def diversity(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """basket, diversity: the mean cosine distance of all pairs of members, without forming pairs.

    For unit vectors the sum of all pairwise cosines is (|sum|^2 - n) / 2. members(basket, item), vectors(item, v).
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("_n", norm).where("_n > 0").select("item", F.posexplode(F.transform("v", lambda x: x.cast("double") / F.col("_n"))).alias("i", "x"))
    sums = members.join(unit, "item").groupBy("basket", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy("basket").agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n")).where("n > 1")
    return total.select("basket", (1 - (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("diversity"))


def concentration(members: DataFrame, basket: str, artist: str, item: str) -> DataFrame:
    """basket, top_share of its most frequent artist, duplicate_rate of its items."""
    per = members.groupBy(basket, artist).agg(F.count("*").alias("c"))
    share = per.groupBy(basket).agg(F.max("c").alias("top"), F.sum("c").alias("n"))
    distinct = members.groupBy(basket).agg(F.count_distinct(item).alias("d"))
    return share.join(distinct, basket).select(basket, (F.col("top") / F.col("n")).alias("top_share"), (1 - F.col("d") / F.col("n")).alias("duplicate_rate"))


def tempo_steps(members: DataFrame, basket: str, position: str, bpm: str, within: float = 5.0) -> DataFrame:
    """basket, steps, smooth: neighbours whose tempo differs by at most `within`, also at half or double time."""
    w = W.partitionBy(basket).orderBy(position)
    b, a = F.col(bpm), F.lag(bpm).over(w)
    near = (F.abs(b - a) <= within) | (F.abs(b - 2 * a) <= within) | (F.abs(2 * b - a) <= within)
    m = members.withColumn("_step", ((a > 0) & (b > 0)).cast("int")).withColumn("_near", F.when((a > 0) & (b > 0), near.cast("int")))
    return m.groupBy(basket).agg(F.coalesce(F.sum("_step"), F.lit(0)).alias("steps"), F.coalesce(F.sum("_near"), F.lit(0)).alias("smooth"))


def camelot(key: Column, mode: Column) -> Column:
    """The place of a key on the wheel of fifths: 1 to 12 and A (minor) or B (major). key: pitch class from 0 (C), mode: 1 major, 0 minor; others have none."""
    major = F.pmod(key * 7 + 7, F.lit(12)) + 1
    minor = F.pmod(key * 7 + 4, F.lit(12)) + 1
    fine = key.between(0, 11) & mode.isin(0, 1)
    return F.when(fine, F.concat(F.when(mode == 1, major).otherwise(minor).cast("int").cast("string"), F.when(mode == 1, F.lit("B")).otherwise(F.lit("A"))))


def camelot_steps(members: DataFrame, basket: str, position: str, code: str) -> DataFrame:
    """basket, steps, smooth: neighbours of known key; smooth are the same key, one step of the wheel, the relative key or two steps up."""
    w = W.partitionBy(basket).orderBy(position)
    b, a = F.col(code), F.lag(code).over(w)
    number = lambda c: F.regexp_extract(c, r"^(\d+)", 1).cast("int")
    up = F.pmod(number(b) - number(a), F.lit(12))
    same = F.right(a, F.lit(1)) == F.right(b, F.lit(1))
    near = F.when(same, up.isin(0, 1, 2, 11)).otherwise(up == 0)
    known = a.isNotNull() & b.isNotNull()
    m = members.withColumn("_step", known.cast("int")).withColumn("_near", F.when(known, near.cast("int")))
    return m.groupBy(basket).agg(F.coalesce(F.sum("_step"), F.lit(0)).alias("steps"), F.coalesce(F.sum("_near"), F.lit(0)).alias("smooth"))


def arc_target(place: Column, size: Column) -> Column:
    """A gentle rise to 1 at two thirds of a list and a release to 0.5: the energy wanted at a place from 1."""
    x = (place - 1) / F.greatest(size - 1, F.lit(1))
    return F.when(x <= 2 / 3, 0.3 + 0.7 * x / (2 / 3)).otherwise(1.0 - 0.5 * (x - 2 / 3) / (1 / 3))


def energy_arc(members: DataFrame, basket: str, position: str, energy: str) -> DataFrame:
    """basket, jump, off: the mean energy step between neighbours and the mean distance from the arc; members without energy are left out."""
    order = W.partitionBy(basket).orderBy(position)
    known = members.where(F.col(energy).isNotNull())
    m = known.withColumn("_place", F.row_number().over(order)).withColumn("_size", F.count("*").over(W.partitionBy(basket))).withColumn("_jump", F.abs(F.col(energy) - F.lag(energy).over(order)))
    off = F.abs(F.col(energy) - arc_target(F.col("_place"), F.col("_size")))
    return m.groupBy(basket).agg(F.avg("_jump").alias("jump"), F.avg(off).alias("off"))


def item_vectors(members: DataFrame, size: int = 32, window: int = 10, min_count: int = 1, seed: int = 1):
    """Word2vec over baskets as sentences of items in order; returns the fitted model."""
    from pyspark.ml.feature import Word2Vec

    lists = members.groupBy("basket").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("item").cast("string").alias("item")))), lambda x: x["item"]).alias("items"))
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="items", outputCol="vector").fit(lists)
