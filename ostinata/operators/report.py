"""Summaries and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinata.functions import text as tx


def match_summary(matches: DataFrame) -> DataFrame:
    """One row: total, matched, counts by confidence, percent matched with one decimal (NULL for none)."""
    n = {c: F.count_if(F.col("confidence") == c) for c in ("exact", "high", "low", "none")}
    matched = n["exact"] + n["high"] + n["low"]
    total = F.count("*")
    return matches.agg(
        total.alias("total"), matched.alias("matched"), n["exact"].alias("exact"), n["high"].alias("high"), n["low"].alias("low"), n["none"].alias("unmatched"),
        F.round(F.lit(100.0) * matched / F.nullif(total, F.lit(0)), 1).alias("percent"),
    )


def unmatched(matches: DataFrame, order: str = "ord", limit: int = 50, width: int = 60) -> DataFrame:
    """The first unmatched tracks, titles cut to width."""
    out = matches.where("coalesce(target_id, '') = ''").orderBy(order).limit(limit)
    return out.withColumn("title", tx.truncate("title", width))


def unmatched_more(matches: DataFrame, limit: int = 50) -> DataFrame:
    """How many more there are."""
    return matches.agg(F.greatest(F.count_if(F.coalesce("target_id", F.lit("")) == "") - limit, F.lit(0)).alias("more"))


def resolved_counts(members: DataFrame, resolved: DataFrame, playlist: str) -> DataFrame:
    """playlist, tracks, resolved, missing; repeated tracks count each time."""
    hit = F.coalesce("target_id", F.lit("")) != ""
    return members.join(resolved.select("key", "target_id"), "key", "left").groupBy(playlist).agg(F.count("*").alias("tracks"), F.count_if(hit).alias("resolved"), F.count_if(~hit).alias("missing"))


def describe(sizes: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles by linear interpolation, max."""
    q = [F.percentile(column, F.lit(p)) for p in (0.25, 0.5, 0.75)]
    return sizes.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(column).alias("most"))


def histogram(sizes: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 1) and n of equal-width bins between the least and the greatest value; the greatest falls into the last."""
    x = F.col(column).cast("double")
    ends = sizes.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    bin_ = F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(F.least(F.width_bucket(x, F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins)))
    return sizes.crossJoin(F.broadcast(ends)).groupBy(bin_.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def top_counts(rows: DataFrame, by: str, limit: int = 20) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(limit)


def connectors(members: DataFrame, keys: list[str], basket: str, limit: int = 15) -> DataFrame:
    """Items by the number of distinct baskets they are in."""
    return members.groupBy(*keys).agg(F.count_distinct(basket).alias("baskets")).orderBy(F.desc("baskets"), *keys).limit(limit)


def track_count(playlists: DataFrame, tracks: str = "tracks") -> DataFrame:
    return playlists.agg(F.coalesce(F.sum(F.greatest(F.size(tracks), F.lit(0)).cast("bigint")), F.lit(0)).alias("tracks"))
