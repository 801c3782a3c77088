"""A library of ordered collections: flattening, identity, naming, union and filters.

Order is data: collections carry `ord`, members `pos`, and no operator relies on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinata.functions import text as tx
from ostinata.sources.storage import Scratch

LIKED = "Liked Songs (from Spotify)"


def flatten(playlists: DataFrame, *keys: str, tracks: str = "tracks") -> DataFrame:
    """One row for each member: the keys, pos from 0, and the member's fields."""
    return playlists.select(*keys, F.posexplode(tracks).alias("pos", "track")).select(*keys, "pos", "track.*")


def in_order(position: str, value: Column | str) -> Column:
    """Aggregate: the values as an array by position; values may be of any type, maps included."""
    pairs = F.collect_list(F.struct(F.col(position).alias("p"), (F.col(value) if isinstance(value, str) else value).alias("v")))
    # positions are sorted by their own order, with the places that they come from: far cheaper than by a comparison in SQL
    places = F.sort_array(F.transform(pairs, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"))))
    return F.transform(places, lambda x: F.get(pairs, x["i"])["v"])


def with_key(tracks: DataFrame, isrc: str = "isrc", title: str = "title", artists: str = "artists") -> DataFrame:
    return tracks.withColumn("key", tx.match_key(isrc, title, artists))


#: Rows that a task sorts or groups at a time, about.
ROWS_A_TASK = 250_000


def parts_of(spark: SparkSession, n: int) -> int | None:
    """Parts that n rows take so that each has about ROWS_A_TASK; None where the session's cores are as many or more."""
    parts = -(-n // ROWS_A_TASK)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows, n about, by keys in so many parts that a task's memory stays the same whatever n; few rows are left as they are.

    Spark's own number of parts is fixed, and small ones are put together until there is one for each core.
    """
    parts = parts_of(rows.sparkSession, n)
    return rows if parts is None else rows.repartition(parts, *keys)


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unique_tracks(members: DataFrame, key: str = "key", order: tuple[str, ...] = ("ord", "pos")) -> DataFrame:
    """The first occurrence of each key over all collections, in order."""
    return first_by(members, [key], list(order)).orderBy(*order)


def with_ids(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Dense ids from 1 in the given total order, without moving all rows to one task: each range is numbered by itself and shifted by the counts before it.

    The ranges are written with their numbers, so that counts and rows can't be of different ranges.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    kept = Scratch(rows.sparkSession).keep(ranged)
    counts = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    shifts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = W.partitionBy("_p").orderBy(*order)
    numbered = kept.withColumn("_rn", F.row_number().over(inner)).join(F.broadcast(shifts), "_p")  # no more rows than shuffle partitions
    return numbered.withColumn(name, F.col("_before") + F.col("_rn")).drop("_p", "_rn", "_before")


def unique_names(playlists: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Distinct display names: blank ones become "Untitled Playlist", repeats get " (2)", " (3)" ... in order."""
    base = F.coalesce(F.nullif(tx.strip(name), F.lit("")), F.lit("Untitled Playlist"))
    w = W.partitionBy("_base").orderBy(order)
    n = playlists.withColumn("_base", base).withColumn("_k", F.row_number().over(w))
    return n.withColumn(name, F.when(F.col("_k") > 1, F.concat("_base", F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))).otherwise(F.col("_base"))).drop("_base", "_k")


def pull(playlists: DataFrame, items: DataFrame, liked: DataFrame, user: str, owned_only: bool = False) -> DataFrame:
    """A library snapshot from paged sources: own and followed collections, then liked songs as one more.

    playlists(id, name, description, owner_id, ord); items(playlist_id, pos, type, track), liked(pos, type, track):
    items without a track or of another type than 'track' are dropped, an empty type is a track.
    """
    kept = F.expr("track IS NOT NULL AND coalesce(type, '') IN ('', 'track')")
    p = playlists.where(F.col("owner_id") == user) if owned_only else playlists
    lists = items.where(kept).groupBy(F.col("playlist_id").alias("id")).agg(in_order("pos", "track").alias("tracks"))
    own = p.join(lists, "id", "left").select("ord", "name", "description", F.when(F.col("owner_id") == user, F.lit("owned")).otherwise(F.lit("followed")).alias("kind"), "owner_id", F.col("id").alias("source_id"), F.coalesce("tracks", F.array().cast(dict(lists.dtypes)["tracks"])).alias("tracks"))
    songs = liked.where(kept).agg(in_order("pos", "track").alias("tracks")).where("size(tracks) > 0")
    last = songs.select(F.lit((1 << 62)).alias("ord"), F.lit(LIKED).alias("name"), F.lit(None).cast("string").alias("description"), F.lit("liked_songs").alias("kind"), F.lit(user).alias("owner_id"), F.lit(None).cast("string").alias("source_id"), "tracks")
    return own.unionByName(last)


def within_missing(playlists: DataFrame, members: DataFrame, resolved: DataFrame, limit: int, playlist: str = "ord") -> DataFrame:
    """Collections with at most limit unresolved members (limit < 0: all); empty ones pass. members(playlist, key), resolved(key, target_id)."""
    if limit < 0:
        return playlists
    missing = members.join(resolved.select("key", "target_id"), "key", "left").groupBy(playlist).agg(F.count_if(F.coalesce("target_id", F.lit("")) == "").alias("_missing"))
    return playlists.join(missing, playlist, "left").where(F.coalesce("_missing", F.lit(0)) <= limit).drop("_missing")
