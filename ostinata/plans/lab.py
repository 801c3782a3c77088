"""The analysis schema (five tables) over a library, and its parameterised SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.functions import text as tx
from ostinata.operators import affinity
from ostinata.operators.library import flatten, spread, with_ids
from ostinata.sources.storage import Scratch

CAP = affinity.MAX_BASKET


def tables(library: DataFrame, cap: int = CAP) -> dict[str, DataFrame]:
    """playlists, tracks, playlist_tracks, track_cooccurrence, artist_cooccurrence of a library(ord, slug, name, tracks).

    The library is written once and read by each table. Keys are made for each spelling of title and artist, and members meet
    their tracks by it.
    """
    scratch = Scratch(library.sparkSession)
    kept = scratch.keep(library.select("ord", "slug", "name", F.size("tracks").alias("track_count"), "tracks"))
    playlists = kept.select((F.col("ord") + 1).cast("bigint").alias("id"), "slug", "name", "track_count", (F.col("track_count") <= cap).cast("int").alias("cooccurrence_included"))
    m = flatten(kept, "ord", "track_count").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("artist", F.coalesce("artist", F.lit("")))
    spelt = ["title", "artist"]
    spellings = scratch.keep(m.groupBy(*spelt).agg(F.min("ord").alias("ord"), F.count("*").alias("n")).withColumn("key", tx.lab_key("title", "artist")))
    n = spellings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the first member of each spelling, then of each key
    firsts = m.join(spellings.select("ord", *spelt, "key"), ["ord", *spelt]).groupBy("key", *spelt).agg(F.min_by(F.struct("album", "isrc", F.try_element_at("ids", F.lit("appleMusic")).alias("apple_id"), "ord", "pos"), F.struct("ord", "pos")).alias("t"))
    first = firsts.groupBy("key").agg(F.min_by(F.struct(*spelt, "t"), F.struct("t.ord", "t.pos")).alias("f"))
    tracks = with_ids(first.select("key", *[f"f.{c}" for c in spelt], "f.t.*"), ["ord", "pos"]).select("id", "key", "title", "artist", "album", "isrc", "apple_id")
    spelt_ids = scratch.keep(spellings.select(*spelt, "key").join(tracks.select(F.col("id").alias("track_id"), "key"), "key").withColumn("artist_key", F.substring_index("key", "|", -1)).select(*spelt, "track_id", "artist_key"))
    members = m.join(spelt_ids, spelt).select((F.col("ord") + 1).cast("bigint").alias("playlist_id"), "track_id", F.col("pos").alias("position"), "artist", "artist_key", "track_count")
    included = spread(members.where(F.col("track_count") <= cap), n, "playlist_id")
    track_pairs = affinity.cooccurrence(included, "playlist_id", "track_id", None).toDF("track_a", "track_b", "weight")
    # artists pair under their raw spelling, where it has anything to normalise
    artist_pairs = affinity.cooccurrence(included.where("artist_key <> ''"), "playlist_id", "artist", None).toDF("artist_a", "artist_b", "weight")
    return {"playlists": playlists, "tracks": tracks, "playlist_tracks": members.select("playlist_id", "track_id", "position"), "track_cooccurrence": track_pairs, "artist_cooccurrence": artist_pairs}


def open_lab(library: DataFrame, cap: int = CAP) -> dict[str, DataFrame]:
    """The same, registered as temporary views."""
    found = tables(library, cap)
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def q(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL over the views with named parameters (:name)."""
    return spark.sql(sql, args=params)


OVERVIEW = "SELECT (SELECT count(*) FROM playlists) AS playlists, (SELECT count(*) FROM tracks) AS unique_tracks, (SELECT count(*) FROM playlist_tracks) AS memberships"
TOP_ARTISTS = "SELECT artist, count(*) AS tracks FROM tracks GROUP BY artist ORDER BY tracks DESC, artist LIMIT 20"
CONNECTORS = "SELECT t.id, t.title, t.artist, count(DISTINCT m.playlist_id) AS in_playlists FROM tracks t JOIN playlist_tracks m ON m.track_id = t.id GROUP BY t.id, t.title, t.artist ORDER BY in_playlists DESC, t.title, t.id LIMIT 15"
TOP_PAIRS = "SELECT artist_a, artist_b, weight FROM artist_cooccurrence ORDER BY weight DESC, artist_a, artist_b LIMIT 20"
NEIGHBOURS = "SELECT CASE WHEN artist_a = :a THEN artist_b ELSE artist_a END AS artist, weight FROM artist_cooccurrence WHERE artist_a = :a OR artist_b = :a ORDER BY weight DESC, artist LIMIT :k"

LIST_TRACKS = "SELECT m.position, t.title, t.artist FROM tracks t JOIN playlist_tracks m ON m.track_id = t.id JOIN playlists p ON p.id = m.playlist_id WHERE p.slug = :slug ORDER BY m.position LIMIT :n"
COUNTS = "SELECT (SELECT count(*) FROM playlists) AS playlists, (SELECT count(*) FROM tracks) AS tracks, (SELECT count(*) FROM playlist_tracks) AS memberships, (SELECT count(*) FROM track_cooccurrence) AS track_pairs, (SELECT count(*) FROM artist_cooccurrence) AS artist_pairs"


def artist_pmi(found: dict[str, DataFrame], min_weight: int = 2) -> DataFrame:
    members = found["playlist_tracks"].join(found["tracks"].select(F.col("id").alias("track_id"), "artist"), "track_id")
    pairs = found["artist_cooccurrence"].toDF("a", "b", "weight")
    return affinity.pmi(pairs, affinity.baskets_per_member(members, "playlist_id", "artist"), found["playlists"].agg(F.count("*").alias("n")), min_weight)
