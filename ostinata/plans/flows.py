"""The engine's flows, end to end: match, push, create, import, enrich, curate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata import model
from ostinata.functions import text as tx
from ostinata.operators import curate as cu
from ostinata.operators import library as lb
from ostinata.operators import matching as mt
from ostinata.operators import merge as mg
from ostinata.operators import reconcile as rc
from ostinata.sources.lists import path_exists, read_library
from ostinata.sources.sinks import write_lists
from ostinata.sources.storage import Scratch
from ostinata.sources.tables import ImportSource, TablePort

_MEMBERS = "slug string, pos int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.LIST_TRACK)


def match_library(playlists: DataFrame, port: TablePort, prior: DataFrame | None = None) -> DataFrame:
    """key, ord, title, artists, target_id, confidence, method, note of all unique tracks of a library(ord, name, tracks)."""
    members = lb.with_key(lb.flatten(playlists, "ord").withColumnRenamed("ord", "lo"))
    unique = lb.first_by(members, ["key"], ["lo", "pos"])
    unique = lb.with_ids(unique, ["lo", "pos"], "ord")
    none = unique.sparkSession.createDataFrame([], "key string, target_id string, confidence string, method string, note string")
    done = mt.match_resumed(unique, none if prior is None else prior, port.songs())
    return unique.select("key", "title", "artists").join(done, "key")


def push(playlists: DataFrame, matches: DataFrame, state: DataFrame, port: TablePort, adopt: bool = False, max_missing: int = -1) -> DataFrame:
    """name, action, to_add, ordered: the appends that bring the targets up to the library. Writing them is the caller's (or a dry run's) choice."""
    named = lb.unique_names(playlists)
    members = lb.with_key(lb.flatten(named, "ord", "name"))
    resolved = mt.resolved_index(matches)
    chosen = lb.within_missing(named, members, resolved, max_missing)
    members = members.join(chosen.select("ord"), "ord", "left_semi")
    refs = port.refs().join(port.existing_ids().withColumnRenamed("id", "playlist_id"), "playlist_id").select("name", "title", "artist")
    return rc.push_plan(chosen, members, resolved, state, port.existing(), refs, adopt)


def create(name: str, tracks: DataFrame, state: DataFrame, port: TablePort) -> DataFrame:
    """A hand-written list(pos, title, artists) matched and planned as a collection of its own."""
    if not name:
        raise ValueError("a name is required")
    full = tracks.select("pos", F.struct("title", "artists", F.lit(None).cast("string").alias("album"), F.lit(None).cast("bigint").alias("duration_ms"), F.lit(None).cast("string").alias("isrc"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_uri")).alias("t"))
    one = full.agg(lb.in_order("pos", "t").alias("tracks")).select(F.lit(0).cast("bigint").alias("ord"), F.lit(name).alias("name"), "tracks")
    return push(one, match_library(one, port), state, port)


def import_lists(existing: DataFrame, source: ImportSource) -> DataFrame:
    """slug, pos and track of all lists after an import; existing(slug, pos, columns of model.LIST_TRACK).

    Lists that the source couldn't read to their end (error is set) are merged as far as they were read; lists with one slug merge into one.
    """
    new = source.tracks().join(source.lists().select("list", "ord"), "list").withColumn("slug", tx.slugify("list")).withColumn("key", tx.track_key("title"))
    # positions run over all lists that share a slug, in the order of the source
    new = new.withColumn("pos", F.col("ord") * F.lit(1 << 32) + F.col("pos"))
    return mg.merge_fold(existing.withColumn("key", tx.track_key("title")), new)


def import_counts(source: ImportSource) -> DataFrame:
    """One row: lists, how many of them are incomplete, tracks."""
    tracks = source.tracks().groupBy("list").agg(F.count("*").alias("n"))
    return source.lists().join(tracks, "list", "left").agg(F.count("*").alias("lists"), F.count_if(F.col("error").isNotNull()).alias("incomplete"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"))


def import_into(folder: str, source: ImportSource) -> DataFrame:
    """An import merged into the list files of a folder, whose names become those of the source; returns the counts."""
    spark = source.lists().sparkSession
    there = lists_exist(spark, folder)
    old = lb.flatten(read_library(spark, folder), "slug") if there else spark.createDataFrame([], _MEMBERS)
    merged = Scratch(spark).keep(import_lists(old, source))
    named = source.lists().groupBy(tx.slugify("list").alias("slug")).agg(F.max_by("list", "ord").alias("name"))
    # lists that the import didn't touch stay as they are; those without a track have a file too
    fields = [c for c in merged.columns if c not in ("slug", "pos")]
    tracks = merged.groupBy("slug").agg(lb.in_order("pos", F.struct(*fields)).alias("tracks"))
    kind = dict(tracks.dtypes)["tracks"]
    write_lists(named.join(tracks, "slug", "left").select("name", F.coalesce("tracks", F.array().cast(kind)).alias("tracks")), folder)
    return import_counts(source)


def enrich_library(members: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks filled from the feature catalog, counters); members(ord unique, title, artist, durationMs, isrc, features)."""
    done = mg.enrich(members, catalog)
    return done.drop("searched", "new_isrc", "new_bpm"), mg.enrich_counts(done)


def curate_library(members: DataFrame, seed: str, name: str | None = None, **options) -> DataFrame:
    """name, place, title, artist and further columns of members in a new list around a seed."""
    if not seed.strip():
        raise ValueError("a seed is required")
    label = F.lit(name) if name else tx.curated_name(F.lit(seed))
    return cu.curate(members, seed, **options).select(label.alias("name"), "*")


def curate_into(folder: str, seed: str, name: str | None = None, **options) -> DataFrame:
    """A list around a seed from the list files of a folder, with all that their tracks have but ids and gain, written beside them; returns its rows."""
    spark = SparkSession.getActiveSession()
    made = Scratch(spark).keep(cu.to_tracks(curate_library(cu.to_rows(read_library(spark, folder), "ord"), seed, name, **options)))
    fields = [f.name for f in model.LIST_TRACK if f.name in made.columns]
    write_lists(made.groupBy("name").agg(lb.in_order("place", F.struct(*fields)).alias("tracks")), folder)
    return made


def lists_exist(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/*.json")


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], model.STATE)
