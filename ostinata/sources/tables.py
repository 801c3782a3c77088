"""Snapshots, matches and push records as tables, and table-backed ports in place of remote services.

A remote service is any object with these methods, each returning a DataFrame; TablePort keeps them in
memory or on tables. What a service does page by page (and how it paces, retries and signs in) is its own affair.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinata import model


def load(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A saved table, JSON or Parquet by its ending."""
    if path.lower().endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).parquet(path)


def load_or_empty(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The same, or no rows where nothing was saved yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return load(spark, schema, path) if there else spark.createDataFrame([], schema)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, description, kind, owner_id, source_id, tracks of a saved library."""
    snap = load(spark, model.SNAPSHOT, path)
    return snap.select(F.posexplode("playlists").alias("ord", "p")).select("ord", "p.*")


def load_matches(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, model.MATCH, path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return load_or_empty(spark, model.STATE, path)


class CatalogPort(Protocol):
    """Songs to resolve against: columns of model.CATALOG and cand_pos."""

    def songs(self) -> DataFrame: ...


class LibraryPort(Protocol):
    """Target collections: existing(name, id, ord), refs(playlist_id, title, artist)."""

    def existing(self) -> DataFrame: ...

    def refs(self) -> DataFrame: ...


class ImportSource(Protocol):
    """Collections to import: label, lists(list, ord, error) and tracks(list, pos, columns of model.IMPORTED)."""

    label: str

    def lists(self) -> DataFrame: ...

    def tracks(self) -> DataFrame: ...


class TablePort:
    """All ports over tables: catalog, target collections and their contents."""

    def __init__(self, catalog: DataFrame, existing: DataFrame | None = None, refs: DataFrame | None = None):
        self._catalog, self._existing, self._refs = catalog, existing, refs

    def songs(self) -> DataFrame:
        return self._catalog

    def without_codes(self) -> TablePort:
        """A catalog that can't be looked up by code, so that every track is searched by title."""
        return TablePort(self._catalog.withColumn("isrc", F.lit(None).cast("string")), self._existing, self._refs)

    def existing(self) -> DataFrame:
        return self._existing

    def existing_ids(self) -> DataFrame:
        """name, id; of equal names the later."""
        return self._existing.groupBy("name").agg(F.max_by("id", "ord").alias("id"))

    def refs(self) -> DataFrame:
        return self._refs


def imported_tracks(tracks: DataFrame, service: str) -> DataFrame:
    """Tracks of a library (artists as an array, source_id) as import rows."""
    return tracks.select(
        *[c for c in ("list", "pos") if c in tracks.columns], "title", F.array_join("artists", ", ").alias("artist"), "album", "duration_ms", "isrc", F.lit(service).alias("service"), F.col("source_id").alias("service_id")
    )


