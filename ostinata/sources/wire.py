"""Projections of services' nested records to the collection model. Absent fields are NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinata.model import text_or_null

#: What a page of each service holds, as schemas to read JSON with.
SOURCE_TRACK = "id string, uri string, name string, duration_ms bigint, type string, album struct<name: string>, artists array<struct<name: string>>, external_ids struct<isrc: string>"
CATALOG_SONG = "id string, attributes struct<name: string, artistName: string, albumName: string, durationInMillis: bigint, isrc: string, playParams: struct<catalogId: string>>"
SEARCH_SONG = "trackId bigint, trackName string, artistName string, collectionName string, trackTimeMillis bigint"
FEATURE_TRACK = "id bigint, title string, duration int, isrc string, bpm double, gain double, artist struct<name: string>, album struct<title: string>"


def _kept(records: DataFrame, *names: str):
    return [c for c in names if c in records.columns]


def tracks(records: DataFrame, *keys: str) -> DataFrame:
    """Library records (SOURCE_TRACK) as columns of model.TRACK; artists in their order."""
    return records.select(
        *_kept(records, *keys), F.col("name").alias("title"), F.coalesce(F.col("artists.name"), F.array().cast("array<string>")).alias("artists"), F.col("album.name").alias("album"),
        "duration_ms", text_or_null("external_ids.isrc").alias("isrc"), F.col("id").alias("source_id"), F.col("uri").alias("source_uri"),
    )


def songs(records: DataFrame, *keys: str) -> DataFrame:
    """Catalog records (CATALOG_SONG) as columns of model.CATALOG."""
    a = "attributes."
    return records.select(*_kept(records, *keys), "id", F.col(a + "name").alias("title"), F.col(a + "artistName").alias("artist"), F.col(a + "albumName").alias("album"), F.col(a + "durationInMillis").alias("duration_ms"), text_or_null(a + "isrc").alias("isrc"))


def found_songs(records: DataFrame, *keys: str) -> DataFrame:
    """Search records without codes (SEARCH_SONG) as columns of model.CATALOG; numeric ids become strings."""
    return records.select(*_kept(records, *keys), F.col("trackId").cast("string").alias("id"), F.col("trackName").alias("title"), F.col("artistName").alias("artist"), F.col("collectionName").alias("album"), F.col("trackTimeMillis").alias("duration_ms"), F.lit(None).cast("string").alias("isrc"))


def library_tracks(records: DataFrame, service: str, *keys: str) -> DataFrame:
    """Contents of a service's collections (CATALOG_SONG with playParams) as columns of model.IMPORTED; the catalog id names the track."""
    a = "attributes."
    return records.select(
        *_kept(records, *keys), F.col(a + "name").alias("title"), F.col(a + "artistName").alias("artist"), F.col(a + "albumName").alias("album"), F.col(a + "durationInMillis").alias("duration_ms"),
        F.lit(None).cast("string").alias("isrc"), F.lit(service).alias("service"), F.col(a + "playParams.catalogId").alias("service_id"),
    )


def features(records: DataFrame, *keys: str) -> DataFrame:
    """Feature records (FEATURE_TRACK) as columns of model.FEATURE_CATALOG."""
    return records.select(*_kept(records, *keys), "id", "title", F.col("artist.name").alias("artist"), F.col("album.title").alias("album"), F.col("duration").alias("duration_sec"), text_or_null("isrc").alias("isrc"), "bpm", "gain")


def user(records: DataFrame) -> DataFrame:
    """user_id of a profile record(id)."""
    return records.select(F.col("id").alias("user_id"))


def storefront(records: DataFrame) -> DataFrame:
    """storefront of a response(data array of struct with id): the first one's; an empty response is an error."""
    return records.select(F.coalesce(F.try_element_at("data", F.lit(1))["id"], F.raise_error(F.lit("storefront: empty response")).cast("string")).alias("storefront"))
