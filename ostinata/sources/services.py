"""Import sources by name, and where a library's tables lie."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinata.sources.tables import ImportSource, imported_tracks


@dataclass
class TableSource:
    """A service over tables: lists(list, ord, error), tracks(list, pos, columns of model.IMPORTED)."""

    label: str
    _lists: DataFrame
    _tracks: DataFrame

    def lists(self) -> DataFrame:
        return self._lists

    def tracks(self) -> DataFrame:
        return self._tracks


def by_name(label: str, existing: DataFrame, tracks: DataFrame, errors: DataFrame | None = None) -> TableSource:
    """A service that lists collections as name to id: existing(name, id, ord), tracks(playlist_id, pos, columns of model.IMPORTED), errors(playlist_id, error).

    Lists come in the order of their names; of equal names the later one counts.
    """
    ids = existing.groupBy("name").agg(F.max_by("id", "ord").alias("playlist_id"))
    if errors is None:
        ids = ids.withColumn("error", F.lit(None).cast("string"))
    else:
        ids = ids.join(errors, "playlist_id", "left")
    # one row for each list of a user
    lists = ids.select(F.col("name").alias("list"), (F.row_number().over(W.orderBy("name")) - 1).cast("bigint").alias("ord"), "error")
    named = tracks.join(ids.select("playlist_id", F.col("name").alias("list")), "playlist_id").drop("playlist_id")
    return TableSource(label, lists, named)


def by_library(label: str, service: str, playlists: DataFrame) -> TableSource:
    """A service whose library is read whole: playlists(ord, name, tracks) in their own order."""
    lists = playlists.select(F.col("name").alias("list"), F.col("ord").cast("bigint").alias("ord"), F.lit(None).cast("string").alias("error"))
    t = playlists.select(F.col("name").alias("list"), F.posexplode("tracks").alias("pos", "t")).select("list", F.col("pos").cast("bigint").alias("pos"), "t.*")
    return TableSource(label, lists, imported_tracks(t, service))


class Sources:
    """Import sources by name: each is made when it is asked for."""

    def __init__(self):
        self._made: dict[str, Callable[..., ImportSource]] = {}

    def register(self, name: str, make: Callable[..., ImportSource]) -> None:
        self._made[name] = make

    def open(self, name: str, **options) -> ImportSource:
        if name not in self._made:
            raise ValueError(f"unknown import source {name!r} (want {'|'.join(sorted(self._made))})")
        return self._made[name](**options)


class Places:
    """Where a library's tables lie: under a given root, that of OSTINATA_HOME, or the user's configuration folder."""

    def __init__(self, root: str | None = None):
        home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
        self.root = (root or os.environ.get("OSTINATA_HOME") or os.path.join(home, "ostinata")).rstrip("/")

    def __getattr__(self, name: str) -> str:
        if name not in ("snapshot", "matches", "state", "lists", "targets", "contents", "settings"):
            raise AttributeError(name)
        return f"{self.root}/{name}"
