"""A paged service as a Spark data source: each collection is a partition, whose pages are followed to their end.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").options(fetch="package.module:function", starts="url1\\nurl2").schema(schema).load()

fetch(url) returns (records, next url or None); a record is a dict. What stands behind it (a transport, files, a test) is its own affair. A
page that can't be read ends its collection: the records before it stay, and one more row has the error. A missing collection
(fetch raises FileNotFoundError on its first page) has no rows.

Rows: start (the collection's first url), pos from 0 through all pages, record (its JSON), error.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS = "start string, pos bigint, record string, error string"
Fetch = Callable[[str], tuple[list[dict], str | None]]


def pages(fetch: Fetch, start: str) -> Iterator[tuple[str, int, str | None, str | None]]:
    """All records of a collection in order, then the error that ended it early, if any."""
    url, pos = start, 0
    while url:
        try:
            records, url = fetch(url)
        except FileNotFoundError:
            return
        except Exception as e:  # what was read before is kept
            yield start, pos, None, str(e) or type(e).__name__
            return
        for r in records:
            yield start, pos, json.dumps(r), None
            pos += 1


class _Start(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.starts = options["fetch"], [s for s in options.get("starts", "").split("\n") if s]

    def partitions(self) -> list[InputPartition]:
        return [_Start(s) for s in self.starts] or [_Start("")]

    def read(self, partition: _Start):
        module, _, name = self.fetch.partition(":")
        yield from pages(getattr(importlib.import_module(module), name), partition.url)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_paged(spark: SparkSession, fetch: str, starts: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(start, pos and the fields of schema of all records, start and error of the collections that ended early)."""
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("fetch", fetch).option("starts", "\n".join(starts)).load()
    records = rows.where("record IS NOT NULL").select("start", "pos", F.from_json("record", schema).alias("r")).select("start", "pos", "r.*")
    return records, rows.where("error IS NOT NULL").select("start", "error")


def music(kind: Column, track: Column) -> Column:
    """Whether a record is a track: one that is there, of the kind 'track' or of none."""
    return track.isNotNull() & F.coalesce(kind, F.lit("")).isin("", "track")
