"""List files: canonical JSON lists, hand-written text and JSON track lists."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinata import model
from ostinata.functions import text as tx


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _slug(df: DataFrame) -> DataFrame:
    return df.withColumn("slug", F.regexp_replace(F.col("_metadata.file_name"), r"\.[Jj][Ss][Oo][Nn]$", ""))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """name, tracks of one canonical list; a malformed file is an error."""
    return spark.read.schema(model.LIST_DOC).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """ord, slug, name, tracks of all lists of a folder by file name; a folder without lists is an error. Missing names are the slug, missing tracks none."""
    glob = f"{folder}/*.json"
    if not path_exists(spark, glob):
        raise FileNotFoundError(f"no playlist files in {folder}")
    raw = _slug(spark.read.schema(model.LIST_DOC).option("multiLine", True).option("mode", "FAILFAST").json(glob).select("*", "_metadata"))
    out = raw.select("slug", F.coalesce("name", "slug").alias("name"), F.coalesce("tracks", F.array().cast(model.LIST_DOC["tracks"].dataType)).alias("tracks"))
    # one row for each file; the file order is the library's order
    return out.withColumn("ord", F.row_number().over(W.orderBy("slug")) - 1)


def read_tolerant(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row with the list that imports merge into: what the file has, or nothing if it is missing or malformed; always under the given name."""
    empty = spark.createDataFrame([([],)], T.StructType([model.LIST_DOC["tracks"]]))
    got = spark.read.schema(model.LIST_DOC).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("tracks") if path_exists(spark, path) else empty
    return got.select(F.lit(name).alias("name"), F.coalesce("tracks", F.array().cast(model.LIST_DOC["tracks"].dataType)).alias("tracks"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """title, artists of hand-written lines: blank ones and comments are skipped. Other columns (a line number, say) stay."""
    v = tx.strip(value)
    kept = lines.withColumn("_v", v).where((F.col("_v") != "") & ~F.startswith("_v", F.lit("#"))).withColumn("_s", tx.split_title("_v"))
    others = [c for c in lines.columns if c != value]
    return kept.select(*others, F.col("_s.title").alias("title"), F.when(F.col("_s.artist") != "", F.array("_s.artist")).otherwise(F.array().cast("array<string>")).alias("artists"))


def read_text_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, title, artists of one text list, in the file's order. A list is read whole, as one hand-written file."""
    text = spark.read.option("wholetext", True).text(path)
    return parse_lines(text.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "value")))


def parse_documents(docs: DataFrame) -> DataFrame:
    """name, pos, title, artists from (name, tracks[title, artist]): tracks with a blank title are dropped, commas part artists, nothing else is kept."""
    t = docs.select("name", F.posexplode("tracks").alias("pos", "t")).where(tx.strip("t.title") != "")
    return t.select("name", "pos", tx.strip("t.title").alias("title"), tx.comma_list("t.artist").alias("artists"))


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(read_list(spark, path))


def read_stream(spark: SparkSession, lines) -> DataFrame:
    """pos, title, artists of a hand-written list from an open text file, such as standard input."""
    return parse_lines(spark.createDataFrame(list(enumerate(x.rstrip("\r\n") for x in lines)), "pos int, value string"))


def read_track_list(spark: SparkSession, path: str | None, name: str | None = None) -> tuple[str | None, DataFrame]:
    """(name, tracks) by the path's ending: JSON lists name themselves unless a name is given, text lists need one; no path is standard input."""
    name = (name or "").strip()
    if not path:
        tracks = read_stream(spark, sys.stdin)
    elif path.lower().endswith(".json"):
        own = read_list(spark, path).select("name").first()
        name, tracks = name or (own and own["name"] or "").strip(), read_json_list(spark, path).drop("name")
    else:
        tracks = read_text_list(spark, path)
    if not name:
        raise ValueError("a name is required")
    if tracks.isEmpty():
        raise ValueError("the list has no tracks")
    return name, tracks
