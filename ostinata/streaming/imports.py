"""Streaming forms: imports merged as they arrive, and running co-occurrence counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ostinata import model
from ostinata.functions import text as tx
from ostinata.operators.merge import merge_fold
from ostinata.sources.tables import load_or_empty

_LISTS = "slug string, pos bigint, title string, artist string, album string, durationMs bigint, isrc string, ids map<string,string>, features struct<bpm: double, gain: double, source: string>"


def merge_stream(imports: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch of imports(list, pos, columns of model.IMPORTED) into the lists under folder, in versions.

    A batch that is run again after a failure starts from the same version and so gives the same lists.
    """
    spark = imports.sparkSession
    schema = spark.createDataFrame([], _LISTS).schema

    def merge(batch: DataFrame, epoch: int) -> None:
        before = load_or_empty(spark, schema, f"{folder}/v{epoch}")
        new = batch.withColumn("slug", tx.slugify("list")).withColumn("key", tx.track_key("title"))
        merge_fold(before.withColumn("key", tx.track_key("title")), new).write.mode("overwrite").parquet(f"{folder}/v{epoch + 1}")

    return imports.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, by, n of each time window; rows later than `late` behind the newest are dropped."""
    w = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", window), by)
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


IMPORT_COLUMNS = ["list", "pos", *model.IMPORTED.names]
