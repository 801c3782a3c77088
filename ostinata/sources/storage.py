"""Where intermediate tables lie: a folder that every executor can read, and tables in it that are deleted at the end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}
_TABLES: dict[str, SparkSession] = {}


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent a local-mode session (tests) gets a temporary folder; a cluster
    session is refused, because a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='ostinata-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one, deleted by clean or when the driver ends."""
    root = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE[root] = spark
    return root


def clean() -> None:
    """Delete all intermediate tables that this driver wrote; results that still read them can't be read any more."""
    for made, remove in ((_TABLES, lambda spark, name: spark.sql(f"DROP TABLE IF EXISTS {name}")), (_MADE, delete)):
        while made:
            name, spark = made.popitem()
            try:
                remove(spark, name)
            except Exception:  # the session has ended before its driver
                pass


atexit.register(clean)


class Scratch:
    """Intermediate tables written to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = own_folder(spark, "scratch")
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def keep_bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """The same in buckets by a column, as many as there are shuffle partitions: a grouping by it moves nothing."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        name = f"scratch_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.mode("overwrite").format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
        _TABLES[name] = self.spark
        out = self.spark.table(name)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for df in frames:
            delete(self.spark, df.scratch_path)
