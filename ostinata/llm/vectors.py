"""Vector rows that a search can use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v array<double>, dim of each distinct id with a vector.

    Rows with a NULL id, and vectors that are NULL, empty or hold a NULL, NaN or infinite number, are left out.
    An id that comes up more than once stands for the least of its vectors.
    """
    v = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where("id IS NOT NULL AND size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return v.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

