"""Shared pieces of the training-data operators: tables, labelled samples and text hashing."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.sources.storage import Scratch, own_folder, shared_folder  # noqa: F401

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, per_class: int, seed: int):
    """Up to per_class labelled documents of each class (0 and 1), chosen by a hash of doc_id, as pandas (text, y).

    Of a doc_id with several labels or texts the least of each counts; labels of no document are passed over after the choice.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    rank = F.xxhash64(F.lit(seed), "doc_id")
    chosen = None
    for y in (0, 1):
        part = labels.where(F.col("y") == y).orderBy(rank, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # no more rows than chosen
    return found.toPandas().sort_values(["doc_id", "y", "text"]).reset_index(drop=True)[["text", "y"]]


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A worker's function over batches that gives freed memory back at its end: workers live on, and what one stage took would add to the next one's."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def rows_of(batch: pa.RecordBatch, size: int = 500):
    """A batch in slices, so that few of its texts are Python objects at a time."""
    for lo in range(0, batch.num_rows, size):
        yield batch.slice(lo, size)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd 64-bit base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_bounds(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def batches_of(texts: list, size: int):
    """Index ranges of texts whose lengths add up to about size each; a longer text has a range of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
