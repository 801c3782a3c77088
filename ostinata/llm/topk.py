"""Exact top-k search by inner product over norm buckets: stated queries against all vectors.

Vectors are sorted by length into buckets of BLOCK, queries into blocks of QUERIES. A block of queries
first meets the longest bucket, which gives each query a threshold theta, the k-th best product there.
No vector of another bucket can do better where theta > |q| * (the bucket's greatest length); buckets for
which that holds for a whole block aren't joined with it. Every other pair of a block and a bucket is
worked on by itself, so a search is parallel over both, and a query's best of all buckets are merged.
Within a bucket the local cosine threshold theta / (|q| * length) chooses the pruning: from COSINE on,
coordinate pruning (a vector with that cosine lies within an interval around each of the query's
coordinates; the query's largest ones are looked up in sorted coordinates), below it length pruning (a
prefix of the bucket, which is sorted by length). What is left is verified by exact products.

Products are ranked rounded to 9 places, ties by the lesser id. Vectors are compared with those of the same
dimension only. Defined results: see vectors.usable for NULLs and repeats; zero vectors take part with
product 0; with fewer than k others a query has as many rows; a query that is no usable vector has none;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinata.llm.common import Scratch, table
from ostinata.llm.vectors import usable

K = 10
BLOCK = 4096
#: Queries in a block.
QUERIES = 1024
#: The query set of op3_topk_search: ids that are a multiple of this.
EVERY = 100
#: Local cosine threshold from which coordinates prune better than lengths.
COSINE = 0.75
FOCUS = 3
_PLACES = 9


def _blocks(size: int):
    """Rows (dim, id, v) of one range of lengths, longest first, to packed blocks."""

    def run(batches):
        task = TaskContext.get().partitionId()
        rows: list[tuple[int, int, list[float]]] = []
        n = 0
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            while rows:
                dim = rows[0][0]
                same = next((i for i, r in enumerate(rows) if r[0] != dim or i == size), None)
                if same is None:
                    break
                yield _block(task, n, rows[:same])
                n += 1
                rows = rows[same:]
        if rows:
            yield _block(task, n, rows)

    return run


def _block(task: int, n: int, rows: list) -> pa.RecordBatch:
    x = np.array([r[2] for r in rows], np.float64)
    length = np.sqrt((x * x).sum(1))
    order = np.argsort(-length, kind="stable")
    ids = np.array([r[1] for r in rows], np.int64)[order]
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[0][0]], pa.int32()), pa.array([(task << 20) + n]), pa.array([float(length.max())]), pa.array([ids.tobytes()], pa.binary()), pa.array([x[order].tobytes()], pa.binary())],
        names=["dim", "block", "longest", "ids", "x"],
    )


class Best:
    """The best k (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, theta: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.length = np.sqrt((x * x).sum(1))
        self.theta = np.full(len(ids), -np.inf) if theta is None else theta.copy()
        self.score = np.full((len(ids), k), -np.inf)
        self.other = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Candidates: q numbers the queries, ids and x are the vectors."""
        ok = ids != self.ids[q]
        q, ids, x = q[ok], ids[ok], x[ok]
        if not len(q):
            return
        s = np.round(np.einsum("ij,ij->i", self.x[q], x), _PLACES) + 0.0
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        cut = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        within = np.arange(len(q)) - np.repeat(cut, np.diff(np.append(cut, len(q))))
        top = within < self.k
        q, ids, s, within = q[top], ids[top], s[top], within[top]
        who = np.unique(q)
        row = np.searchsorted(who, q)
        new_s = np.full((len(who), self.k), -np.inf)
        new_i = np.full((len(who), self.k), np.iinfo(np.int64).max)
        new_s[row, within], new_i[row, within] = s, ids
        all_s, all_i = np.hstack([self.score[who], new_s]), np.hstack([self.other[who], new_i])
        order = np.lexsort((all_i, -all_s), axis=1)[:, : self.k]
        self.score[who] = np.take_along_axis(all_s, order, 1)
        self.other[who] = np.take_along_axis(all_i, order, 1)
        self.theta[who] = np.maximum(self.theta[who], self.score[who, -1])

    def visit(self, ids: np.ndarray, x: np.ndarray) -> None:
        """All vectors of a bucket, longest first, against all queries."""
        length = np.sqrt((x * x).sum(1))
        slack = 1e-8 * max(1.0, float(self.length.max(initial=0) * length[0]))
        with np.errstate(divide="ignore", invalid="ignore"):
            local = (self.theta - slack) / (self.length * length[0])
        local[np.isnan(local)] = -np.inf
        open_ = local <= 1
        by_coordinate = np.flatnonzero(open_ & (local >= COSINE))
        by_length = np.flatnonzero(open_ & (local < COSINE))
        if len(by_coordinate):
            self._coordinates(by_coordinate, local, ids, x, length)
        for a in range(0, len(by_length), 512):
            q = by_length[a : a + 512]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.theta[q] > slack, (self.theta[q] - slack) / self.length[q], 0.0)
            n = int(np.searchsorted(-length, -np.min(least), side="right"))
            if not n:
                continue
            s = self.x[q] @ x[:n].T
            theta = self.theta[q]
            if n > self.k + 1 and np.isinf(theta).any():
                theta = np.maximum(theta, np.partition(s, n - self.k - 1, axis=1)[:, n - self.k - 1])
            i, j = np.nonzero(s >= theta[:, None] - slack)
            self.add(q[i], ids[j], x[j])

    def _coordinates(self, queries: np.ndarray, local: np.ndarray, ids: np.ndarray, x: np.ndarray, length: np.ndarray) -> None:
        unit = x / np.maximum(length, 1e-300)[:, None]
        mine = self.x[queries] / self.length[queries, None]
        sorted_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found_q, found_j = [], []
        focus = np.argsort(-np.abs(mine), axis=1)[:, :FOCUS]
        for q, u, f, t in zip(queries, mine, focus, local[queries]):
            best = None
            for c in f:
                if c not in sorted_:
                    order = np.argsort(unit[:, c], kind="stable")
                    sorted_[c] = unit[order, c], order
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - u[c] * u[c]))) + 1e-9
                lo, hi = _interval(u[c], t, reach)
                a, b = np.searchsorted(sorted_[c][0], lo, side="left"), np.searchsorted(sorted_[c][0], hi, side="right")
                if best is None or b - a < best[1] - best[0]:
                    best = a, b, c
            at = sorted_[best[2]][1][best[0] : best[1]]
            for c in f:
                lo, hi = _interval(u[c], t, np.sqrt(max(0.0, (1 - t * t) * (1 - u[c] * u[c]))) + 1e-9)
                at = at[(unit[at, c] >= lo) & (unit[at, c] <= hi)]
            found_q.append(np.full(len(at), q))
            found_j.append(at)
        q, j = np.concatenate(found_q), np.concatenate(found_j)
        for a in range(0, len(q), 200_000):
            self.add(q[a : a + 200_000], ids[j[a : a + 200_000]], x[j[a : a + 200_000]])


def _interval(u: float, t: float, reach: float) -> tuple[float, float]:
    """Where a unit vector's coordinate can lie if its cosine with a unit vector of coordinate u is t or more."""
    lo = -1.0 if u <= -t else u * t - reach
    hi = 1.0 if u >= t else u * t + reach
    return lo, hi


def _unpack(ids: bytes, x: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(x, np.float64).reshape(-1, dim)


def _by_length(clean: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """dim, block, longest, ids, x: packed blocks of vectors of about equal length, longest first within a block."""
    n = clean.count()
    key = ("dim", F.col("l2").desc(), F.xxhash64("id"))
    ranged = clean.select("dim", "id", "v", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("l2")).repartitionByRange(max(1, -(-n // size)), *key)
    return scratch.keep(ranged.sortWithinPartitions("dim", F.col("l2").desc(), "id").select("dim", "id", "v").mapInArrow(_blocks(size), "dim int, block bigint, longest double, ids binary, x binary"))


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, queries: Column | None = None) -> DataFrame:
    """query_id, rank, neighbour_id, score: the k greatest inner products of each query with others. queries: which ids are queries, all by default."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    clean = scratch.keep(usable(vectors, key, vector))
    packed = _by_length(clean, BLOCK, scratch)
    asked = _by_length(clean if queries is None else clean.where(queries), QUERIES, scratch)
    # the longest bucket of each dimension seeds the thresholds
    top = packed.groupBy("dim").agg(F.max_by(F.struct("ids", "x"), F.struct("longest", -F.col("block"))).alias("top"))

    def seeded(batches):
        for b in batches:
            theta, least = [], []
            for dim, ids, x, tids, tx in zip(*(b.column(c).to_pylist() for c in ("dim", "ids", "x", "tids", "tx"))):
                best = Best(*_unpack(ids, x, dim), k)
                best.visit(*_unpack(tids, tx, dim))
                theta.append(best.theta.tobytes())
                least.append(float(best.theta.min()))
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("block"), b.column("longest"), b.column("ids"), b.column("x"), pa.array(theta, pa.binary()), pa.array(least, pa.float64())], names=["dim", "query", "longest", "q_ids", "q_x", "theta", "least"])

    seeds = asked.join(top, "dim").select("dim", "block", "longest", "ids", "x", F.col("top.ids").alias("tids"), F.col("top.x").alias("tx"))
    seeds = scratch.keep(seeds.mapInArrow(seeded, "dim int, query bigint, longest double, q_ids binary, q_x binary, theta binary, least double"))
    # pairs of a query block and a bucket that may matter to it, by their figures only
    buckets = packed.select("dim", F.col("block").alias("bucket"), F.col("longest").alias("reach"))
    pairs = seeds.select("dim", "query", "longest", "least").join(buckets, "dim").where("least <= longest * reach * (1 + 1e-7) + 1e-7").select("query", "bucket")
    sent = pairs.join(seeds.select("dim", "query", "q_ids", "q_x", "theta").hint("merge"), "query")
    met = sent.join(packed.select(F.col("block").alias("bucket"), "ids", "x").hint("merge"), "bucket").select("dim", "q_ids", "q_x", "theta", "ids", "x")

    def search(batches):
        for b in batches:
            for dim, q_ids, q_x, theta, ids, x in zip(*(b.column(c).to_pylist() for c in range(6))):
                best = Best(*_unpack(q_ids, q_x, dim), k, np.frombuffer(theta, np.float64))
                best.visit(*_unpack(ids, x, dim))
                yield _result(best)

    found = met.mapInArrow(search, "query_id bigint, neighbour_id bigint, product double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("product"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", (F.round("product", 6) + F.lit(0.0)).alias("score"))


def _result(best: Best) -> pa.RecordBatch:
    q, r = np.nonzero(np.isfinite(best.score))
    return pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.other[q, r]), pa.array(best.score[q, r])], names=["query_id", "neighbour_id", "product"])


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is a multiple of EVERY, against all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), queries=F.col("id") % EVERY == 0)


OP3_SQL = f"""
WITH e AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_dot_product(a.v, b.v) AS p FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, {_PLACES}) DESC, neighbour_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(p, 6) + 0.0 AS score FROM r WHERE rank <= {K}
"""
