"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within a squared distance of r2 = 2 - 2t. After a random rotation the
coordinates are split into low-dimensional blocks; if two vectors are that near, then in some block of
d_j of the d coordinates their squared distance is at most r2 * d_j / d. Each block is range-joined
under its budget: a grid over its first coordinates with cells as wide as the budget's root brings a vector to its own
cell and to those later neighbours that its ball touches, cells are joined by key, and within a cell the
next coordinate is swept in order. The union of all blocks' candidates is verified by exact cosines.

Equal vectors are one class from the start, so that copies cost nothing: the least id represents the class, only
representatives are joined, and membership is a table of its own. No link between different vectors is lost.

The number of gridded coordinates grows with the logarithm of the row count, so that cells keep about
CELL vectors; it changes the work and never the result.

Defined results: see vectors.usable for NULLs and repeats; zero vectors have no direction and are near
to none, nor in any class; vectors of different dimensions aren't compared; other columns are ignored. A pair of
classes is reported once, its lesser id first.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.llm.common import Scratch, mix64, table
from ostinata.llm.components import components
from ostinata.llm.vectors import usable

COSINE = 0.95
WIDTH = 8
CELL = 4096
SEED = 11
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def spans(dim: int) -> list[tuple[int, int]]:
    n = max(1, dim // WIDTH)
    cut = [round(i * dim / n) for i in range(n + 1)]
    return list(zip(cut, cut[1:]))


def _celled(cosine: float, gridded: int):
    """Rows (dim, id, x) to (cell, dim, home, id, part) in the cells that they belong to."""

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                ids = b.column(1).take(at).to_numpy()
                x = np.frombuffer(b"".join(b.column(2).take(at).to_pylist()), np.float64).reshape(len(ids), dim)
                x = x / np.sqrt((x * x).sum(1))[:, None] @ rotation(int(dim))
                r2 = 2 - 2 * cosine
                for j, (lo, hi) in enumerate(spans(int(dim))):
                    budget = r2 * (hi - lo) / dim * (1 + 1e-9) + 1e-12
                    part = x[:, lo:hi]
                    packed = np.ascontiguousarray(part, np.float32).view(f"V{4 * (hi - lo)}").ravel()
                    g = min(gridded, hi - lo)
                    scaled = part[:, :g] / np.sqrt(budget)
                    cell = np.floor(scaled).astype(np.int64)
                    down, up = scaled - cell, cell + 1 - scaled
                    for step in itertools.product((-1, 0, 1), repeat=g):
                        if step < (0,) * g:
                            continue
                        home = not any(step)
                        s = np.array(step)
                        gap = np.where(s < 0, down, np.where(s > 0, up, 0))
                        go = np.flatnonzero((gap**2).sum(1) <= 1 + 1e-9)
                        key = np.full(len(go), np.uint64(int(dim) * 1000 + j))
                        for c in range(g):
                            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + (cell[go, c] + s[c]).view(np.uint64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(np.full(len(go), dim, np.int32)), pa.array(np.full(len(go), home)), pa.array(ids[go]), pa.array(packed[go].tolist(), pa.binary())],
                            names=["cell", "dim", "home", "id", "part"],
                        )

    return run


class _Cell:
    """The home vectors of a cell in the order of the swept coordinate."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, budget: float, swept: int):
        order = np.argsort(x[:, swept], kind="stable")
        self.ids, self.x, self.budget, self.swept = ids[order], x[order], budget, swept
        self.line = self.x[:, swept]
        self.half = (self.x * self.x).sum(1) / 2

    def near(self, ids: np.ndarray, x: np.ndarray, own: bool = False):
        """Pairs (a < b) of given vectors and home vectors within the budget; own: the given ones are the home vectors, each pair once."""
        if not own:
            order = np.argsort(x[:, self.swept], kind="stable")
            ids, x = ids[order], x[order]
        reach = np.sqrt(self.budget) + 1e-6
        for a in range(0, len(ids), 256):
            y = x[a : a + 256]
            lo = a if own else np.searchsorted(self.line, y[0, self.swept] - reach)
            hi = np.searchsorted(self.line, y[-1, self.swept] + reach, side="right")
            if lo >= hi:
                continue
            s = y @ self.x[lo:hi].T
            s -= self.half[lo:hi]
            i, k = np.nonzero(s >= (((y * y).sum(1) - self.budget) / 2 - 2e-6)[:, None])
            if own:
                keep = i < k
                i, k = i[keep], k[keep]
            p, q = ids[a + i], self.ids[lo + k]
            ok = p != q
            p, q = p[ok], q[ok]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])


def _near(cosine: float, gridded: int):
    """Rows of whole cells, home vectors first, to the pairs of each cell; other vectors are streamed against the home vectors."""

    def run(batches):
        now, cell = None, None
        ids, parts = [], []

        def opened(dim: int) -> _Cell:
            x = np.concatenate(parts)
            w = x.shape[1]
            return _Cell(np.concatenate(ids), x, (2 - 2 * cosine) * w / dim * (1 + 1e-6) + 1e-12, min(gridded, w - 1))

        for b in batches:
            if not b.num_rows:
                continue
            key, dims, home, who = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            data = b.column(4).to_pylist()
            turn = np.flatnonzero((key[1:] != key[:-1]) | (dims[1:] != dims[:-1]) | (home[1:] != home[:-1])) + 1
            for lo, hi in zip([0, *turn], [*turn, len(key)]):
                if now != (key[lo], dims[lo]):
                    if ids:
                        yield from (cell := opened(now[1])).near(cell.ids, cell.x, True)
                    now, cell, ids, parts = (key[lo], dims[lo]), None, [], []
                x = np.frombuffer(b"".join(data[lo:hi]), np.float32).reshape(hi - lo, -1)
                if home[lo]:
                    ids.append(who[lo:hi]), parts.append(x)
                elif ids or cell:
                    if cell is None:
                        cell = opened(now[1])
                        yield from cell.near(cell.ids, cell.x, True)
                        ids, parts = [], []
                    yield from cell.near(who[lo:hi], x)
        if ids:
            yield from (cell := opened(now[1])).near(cell.ids, cell.x, True)

    return run


def _verified(cosine: float):
    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            a, b = t.column(0).to_numpy(), t.column(1).to_numpy()
            x, y = t.column(2).to_pylist(), t.column(3).to_pylist()
            size = np.fromiter(map(len, x), np.int64, len(x))
            same = size == np.fromiter(map(len, y), np.int64, len(y))
            for n in np.unique(size[same]):
                at = np.flatnonzero(same & (size == n))
                p, q = (np.frombuffer(b"".join([v[i] for i in at]), np.float64).reshape(len(at), -1) for v in (x, y))
                c = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
                ok = np.round(c, 9) >= cosine
                yield pa.RecordBatch.from_arrays([pa.array(a[at][ok]), pa.array(b[at][ok]), pa.array(np.round(c[ok], 6))], names=["id_a", "id_b", "cosine"])

    return run


def _packed(batches):
    for b in batches:
        x = [(np.array(v) + 0.0).tobytes() for v in b.column(2).to_pylist()]  # -0.0 is 0.0
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in x], pa.binary()), pa.array(x, pa.binary())], names=["id", "dim", "digest", "x"])


def classes(vectors: DataFrame, key: str, vector: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, class_id of every vector with a direction; class_id, dim, x of every class): class_id is the least id of equal vectors."""
    usable_ = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0))
    packed = scratch.keep(usable_.select("id", "dim", "v").mapInArrow(_packed, "id bigint, dim int, digest binary, x binary"))
    reps = scratch.keep(packed.groupBy("digest").agg(F.min("id").alias("class_id"), F.min_by(F.struct("dim", "x"), "id").alias("r")).select("digest", "class_id", "r.*"))
    return packed.select("id", "digest").join(reps.select("digest", "class_id"), "digest").select("id", "class_id"), reps.select("class_id", "dim", "x")


def _pairs(reps: DataFrame, cosine: float) -> DataFrame:
    n = reps.count()
    gridded = 1
    while gridded < WIDTH and n / 4**gridded > CELL:
        gridded += 1
    cells = reps.select("dim", F.col("class_id").alias("id"), "x").mapInArrow(_celled(cosine, gridded), "cell bigint, dim int, home boolean, id bigint, part binary")
    placed = cells.repartition("cell").sortWithinPartitions("cell", "dim", F.desc("home"))
    found = placed.mapInArrow(_near(cosine, gridded), "a bigint, b bigint").distinct()
    xa = reps.select(F.col("class_id").alias("a"), F.col("x").alias("x_a"))
    xb = reps.select(F.col("class_id").alias("b"), F.col("x").alias("x_b"))
    # the number of candidates can't be foreseen, so no side is broadcast on an estimate
    return found.join(xa.hint("merge"), "a").join(xb.hint("merge"), "b").select("a", "b", "x_a", "x_b").mapInArrow(_verified(cosine), "id_a bigint, id_b bigint, cosine double")


def near_pairs(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id_a < id_b and cosine of all pairs of classes with a cosine of at least `cosine`."""
    return _pairs(classes(vectors, key, vector, Scratch(vectors.sparkSession))[1], cosine)


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id, class_id and links of every vector with a direction: links is the number of other classes that are near to its own."""
    members, reps = classes(vectors, key, vector, Scratch(vectors.sparkSession))
    pairs = _pairs(reps, cosine)
    degree = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(degree, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id, group_id, keep of every vector with a direction: its group is the connected component of near classes, named by its least id, which is kept."""
    scratch = Scratch(vectors.sparkSession)
    members, reps = classes(vectors, key, vector, scratch)
    roots = components(_pairs(reps, cosine).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), scratch)
    group = members.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("id", F.coalesce("root", "class_id").alias("group_id"))
    return group.withColumn("keep", F.col("id") == F.col("group_id"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its class and its number of near classes."""
    return links(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP4_SQL = f"""
WITH e AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings GROUP BY vec_id),
c AS (SELECT v, min(vec_id) AS class_id FROM e GROUP BY v),
p AS (SELECT a.class_id, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine FROM c a JOIN c b ON a.class_id <> b.class_id),
l AS (SELECT class_id, count(*) AS links FROM p WHERE round(cosine, 9) >= {COSINE} GROUP BY class_id)
SELECT e.vec_id, c.class_id, coalesce(l.links, 0) AS links FROM e JOIN c ON e.v = c.v LEFT JOIN l ON c.class_id = l.class_id
"""
