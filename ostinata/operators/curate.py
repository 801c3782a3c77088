"""New collections around a seed: strongest neighbours, round robin over their pools, artist separation."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinata.functions import text as tx
from ostinata.operators import affinity
from ostinata.operators.library import first_by

SIZE, MIN_WEIGHT, BREADTH = 30, 1, 12


def pools(members: DataFrame) -> DataFrame:
    """artist_norm, title_norm and the first member of each, over all collections whatever their size. members(ord, pos, title, artist)."""
    once = first_by(members, ["artist", "title"], ["ord", "pos"])  # spellings are far fewer than members
    m = once.withColumn("artist_norm", tx.normalize("artist")).withColumn("title_norm", tx.normalize("title")).where("artist_norm <> ''")
    return first_by(m, ["artist_norm", "title_norm"], ["ord", "pos"])


def gather(pool: DataFrame, ranked: DataFrame, size: int = SIZE) -> DataFrame:
    """pick and member: one of each artist in each round, artists in rank order, titles in byte order, until size.

    pool(artist_norm, title, title_norm), ranked(artist_norm, rank): the seed with rank 0, then its neighbours.
    """
    turn = W.partitionBy("artist_norm").orderBy("title", "title_norm")
    rounds = pool.join(ranked, "artist_norm").withColumn("round", F.row_number().over(turn))
    chosen = rounds.orderBy("round", "rank").limit(size)  # size rows at most from here on
    return chosen.withColumn("pick", F.row_number().over(W.orderBy("round", "rank")))


def separate_order(artists: list, last=None) -> list[int]:
    """A greedy order without equal neighbours where that is possible.

    Each step takes, among those whose artist isn't the last one, the artist with most left, the earliest in order
    on ties; if only the last artist is left, the first of what remains. `last` stands before the first.
    """
    left: dict = {}
    for i, a in enumerate(artists):
        left.setdefault(a, []).append(i)
    for a in left:
        left[a].reverse()
    held = (-len(left[last]), left[last][-1], last) if last in left else None
    heap = [(-len(v), v[-1], a) for a, v in left.items() if held is None or a != last]
    heapq.heapify(heap)
    out = []
    while heap or held:
        if heap:
            _, _, a = heapq.heappop(heap)
            again = held
        else:
            (_, _, a), again = held, None
        out.append(left[a].pop())
        if again:
            heapq.heappush(heap, again)
        held = (-len(left[a]), left[a][-1], a) if left[a] else None
    return out


def _runs(key: str, artist: str, last: str | None):
    """Arrow batches of whole collections, each in order, to the same rows resequenced with their places."""

    def placed(t: pa.Table) -> pa.RecordBatch:
        keys = t.column(key).combine_chunks()
        codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        names = ["" if a is None else a for a in t.column(artist).to_pylist()]
        cut = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(names)]
        at, place = np.arange(len(names)), np.arange(1, len(names) + 1)
        for lo, hi in zip(cut, cut[1:]):
            place[lo:hi] -= lo
            mine = names[lo:hi]
            if last in mine or len(set(mine)) < hi - lo:  # else the order stays
                at[lo:hi] = lo + np.array(separate_order(mine, last))
        return t.take(pa.array(at)).append_column("place", pa.array(place, pa.int64())).combine_chunks().to_batches()[0]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key)
            turn = b.num_rows
            end = keys[turn - 1]
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            same = np.flatnonzero(codes != codes[-1])
            first = int(same[-1]) + 1 if len(same) else 0  # where the last collection begins
            if held and (first or held[-1].column(key)[0] != end):
                head = b.slice(0, first) if first else None
                if head is not None and held[-1].column(key)[0] == head.column(key)[0]:
                    yield placed(pa.Table.from_batches([*held, head]))
                else:
                    yield placed(pa.Table.from_batches(held))
                    if head is not None:
                        yield placed(pa.Table.from_batches([head]))
                held = []
            elif first:
                yield placed(pa.Table.from_batches([b.slice(0, first)]))
            held.append(b.slice(first))
        if held:
            yield placed(pa.Table.from_batches(held))

    return run


def separate(rows: DataFrame, key: str, order: str, artist: str, last: str | None = None) -> DataFrame:
    """Adds place (from 1) to the rows of each collection; order is the incoming order, and an absent artist is ''. Sequential within a collection, parallel over them.

    last is the artist that none may follow at first: '' for lists around a seed, so that a row without an artist doesn't
    come first where there is another; None for no such artist.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", place bigint"
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(_runs(key, artist, last), ddl)


def arc_order(artists: list, energies: list, last=None) -> list[int]:
    """Two layers: separation as in separate_order decides which artist comes next, the energy arc which of that artist's rows.

    Where several artists have most left, the one whose nearest row is nearest to the arc is taken, the earliest of equals.
    """
    left: dict = {}
    for i, a in enumerate(artists):
        left.setdefault(a, []).append(i)
    n, out = len(artists), []
    for place in range(n):
        x = place / max(n - 1, 1)
        want = 0.3 + 0.7 * x / (2 / 3) if x <= 2 / 3 else 1.0 - 0.5 * (x - 2 / 3) / (1 / 3)
        others = [a for a in left if a != last] or list(left)
        most = max(len(left[a]) for a in others)
        off, i, last = min((abs((energies[i] if energies[i] is not None else want) - want), i, a) for a in others if len(left[a]) == most for i in left[a])
        out.append(i)
        left[last].remove(i)
        if not left[last]:
            del left[last]
    return out


def sequence_arc(rows: DataFrame, key: str, order: str, artist: str, energy: str) -> DataFrame:
    """Adds place (from 1): artists apart, and within that energies along the arc. Lists are of bounded length, each is one task's."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        at = arc_order(["" if a is None else a for a in t.column(artist).to_pylist()], t.column(energy).to_pylist())
        return t.take(pa.array(at)).append_column("place", pa.array(range(1, len(at) + 1), pa.int64()))

    return rows.groupBy(key).applyInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", place bigint")


def to_rows(lists: DataFrame, *keys: str, tracks: str = "tracks") -> DataFrame:
    """keys, pos, title, artist, album, isrc, durationMs, bpm of list tracks: what curation reads. Ids, gain and source are left behind."""
    t = lists.select(*keys, F.posexplode(tracks).alias("pos", "t"))
    return t.select(*keys, "pos", "t.title", "t.artist", "t.album", "t.isrc", "t.durationMs", F.coalesce("t.features.bpm", F.lit(0.0)).alias("bpm"))


def to_tracks(rows: DataFrame, source: str = "deezer") -> DataFrame:
    """Curation's rows as list tracks: a tempo of more than 0 becomes features under the catalog's name, other columns stay."""
    features = F.when(F.col("bpm") > 0, F.struct("bpm", F.lit(None).cast("double").alias("gain"), F.lit(source).alias("source")))
    return rows.withColumn("features", features).drop("bpm")


def curate(members: DataFrame, seed: str, size: int = SIZE, min_weight: int = MIN_WEIGHT, breadth: int = BREADTH, cap: int = affinity.MAX_BASKET) -> DataFrame:
    """place, title, artist and whatever further columns members have, around a seed artist; empty where the seed is in no pool. members(ord, pos, title, artist, ...)."""
    spark = members.sparkSession
    ns = spark.range(1).select(tx.normalize(F.lit(seed))).first()[0]
    pairs = affinity.cooccurrence(members.select("ord", tx.normalize("artist").alias("a")), "ord", "a", cap)
    pool = pools(members)
    near = affinity.neighbours(pairs, ns, breadth, min_weight).withColumn("rank", F.row_number().over(W.orderBy(F.desc("weight"), "artist")))  # breadth rows
    ranked = near.select(F.col("artist").alias("artist_norm"), "rank").unionByName(spark.createDataFrame([(ns, 0)], "artist_norm string, rank int"))
    known = pool.where(F.col("artist_norm") == ns).select(F.lit(ns).alias("_seed")).limit(1)
    picked = gather(pool, ranked, size).crossJoin(F.broadcast(known))  # one row or none
    others = [c for c in members.columns if c not in ("ord", "pos", "title", "artist")]
    columns = ["title", "artist", *others]
    return separate(picked.select(F.lit(ns).alias("_list"), "pick", "artist_norm", *columns), "_list", "pick", "artist_norm", "").select("place", *columns)
