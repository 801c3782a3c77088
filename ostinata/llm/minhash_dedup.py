"""Near-duplicate documents by MinHash banding and sequential Bayesian verification.

Documents are sets of SHINGLE-word shingles of lower-case words: runs of ASCII letters, digits and non-ASCII
characters that are no punctuation, symbol or space. In scripts that put no spaces between words (Han, Kana, Thai, Lao,
Khmer, Burmese, Tibetan) each character is a word, so shingles are of characters there. Documents with equal word sequences are one node from the start. Bands of MinHash values
name candidates; a candidate pair's signatures are compared batch by batch, and the pair is pruned as
soon as the posterior probability of a similarity of THRESHOLD or more, under a uniform prior, falls
below MISS; survivors are verified on the shingles themselves. Near-duplicates are the connected
components of verified pairs.

No pair of a bucket is left out, and large groups of copies don't cost a square: in a first round each
bucket's members meet its least member only; a second round takes every pair of a bucket whose members
are still in different components. A pair within a component can't change the result. Buckets are never
collected: they are figures (least member, count, order-free hashes) and joins, which AQE splits where a bucket is
hot, and of buckets with the same members one is taken. Texts move only if they are in a surviving pair, as
long as the ids of these fit a broadcast of BROADCAST_IDS.

Defined results: rows that share a doc_id are one document, near to another if any of these rows is,
and give one result row; rows with a NULL doc_id have no result row here and are kept by the filter;
NULL texts are alike to nothing; texts without a word (empty ones, signs only) are alike only to equal texts;
ties go to the least doc_id, which represents its group. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.llm.common import Scratch, batches_of, mix64, rows_of, run_bounds, span_hashes, table, tidy
from ostinata.llm.components import components

SHINGLE = 3
#: A pair at the threshold meets in some band with probability 1 - (1 - 0.5^4)^40 = 0.924.
BANDS, ROWS = 40, 4
THRESHOLD = 0.5
#: Posterior probability of a similar pair below which it is pruned.
MISS = 0.001
#: MinHash values compared between two looks at the posterior.
BATCH = 16
#: MinHash values that the posterior looks at, at most.
COMPARED = 128
#: Ids up to which those of surviving pairs are broadcast to filter the texts before they move; 16 bytes each.
BROADCAST_IDS = 1_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


#: Han, Kana, Thai, Lao, Tibetan, Burmese, Khmer.
UNSPACED = re.compile("[\u0e01-\u0e4e\u0e81-\u0edf\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: What isn't an ASCII character or a Latin letter; a text without it needs no closer look.
_RARE = re.compile("[^\x00-\x7f\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
_PARTING: list[re.Pattern] = []


def _parting() -> re.Pattern:
    """Non-ASCII punctuation, symbols and spaces."""
    if not _PARTING:
        points = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "PSZ"]
        edges = [i for i, c in enumerate(points) if i == 0 or points[i - 1] != c - 1] + [len(points)]
        _PARTING.append(re.compile("[" + "".join(f"{re.escape(chr(points[a]))}-{re.escape(chr(points[b - 1]))}" for a, b in zip(edges, edges[1:])) + "]+"))
    return _PARTING[0]


def folded(text: str) -> bytes:
    """The text in lower case, non-ASCII signs as spaces, characters of unspaced scripts apart."""
    low = text.lower()
    if not low.isascii() and _RARE.search(low):
        low = UNSPACED.sub(r" \g<0> ", _parting().sub(" ", low))
    return low.encode("utf-8", "replace")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(folded(text))


def shingles_of(text: str) -> set[bytes]:
    w = words_of(text)
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def least_matches(batch: int = BATCH, total: int = COMPARED, threshold: float = THRESHOLD, miss: float = MISS) -> dict[int, int]:
    """For each number of compared values the least number of equal ones with which a pair goes on.

    With m of n equal, the posterior is Beta(m + 1, n - m + 1), and P(similarity >= t) is the binomial
    tail P(X <= m), X ~ Bin(n + 1, t).
    """
    out = {}
    for n in range(batch, total + 1, batch):
        p = 0.0
        for m in range(n + 1):
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= miss:
                out[n] = m
                break
    return out


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(MinHash values, whether the text has a word, digest of the word sequence) of each text."""
    raw = [folded(t) for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    s, e = run_bounds(_IN_WORD[buf])
    doc = np.searchsorted(ends, s, side="right")
    n_words = np.bincount(doc, minlength=len(raw))
    some = n_words > 0
    digests = [hashlib.sha256(b"w" + b" ".join(_WORD.findall(r)) if h else b"t" + t.encode("utf-8", "replace")).digest()[:16] for r, t, h in zip(raw, texts, some)]
    sig = np.zeros((len(raw), BANDS * ROWS), np.uint32)
    if not len(s):
        return sig, some, digests
    h = np.concatenate([span_hashes(buf, s, e), np.zeros(SHINGLE - 1, np.uint64)])
    d = np.concatenate([doc, np.full(SHINGLE - 1, -1)])
    n = len(s)
    x = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        x += np.where(d[k : k + n] == doc, h[k : k + n], 0) * _MIX[k]
    first = np.concatenate(([0], np.cumsum(n_words[some])[:-1]))
    use = d[SHINGLE - 1 : SHINGLE - 1 + n] == doc
    use[first] = True  # a text with fewer words than a shingle is one shingle
    x = mix64(x[use])
    first = np.searchsorted(doc[use], np.flatnonzero(some))
    v = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.multiply(x, _A[k], out=v)
        v += _B[k]
        sig[some, k] = np.minimum.reduceat(v, first) >> np.uint64(32)
    return sig, some, digests


def _signed(batches):
    """Arrow batches of (doc_id, text) to (doc_id, digest, sig, bands); sig has the low byte of each compared value, of which
    equal values have equal ones, so that a look at the posterior prunes no pair that whole values would keep."""
    for b in (part for whole in batches for part in rows_of(whole)):
        texts = b.column(1).to_pylist()
        for lo, hi in batches_of(texts, 600_000):
            sig, some, digests = signatures(texts[lo:hi])
            low = sig[:, :COMPARED].astype(np.uint8)
            band = np.zeros((hi - lo, BANDS), np.uint64)
            for k in range(ROWS):
                band = mix64(band * _MIX[0] + sig[:, k::ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[1])
            band = band.view(np.int64)
            size = some.astype(np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(lo, hi - lo),
                    pa.array(digests, pa.binary()),
                    pa.array([low[i].tobytes() for i in range(hi - lo)], pa.binary()),
                    pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(band[some].ravel())),
                ],
                names=["doc_id", "digest", "sig", "bands"],
            )


def _pruned(batches):
    """Pairs (a, b, sig_a, sig_b) that no look at the posterior prunes."""
    least = least_matches()
    for t in batches:
        if not t.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(t.num_rows, -1) for k in (2, 3))
        alive = np.arange(t.num_rows)
        same = np.zeros(t.num_rows, np.int64)
        for n in sorted(least):
            same[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(1)
            alive = alive[same[alive] >= least[n]]
        yield pa.RecordBatch.from_arrays([t.column(k).take(pa.array(alive)) for k in (0, 1)], names=["a", "b"])


def _verified(batches):
    """Pairs (a, b, text_a, text_b) whose shingle sets have a Jaccard similarity of THRESHOLD or more."""
    last, mine = None, set()
    for t in (part for whole in batches for part in rows_of(whole)):
        a, b, j = [], [], []
        for x, y, tx, ty in zip(*(t.column(k).to_pylist() for k in range(4))):
            if tx != last:
                last, mine = tx, shingles_of(tx)
            other = shingles_of(ty)
            both = len(mine & other)
            s = both / (len(mine) + len(other) - both) if both else 0.0
            if s >= THRESHOLD:
                a.append(x), b.append(y), j.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])


def verify(pairs: DataFrame, signed: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b, jaccard) among candidate pairs (a, b)."""
    sig = signed.select("doc_id", "sig")
    joined = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    alive = scratch.keep(joined.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(_pruned), "a bigint, b bigint").distinct())
    ids = scratch.keep(alive.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    # a's text follows b's, so that many copies of one text don't pile up
    with_b = alive.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return scratch.keep(with_a.select("a", "b", "text_a", "text_b").mapInArrow(tidy(_verified), "a bigint, b bigint, jaccard double"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, keep) of every distinct doc_id: group_id is the least doc_id of its near-duplicates, keep tells that it is this one."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    signed = scratch.keep(texts.where("text IS NOT NULL").mapInArrow(tidy(_signed), "doc_id bigint, digest binary, sig binary, bands array<bigint>"))
    rep = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    # nodes with equal words hang on the least of them; only that one goes into buckets, with this text. A doc_id may
    # hang on another by one of its texts and go into buckets by the others
    same = scratch.keep(signed.select("doc_id", "digest").join(rep, "digest").select("doc_id", "digest", "rep").where("doc_id <> rep").distinct())
    reps = signed.join(same.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    placed = reps.select(F.explode("bands").alias("band"), "doc_id")
    several = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1").select("band", "least")
    shared = scratch.keep(placed.join(several.hint("merge"), "band"))
    # a bucket is told by its figures; of buckets with the same members the least band stands for all
    node = F.xxhash64("doc_id")
    figures = shared.groupBy("band").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.bit_xor(node).alias("x"), F.sum(node.bitwiseAND((1 << 32) - 1)).alias("s"))
    chosen = figures.groupBy("n", "least", "x", "s").agg(F.min("band").alias("band")).select("band")
    members = scratch.keep(shared.join(chosen, "band", "left_semi").distinct())
    first = scratch.keep(members.where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct())
    edges = verify(first, reps, texts, scratch)
    roots = components(edges, scratch)
    rooted = scratch.keep(members.select("band", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root")))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    open_ = rooted.join(split, "band", "left_semi")
    one, two = (open_.select("band", F.col("doc_id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    second = one.hint("merge").join(two, "band").where("a < b AND root_a <> root_b").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    more = verify(scratch.keep(second), reps, texts, scratch)
    all_edges = edges.select("a", "b").unionByName(more.select("a", "b")).unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = components(all_edges, scratch).withColumnRenamed("node", "doc_id")
    out = texts.select("doc_id").distinct().join(roots, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    scratch.drop(signed)
    return out.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one for each group, and rows without a doc_id."""
    gone = groups(docs).where("NOT keep").select("doc_id")
    # rows that share a doc_id are one document: of these the first in the order of its columns' hash stays.
    # grouped and joined by the same key, so texts are moved once
    others = [c for c in docs.columns if c != "doc_id"]
    first = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("row"))
    stay = first.join(gone, "doc_id", "left_anti").select("doc_id", "row.*").select(*docs.columns)
    return stay.unionByName(docs.where("doc_id IS NULL"))
