"""Mixing sources to target weights in fixed-length token blocks.

Tokens are ids of the byte-pair vocabulary; a separator (the ids of an empty line) follows each document. Each
task of the scan lays the documents of a source end to end, in the table's order, and cuts them into
blocks of exactly `length` ids; only its last block of a source may be shorter. So packing moves nothing and a hot source
is packed by all tasks; blocks are written once, and a block's index counts through its source's
tasks. For each output shard of `shard_slots` slots a
multinomial draw says how many slots each source gets; the n-th slot of a source over all shards takes
block permutation(n mod blocks), under another permutation for each pass over the source; permutations
are keyed Feistel networks with cycle walking, so no index table exists. Blocks are joined by index: the join is made on
block numbers first, so the blocks' contents move one time.

Target weights: given by source, or else the sources' token counts to the power `temper`, scaled to 1.
The number of slots is that of all blocks unless given.

A block's text holds the characters that begin within it: a character whose bytes are cut by a block's end belongs wholly
to that block, so texts of neighbouring blocks join without loss.

Defined results: texts that are NULL or empty yield nothing; a NULL source is the source ''; a NULL language is '';
repeated rows are packed as often as they occur; sources with weight 0 or without tokens get no slot;
without any weight on a source with tokens the result is empty; other columns are ignored. A block's
doc_ids are the distinct documents that it holds tokens of, in order. Which documents share a block follows from how the
table is split into tasks; ids, texts and weights don't depend on the numbers of executors or lost tasks.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinata.llm.bpe import MEMORY, STEP_CHARS, VOCABULARY, encoder, piece_encoder, ranks
from ostinata.llm.common import Scratch, batches_of, rows_of, table, tidy
from ostinata.llm.words import Numbers

LENGTH = 512
SHARD_SLOTS = 4096
TEMPER = 0.7
SEED = 20240229
SEPARATOR = "\n\n"


def permuted(index: np.ndarray, size: int, key: bytes) -> np.ndarray:
    """A pseudorandom permutation of range(size), at index: a balanced Feistel network, walked until it falls below size."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.sha256(key).digest(), np.uint64)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in range(6):
            f = (right + keys[k % 4] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo[todo] = x[todo] >= size
    return x.astype(np.int64)


class _Stream:
    """The ids of one source in one task that no block holds yet, and where its documents begin in them."""

    def __init__(self):
        self.ids = np.zeros(0, np.int32)
        self.starts: list[int] = []
        self.docs: list = []
        self.langs: list[str] = []
        self.seq = 0

    def add(self, ids: np.ndarray, sizes: list[int], docs: list, langs: list[str]) -> None:
        at = len(self.ids) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.ids = np.concatenate([self.ids, ids])
        self.starts += at.tolist()
        self.docs += docs
        self.langs += langs

    def cut(self, length: int, pieces: list[bytes], open_: np.ndarray, width: type, all_: bool = False):
        """(number, language, size, packed ids, the bytes that its last character lacks, documents) of each block that is full, or of all. open_: ids whose piece doesn't end in ASCII."""
        n = -(-len(self.ids) // length) if all_ else len(self.ids) // length
        if not n:
            return
        starts = np.array(self.starts)
        a = np.arange(n) * length
        b = np.minimum(a + length, len(self.ids))
        first, last = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b)
        packed = self.ids[: b[-1]].astype(width).tobytes()
        size = width().itemsize
        for lo, hi, i, j, maybe in zip(a.tolist(), b.tolist(), first.tolist(), last.tolist(), open_[self.ids[b - 1]].tolist()):
            tail = b""
            if maybe and (lacks := _lacking(b"".join([pieces[k] for k in self.ids[max(lo, hi - 4) : hi].tolist()]))):
                tail = b"".join([pieces[k] for k in self.ids[hi : hi + lacks].tolist()])[:lacks]
            yield self.seq, self.langs[i], hi - lo, packed[lo * size : hi * size], tail, list(dict.fromkeys(self.docs[i:j]))
            self.seq += 1
        done = int(b[-1])
        keep = max(0, int(np.searchsorted(starts, done, side="right")) - 1) if done < len(self.ids) else len(starts)
        self.ids = self.ids[done:].copy()
        self.starts = np.maximum(starts[keep:] - done, 0).tolist()
        self.docs, self.langs = self.docs[keep:], self.langs[keep:]


def _lacking(data: bytes) -> int:
    """How many bytes the last UTF-8 character of data lacks."""
    for back in range(1, min(4, len(data)) + 1):
        c = data[-back]
        if c < 0x80:
            return 0
        if c >= 0xC0:
            return max(0, (2 if c < 0xE0 else 3 if c < 0xF0 else 4) - back)
    return 0


def text_of(ids: list[int], tail: bytes, pieces: list[bytes]) -> str:
    """The characters that begin within a block."""
    data = b"".join([pieces[i] for i in ids])
    begin = 0
    while begin < len(data) and 0x80 <= data[begin] < 0xC0:
        begin += 1
    return (data[begin:] + tail).decode("utf-8", "replace")


def _by_id(vocabulary: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece
    return out


def _width(vocabulary: dict[bytes, int]) -> type:
    return np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32


def _packed(length: int, vocabulary: dict[bytes, int]):
    """Arrow batches of (doc_id, text, lang, source) to the blocks of one task."""

    def run(batches):
        encode, pieces, width = piece_encoder(vocabulary), _by_id(vocabulary), _width(vocabulary)
        open_ = np.array([p[-1:] >= b"\x80" for p in pieces])
        task = TaskContext.get().partitionId()
        separator = np.array(encoder(vocabulary).encode_ordinary(SEPARATOR), np.int32)
        streams: dict[str, _Stream] = {}
        numbers, flat, begin, size = Numbers(), *[np.zeros(0, np.int32)] * 3  # the ids of all words met, where each word's begin, how many they are

        def rows(some: list[str], all_: bool = False):
            done = [(source, *x) for source in some for x in streams[source].cut(length, pieces, open_, width, all_)]
            if done:
                source, seq, lang, sizes, ids, tail, docs = zip(*done)
                columns = [(pa.array(source), "source"), (pa.array([task] * len(done), pa.int64()), "task"), (pa.array(seq, pa.int64()), "seq"), (pa.array(lang), "lang"), (pa.array(sizes, pa.int32()), "n_tokens"), (pa.array(ids, pa.binary()), "ids"), (pa.array(tail, pa.binary()), "tail"), (pa.array(docs, pa.list_(pa.int64())), "doc_ids")]
                yield pa.RecordBatch.from_arrays([c for c, _ in columns], names=[n for _, n in columns])

        for b in (part for whole in batches for part in rows_of(whole, 2000)):
            docs, texts, langs, sources = (b.column(c).to_pylist() for c in range(4))
            for lo, hi in batches_of(texts, STEP_CHARS):
                if len(numbers) > MEMORY or len(numbers.point) > 16 * MEMORY:
                    numbers, flat, begin, size = Numbers(), *[np.zeros(0, np.int32)] * 3
                code, words, counts = numbers.of(texts[lo:hi])
                coded = [encode(w) for w in words]
                more = np.fromiter(map(len, coded), np.int32, len(coded))
                begin = np.concatenate([begin, len(flat) + np.cumsum(more, dtype=np.int32) - more])
                flat = np.concatenate([flat, np.fromiter(chain.from_iterable(coded), np.int32, int(more.sum()))])
                size = np.concatenate([size, more])
                n = size[code]
                ids = flat[np.repeat(begin[code] - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(int(n.sum()), dtype=np.int32)]
                edges = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
                mine: dict[str, list[int]] = {}
                for i, s in enumerate(sources[lo:hi]):
                    mine.setdefault(s, []).append(i)
                for s, at in mine.items():
                    stream = streams.setdefault(s, _Stream())
                    parts = [x for i in at for x in (ids[edges[i] : edges[i + 1]], separator)]
                    stream.add(np.concatenate(parts), [int(edges[i + 1] - edges[i]) + len(separator) for i in at], [docs[lo + i] for i in at], [langs[lo + i] for i in at])
                yield from rows(list(mine))
        rest = list(streams)
        for lo in range(0, len(rest), 500):
            yield from rows(rest[lo : lo + 500], True)

    return run


def _opened(vocabulary: dict[bytes, int], others: int, as_text: bool):
    """The last two columns, packed ids and tail, to ids or text."""

    def run(batches):
        pieces, width = _by_id(vocabulary), _width(vocabulary)
        for b in (part for whole in batches for part in rows_of(whole, 2000)):
            packed = b.column(others).to_pylist()
            if as_text:
                last = pa.array([text_of(np.frombuffer(x, width).tolist(), tail, pieces) for x, tail in zip(packed, b.column(others + 1).to_pylist())], pa.string())
            else:
                offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed))))) // width().itemsize
                last = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(np.frombuffer(b"".join(packed), width).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:others], last], names=[*b.schema.names[:others], "text" if as_text else "ids"])

    return run


def target_weights(tokens: dict[str, int], weights: dict[str, float] | None = None, temper: float = TEMPER) -> dict[str, float]:
    raw = {s: (n**temper if weights is None else float(weights.get(s, 0))) for s, n in tokens.items() if n > 0}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()} if total > 0 else {}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, slots: int | None = None, seed: int = SEED, path: str = VOCABULARY, as_text: bool = False) -> DataFrame:
    """shard, slot, source, epoch, block, lang, n_tokens, doc_ids and ids, or text instead, of each output slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    vocabulary = ranks(path)
    none = F.lit("")
    laid = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), none).alias("lang"), F.coalesce(F.col("source").cast("string"), none).alias("source")).where("text <> ''")
    blocks = scratch.keep(laid.mapInArrow(tidy(_packed(length, vocabulary)), "source string, task bigint, seq bigint, lang string, n_tokens int, ids binary, tail binary, doc_ids array<bigint>"))
    # one row for each source and task; all block numbers hang on it
    counts = scratch.keep(blocks.groupBy("source", "task").agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens")))
    ahead = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    based = counts.withColumn("base", F.coalesce(F.sum("blocks").over(ahead), F.lit(0)))
    numbered_ = based.select("source", "task", "base", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("seq")).select("source", "task", "seq", (F.col("base") + F.col("seq")).alias("index"))
    # one row for each source: the components of the mixture
    rows = {r["source"]: (r["tokens"], r["blocks"]) for r in counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("blocks").alias("blocks")).collect()}
    share = target_weights({s: n for s, (n, _) in rows.items()}, weights, temper)
    names = sorted(share)
    p = np.array([share[s] for s in names])
    sizes = [rows[s][1] for s in names]
    total = sum(b for _, b in rows.values()) if slots is None else slots
    total = total if names else 0
    n_shards = -(-total // shard_slots)

    def drawn(shard: int) -> np.ndarray:
        rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
        return rng.multinomial(min(shard_slots, total - shard * shard_slots), p / p.sum())

    def counted(batches):
        for b in batches:
            shard, source, n = [], [], []
            for s in b.column(0).to_pylist():
                for k, c in enumerate(drawn(s)):
                    shard.append(s), source.append(k), n.append(int(c))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(source, pa.int32()), pa.array(n, pa.int64())], names=["shard", "component", "n"])

    def slotted(batches):
        for b in batches:
            for s, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = {d["component"]: d["first"] for d in starts}
                counts_ = drawn(s)
                component = np.repeat(np.arange(len(names)), counts_)
                ordinal = np.concatenate([first[k] + np.arange(c) for k, c in enumerate(counts_)]) if len(component) else np.zeros(0, np.int64)
                slot = np.random.Generator(np.random.Philox(key=[seed + 1, s])).permutation(len(component))
                epoch, at = np.zeros(len(component), np.int64), np.zeros(len(component), np.int64)
                for k in np.unique(component):
                    mine = np.flatnonzero(component == k)
                    epoch[mine] = ordinal[mine] // sizes[k]
                    for e in np.unique(epoch[mine]):
                        now = mine[epoch[mine] == e]
                        at[now] = permuted(ordinal[now] % sizes[k], sizes[k], f"{seed}/{names[k]}/{e}".encode())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), s)), pa.array(slot), pa.array([names[k] for k in component], pa.string()), pa.array(epoch), pa.array(at)], names=["shard", "slot", "source", "epoch", "index"])

    shards = spark.range(n_shards).withColumnRenamed("id", "shard")
    draws = shards.mapInArrow(counted, "shard bigint, component int, n bigint")
    before = W.partitionBy("component").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = draws.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("shard").agg(F.collect_list(F.struct("component", "first")).alias("starts"))
    # a shard's row becomes shard_slots rows, so the number of tasks isn't left to the rows' size
    places = starts.repartition(max(1, -(-n_shards // 16)), "shard").mapInArrow(slotted, "shard bigint, slot bigint, source string, epoch bigint, index bigint")
    # the optimizer can't foresee how many slots a shard's row becomes, so the joins' kind isn't left to it
    placed = places.join(numbered_.hint("merge"), ["source", "index"]).join(blocks.hint("merge"), ["source", "task", "seq"])
    columns = ["shard", "slot", "source", "epoch", "block", "lang", "n_tokens", "doc_ids"]
    kinds = "shard bigint, slot bigint, source string, epoch bigint, block bigint, lang string, n_tokens int, doc_ids array<bigint>, " + ("text string" if as_text else "ids array<int>")
    return placed.withColumnRenamed("index", "block").select(*columns, "ids", "tail").mapInArrow(tidy(_opened(vocabulary, len(columns), as_text)), kinds)


def as_documents(mixed: DataFrame) -> DataFrame:
    """Slots, mixed as text, with the columns of documents: the doc_id and language of the document that a block begins in."""
    return mixed.select(F.col("doc_ids")[0].alias("doc_id"), "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
