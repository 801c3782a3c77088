"""Byte-pair encoding through a distinct-word table, and decoding through an id-to-piece join.

Texts are split into words by the vocabulary's published pattern. A chunk of documents numbers its
distinct words and keeps each document as the numbers of its words in order. Words of all chunks meet
by hash, where each distinct word is encoded once; the ids return to their chunks and are joined to the
documents' words by position. Neither texts nor single occurrences are shuffled, nor are packed documents: they
lie in a table bucketed by chunk, and only a chunk's words travel, once each.

Memory: a chunk is bounded by CHUNK_CHARS (or one text, if that is longer), and the words of a hash part are
streamed, so `parts` bounds the time of a task; raise it with the corpus. A part's table keeps MEMORY words in memory
and further ones in a file of its task, so none is encoded twice.

Defined results: a NULL text has NULL ids, an empty one none; each row is encoded by itself, so
repeated rows and NULL or repeated doc_ids are as good as others; other columns than those asked for
are ignored. Control strings in a text are ordinary text: no reserved id is ever produced.
"""

from __future__ import annotations

import base64
import os
import sqlite3
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ostinata.llm.common import Scratch, batches_of, rows_of, table, tidy
from ostinata.llm.words import PATTERN, numbered

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of text in a chunk, about, and in a step of its splitting.
CHUNK_CHARS, STEP_CHARS = 24_000_000, 1_500_000
#: Tokens that are joined with their pieces at a time; a longer text is joined whole.
STEP_TOKENS = 1_000_000
#: Hash parts of the distinct words.
PARTS = 256
#: Distinct words that a part keeps in memory; further ones are in a file.
MEMORY = 1_000_000


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(vocabulary: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})


def piece_encoder(vocabulary: dict[bytes, int]):
    """A function from a word, which needs no splitting any more, to its ids."""
    whole = encoder(vocabulary)
    core = getattr(whole, "_core_bpe", None)
    single = getattr(core, "encode_single_piece", None)
    return (lambda w: single(w.encode())) if single else whole.encode_ordinary


_PACKED = ("sizes", "numbers", "lengths", "words", "steps")


def _tight(a: np.ndarray) -> bytes:
    """Whole numbers below 2**32 by byte planes, compressed: most upper planes are all but empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.asarray(a).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _loose(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _split(parts: int, kept_type: pa.DataType):
    """Arrow batches of (text, kept columns) to chunk rows.

    part -1: documents in order, the first of which is the row-th; sizes are their counts of words + 1 (0 for NULL), numbers their words, the commonest word's is 0.
    part p: the distinct words of hash part p; lengths are their byte lengths, words their bytes, steps the differences of their numbers.
    """
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        chunk, chars = task << 20, 0
        known: dict[str, int] = {}
        steps: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush():
            counts = np.zeros(len(known), np.int64)
            for _, numbers, _ in steps:
                counts += np.bincount(numbers, minlength=len(known))
            rank = np.empty(len(known), np.uint32)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(known), dtype=np.uint32)
            row = 0
            for sizes, numbers, mine in steps:
                yield chunk_row(-1, row, mine, sizes=_tight(sizes), numbers=_tight(rank[numbers]))
                row += len(sizes)
            raw = [w.encode() for w in known]
            part = np.fromiter((zlib.crc32(w) % parts for w in raw), np.int64, len(raw))
            order = np.lexsort((rank, part))
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                at = order[edges[p] : edges[p + 1]]
                ws = [raw[i] for i in at]
                yield chunk_row(int(p), 0, None, lengths=_tight(np.fromiter(map(len, ws), np.uint32, len(ws))), words=pack(b"".join(ws)), steps=_tight(np.diff(rank[at], prepend=np.uint32(0))))

        def chunk_row(part, row, mine, **packed):
            lists = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine) if mine is not None else pa.nulls(1, pa.list_(kept_type))
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([row], pa.int64()), *[pa.array([packed.get(c)], pa.binary()) for c in _PACKED], lists], names=["chunk", "part", "row", *_PACKED, "kept"])

        for b in (part for whole in batches for part in rows_of(whole, 2000)):
            mine = pa.StructArray.from_arrays([b.column(k).cast(f.type) for k, f in zip(range(1, b.num_columns), kept_type)], fields=list(kept_type))
            texts = b.column(0).to_pylist()
            for lo, hi in batches_of([t or "" for t in texts], STEP_CHARS):
                some = texts[lo:hi]
                code, words, counts = numbered([t or "" for t in some])
                number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
                there = np.fromiter((t is not None for t in some), bool, len(some))
                steps.append((np.where(there, counts + 1, 0).astype(np.uint32), number[code] if len(words) else np.zeros(0, np.uint32), mine.slice(lo, hi - lo)))
                chars += sum(len(t) for t in some if t is not None)
                if chars >= CHUNK_CHARS or sum(len(x[0]) for x in steps) >= 1 << 20:
                    yield from flush()
                    chunk, chars, known, steps = chunk + 1, 0, {}, []
        if steps:
            yield from flush()

    return run


class _Distinct:
    """A task's table of distinct words and their ids: up to MEMORY words in memory, further ones in a file."""

    def __init__(self, encode):
        self.encode = encode
        self.near: dict[bytes, list[int]] = {}
        self.folder = self.file = None

    def _far(self, words: list[bytes]) -> dict[bytes, list[int]]:
        if self.file is None:
            self.folder = tempfile.TemporaryDirectory(prefix="ostinata-words-")
            self.file = sqlite3.connect(os.path.join(self.folder.name, "words"), isolation_level=None)
            self.file.execute("PRAGMA journal_mode = OFF")
            self.file.execute("PRAGMA synchronous = OFF")
            self.file.execute("CREATE TABLE words (word BLOB PRIMARY KEY, ids BLOB) WITHOUT ROWID")
        out = {}
        for a in range(0, len(words), 500):
            some = words[a : a + 500]
            for w, ids in self.file.execute(f"SELECT word, ids FROM words WHERE word IN ({','.join('?' * len(some))})", some):
                out[w] = np.frombuffer(ids, np.int32).tolist()
        new = {w: self.encode(w.decode()) for w in words if w not in out}
        self.file.execute("BEGIN")
        self.file.executemany("INSERT INTO words VALUES (?, ?)", ((w, np.array(ids, np.int32).tobytes()) for w, ids in new.items()))
        self.file.execute("COMMIT")
        return out | new

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of some different words."""
        near = self.near
        others = []
        for w in words:
            if w not in near:
                if len(near) < MEMORY:
                    near[w] = self.encode(w.decode())
                else:
                    others.append(w)
        if not others:
            return [near[w] for w in words]
        far = self._far(others)
        return [near[w] if w in near else far[w] for w in words]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.folder.cleanup()


def _encode_parts(vocabulary: dict[bytes, int]):
    """Words by hash part, streamed: each distinct word is encoded once; the numbers' steps, id counts and ids by chunk."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        distinct = _Distinct(piece_encoder(vocabulary))
        try:
            for b in batches:
                sizes, ids = [], []
                for lengths, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    data = unpack(packed)
                    ends = np.cumsum(_loose(lengths).astype(np.int64)).tolist()
                    out = distinct.ids_of([data[lo:hi] for lo, hi in zip([0, *ends], ends)])
                    sizes.append(_tight(np.fromiter(map(len, out), np.uint32, len(out))))
                    ids.append(_tight(np.array([i for x in out for i in x], np.uint32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "steps", "sizes", "ids"])
        finally:
            distinct.close()

    return run


def _place(documents: pa.Table, maps: pa.Table) -> pa.Table:
    """The ids of a chunk's words put at the words' positions in its documents."""
    nos = np.concatenate([np.cumsum(_loose(x), dtype=np.int64) for x in maps.column("steps").to_pylist()] or [np.zeros(0, np.int64)])
    sizes, ids = (np.concatenate([_loose(x) for x in maps.column(k).to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64) for k in ("sizes", "ids"))
    size, begin = np.zeros(len(nos), np.int64), np.zeros(len(nos), np.int64)
    size[nos] = sizes
    begin[nos] = np.cumsum(sizes) - sizes
    ids = ids.astype(np.int32)
    keys, kept, lists = [], [], []
    for chunk, row, counts, packed, mine in zip(*(documents.column(c).to_pylist() if c != "kept" else documents.column(c).combine_chunks() for c in ("chunk", "row", "sizes", "numbers", "kept"))):
        words = _loose(packed)
        counts = _loose(counts).astype(np.int64)
        n = size[words]
        values = ids[np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        # ids before each document's words
        ahead = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(np.maximum(counts - 1, 0))))]
        offsets = pa.array(ahead.astype(np.int32), mask=np.append(counts == 0, False))
        lists.append(pa.ListArray.from_arrays(offsets, pa.array(values)))
        keys.append(chunk * (1 << 24) + row + np.arange(len(counts)))
        kept.append(mine.values)
    if not keys:
        return pa.table({"row_key": pa.array([], pa.int64()), "kept": pa.array([], documents.schema.field("kept").type.value_type), "ids": pa.array([], pa.list_(pa.int32()))})
    return pa.table({"row_key": pa.array(np.concatenate(keys)), "kept": pa.chunked_array(kept), "ids": pa.chunked_array(lists)})


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY, parts: int = PARTS) -> DataFrame:
    """row_key, the kept columns, ids array<int>, n_tokens of every row. row_key is unique."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    chosen = docs.select(F.col(text).cast("string").alias("_t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = [chosen.schema[f"k{i}"].dataType for i in range(len(keep))]
    kept = "struct<" + ", ".join(f"k{i}: {k.simpleString()}" for i, k in enumerate(kinds)) + ">"
    kept_type = pa.struct([pa.field(f"k{i}", to_arrow_type(k)) for i, k in enumerate(kinds)])
    split = chosen.mapInArrow(tidy(_split(parts, kept_type)), f"chunk bigint, part int, row bigint, {', '.join(f'{c} binary' for c in _PACKED)}, kept array<{kept}>")
    split = scratch.keep_bucketed(split, "chunk")
    words = split.where("part >= 0").select("part", "chunk", "lengths", "words", "steps").repartition("part").select("chunk", "lengths", "words", "steps")
    maps = words.mapInArrow(tidy(_encode_parts(ranks(path))), "chunk bigint, steps binary, sizes binary, ids binary")
    placed = split.where("part < 0").select("chunk", "row", "sizes", "numbers", "kept").groupBy("chunk").cogroup(maps.groupBy("chunk")).applyInArrow(_place, f"row_key bigint, kept {kept}, ids array<int>")
    return placed.select("row_key", *[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "ids", F.size("ids").alias("n_tokens")).withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.col("n_tokens")))


def pieces(path: str = VOCABULARY) -> tuple[np.ndarray, pa.BinaryArray]:
    """The vocabulary's table of ids and pieces, as the row of each id (-1: none) and the pieces by row; its size is that of the vocabulary file, whatever the corpus."""
    vocabulary = ranks(path)
    row = np.full(max(vocabulary.values(), default=-1) + 2, -1, np.int64)
    row[list(vocabulary.values())] = np.arange(len(vocabulary))
    return row, pa.array(list(vocabulary), pa.binary())


def _joined(path: str):
    """Arrow batches of (key, ids) to (key, text), joining each id with its piece in steps of tokens."""

    def run(batches):
        row, piece = pieces(path)
        for b in batches:
            lists = b.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            for lo, hi in batches_of([range(n) for n in sizes.tolist()], STEP_TOKENS):
                ids = flat[ends[lo] : ends[hi]]
                at = row[np.where((ids >= 0) & (ids < len(row)), ids, -1).astype(np.int64)]  # the last row is no id's
                found = piece.take(pa.array(at, mask=at < 0))
                starts = np.frombuffer(found.buffers()[1], np.int32)[: len(ids) + 1][ends[lo : hi + 1] - ends[lo]] if len(ids) else np.zeros(hi - lo + 1, np.int32)
                text = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(starts.tobytes()), found.buffers()[2] or pa.py_buffer(b"")]).cast(pa.string())
                mine = lists.slice(lo, hi - lo)
                if mine.null_count:
                    text = pc.if_else(mine.is_valid(), text, pa.nulls(hi - lo, pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), text], names=["key", "text"])

    return run


def decode(encoded: DataFrame, key: str = "row_key", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(key, text) of every row, by a join of ids with the pieces; an id without a piece gives nothing. NULL ids give a NULL text; keys may repeat.

    A broadcast join: each task has the table of pieces, whose size is fixed, and joins its rows' tokens in place, so that
    none is shuffled, sorted or grouped by row.
    """
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(_joined(path)), f"key {kind}, text string").withColumnRenamed("key", key)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).drop("row_key")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts, encoded and decoded."""
    return decode(encode(table(spark, sf_dir, "documents")), "doc_id")
