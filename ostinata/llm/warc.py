"""Content-addressed web archive.

An archive has two tables. `store` keeps each distinct payload once under its SHA-256 digest, with its
length; `headers` keeps each record's header block byte for byte (latin-1 text, so any byte fits) and
the digest of its payload. An original record is header block + payload + CRLF CRLF, rebuilt by a left
join on the digest. The digest is verified twice: storing compares length and a second, independent
hash of all payloads that claim one digest, and rebuilding hashes the stored payload again.

A URL is written with its control characters, spaces and characters beyond ASCII percent-encoded (the url column keeps it as it was), so
a header block is ASCII and no URL can add a line to it. WARC files are read as a stream, member by member if they are compressed, in
batches of records; a file may be empty. What can't be read as WARC (a damaged gzip member, a block without "WARC/", a missing, negative or
non-numeric Content-Length, a file that breaks off) ends with ValueError that names the file.

Defined results: a NULL payload has a NULL digest and nothing in the store, its record is the header
block alone and verified; an empty payload is stored like any other, once; repeated rows and repeated
record ids are records of their own; a payload missing from the store gives a NULL record that isn't
verified; a NULL url is left out of the header block; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.llm.common import table

_END = "\r\n\r\n"


def _safe(url: Column) -> Column:
    """A URL in printable ASCII: other bytes of its UTF-8 form percent-encoded, what is encoded already left as it is."""
    plain = F.rlike(url, F.lit(r"\A[!-~]*\z"))
    encoded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(F.rlike(c, F.lit(r"\A[!-~]?\z")), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")
    return F.when(plain, url).otherwise(encoded)


def header_block(key: Column, url: Column, payload: Column, digest: Column) -> Column:
    """The header block of a resource record. Its record id is a name-based UUID of key and url."""
    m = F.md5(F.concat_ws("|", key.cast("string"), url))
    url = _safe(url)
    uuid = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.coalesce(F.octet_length(payload), F.lit(0)).cast("string")),
    )
    return F.concat(lines, F.lit(_END))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """key, url, header, digest, payload of each page."""
    p = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    return p.withColumn("header", header_block(F.col("key"), F.col("url"), F.col("payload"), F.col("digest"))).select("key", "url", "header", "digest", "payload")


def store(recs: DataFrame) -> DataFrame:
    """digest, length, sound, payload of each distinct payload; sound is false where payloads with one digest differ."""
    second = F.xxhash64("payload")
    return recs.where("payload IS NOT NULL").groupBy("digest").agg(
        F.min(F.octet_length("payload")).cast("bigint").alias("length"),
        ((F.min(second) == F.max(second)) & (F.min(F.octet_length("payload")) == F.max(F.octet_length("payload")))).alias("sound"),
        F.first("payload").alias("payload"),
    )


def headers(recs: DataFrame) -> DataFrame:
    return recs.select("key", "url", "header", "digest")


def rebuild(heads: DataFrame, stored: DataFrame) -> DataFrame:
    """key, url, digest, record, verified of each original record; records of binary payloads are binary."""
    joined = heads.join(stored, "digest", "left")
    binary = dict(stored.dtypes)["payload"] == "binary"
    head, end = (F.encode("header", "ISO-8859-1"), F.lit(_END.encode())) if binary else (F.col("header"), F.lit(_END))
    sound = F.col("sound") & (F.sha2(F.col("payload").cast("binary"), 256) == F.col("digest")) & (F.octet_length("payload") == F.col("length"))
    record = F.when(F.col("digest").isNull(), F.concat(head, end)).otherwise(F.concat(head, "payload", end))
    return joined.select("key", "url", "digest", record.alias("record"), F.when(F.col("digest").isNull(), F.lit(True)).otherwise(F.coalesce(sound, F.lit(False))).alias("verified"))


def write_archive(recs: DataFrame, path: str) -> None:
    store(recs).write.mode("overwrite").parquet(f"{path}/store")
    headers(recs).write.mode("overwrite").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return rebuild(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/store"))



def parse_warc(source: bytes | BinaryIO):
    """(header block as latin-1, payload bytes) of each record of a WARC file, read as a stream; record-wise or whole gzip is undone.

    The header block is kept exactly, with its closing empty line. What can't be read ends with ValueError.
    """
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    if f.read(2) == b"\x1f\x8b":
        f.seek(0)
        f = gzip.GzipFile(fileobj=f)
    else:
        f.seek(0)
    try:
        yield from _records(io.BufferedReader(f, 1 << 20))
    except (EOFError, zlib.error, gzip.BadGzipFile) as e:
        raise ValueError(f"damaged gzip: {e}") from e


def _records(f: BinaryIO):
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with WARC/")
        block, length = [line], None
        while True:
            line = f.readline()
            if not line:
                raise ValueError("the file ends within a header block")
            block.append(line)
            if line in (b"\r\n", b"\n"):
                break
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                if not value.strip().isdigit():
                    raise ValueError(f"Content-Length is {value.strip()!r}")
                length = int(value)
        if length is None:
            raise ValueError("a record has no Content-Length")
        payload = f.read(length)
        if len(payload) < length:
            raise ValueError("the file ends within a payload")
        yield b"".join(block).decode("latin-1"), payload


#: Bytes of payload, and records, in a batch that a reading task hands over.
BATCH_BYTES, BATCH_RECORDS = 16 << 20, 1000


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (key = file name and number, header, digest, payload binary) of the WARC files at a path, one task to a file or more files.

    Files are streamed by the workers through pyarrow's file systems; where these can't open a file's scheme, its bytes are handed over by Spark whole (up to 2 GB).
    """

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                heads, payloads, size, first = [], [], 0, 0

                def batch():
                    return pa.RecordBatch.from_arrays([pa.array([f"{name}#{first + i}" for i in range(len(heads))]), pa.array(heads), pa.array(payloads, pa.binary())], names=["key", "header", "payload"])

                source = data if data is not None else _open(name)
                try:
                    for head, payload in parse_warc(source):
                        heads.append(head), payloads.append(payload)
                        size += len(payload)
                        if size >= BATCH_BYTES or len(heads) >= BATCH_RECORDS:
                            yield batch()
                            first, heads, payloads, size = first + len(heads), [], [], 0
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                if heads:
                    yield batch()

    files = spark.read.format("binaryFile").load(path)
    sample = files.select("path").first()
    streamed = sample is None or _opens(sample["path"])
    files = files.select("path", (F.lit(None).cast("binary") if streamed else F.col("content")).alias("content"))
    return files.mapInArrow(run, "key string, header string, payload binary").select("key", F.lit(None).cast("string").alias("url"), "header", F.sha2("payload", 256).alias("digest"), "payload")


def _open(name: str) -> BinaryIO:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", name))
    return system.open_input_file(path)


def _opens(name: str) -> bool:
    try:
        _open(name).close()
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


def to_bytes(header: str, payload: bytes | None) -> bytes:
    """A record as it stands in a file."""
    return header.encode("latin-1") + (payload or b"") + _END.encode()


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages archived and rebuilt."""
    recs = records(table(spark, sf_dir, "pages"))
    return rebuild(headers(recs), store(recs)).withColumnRenamed("key", "page_id")


OP1_SQL = """
WITH p AS (SELECT page_id, url, html, sha256(html) AS digest, md5(concat_ws('|', CAST(page_id AS VARCHAR), url)) AS m FROM pages)
SELECT page_id, url, digest,
  concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: resource',
    'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>',
    'WARC-Target-URI: ' || url, 'WARC-Payload-Digest: sha256:' || digest, 'Content-Type: text/html; charset=utf-8',
    'Content-Length: ' || CAST(coalesce(octet_length(encode(html)), 0) AS VARCHAR))
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
  true AS verified
FROM p
"""
