"""Schemas of the collection model, and its rule for absent values.

NULL, '' and 0 all mean "absent" on read; absent is written as NULL, which JSON output leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FEATURES = _struct(bpm=_D, gain=_D, source=_S)
LIST_TRACK = _struct(title=_S, artist=_S, album=_S, durationMs=_I, isrc=_S, ids=T.MapType(_S, _S), features=FEATURES)
LIST_DOC = _struct(name=_S, tracks=T.ArrayType(LIST_TRACK))
TRACK = _struct(title=_S, artists=T.ArrayType(_S), album=_S, duration_ms=_I, isrc=_S, source_id=_S, source_uri=_S)
PLAYLIST = _struct(name=_S, description=_S, kind=_S, owner_id=_S, source_id=_S, tracks=T.ArrayType(TRACK))
SNAPSHOT = _struct(pulled_at=T.TimestampType(), user_id=_S, playlists=T.ArrayType(PLAYLIST))
MATCH = _struct(track=TRACK, target_id=_S, confidence=_S, method=_S, note=_S)
CATALOG = _struct(id=_S, title=_S, artist=_S, album=_S, duration_ms=_I, isrc=_S)
FEATURE_CATALOG = _struct(id=_I, title=_S, artist=_S, album=_S, duration_sec=T.IntegerType(), isrc=_S, bpm=_D, gain=_D)
IMPORTED = _struct(title=_S, artist=_S, album=_S, duration_ms=_I, isrc=_S, service=_S, service_id=_S)
REFS = _struct(playlist_id=_S, title=_S, artist=_S)
STATE = _struct(name=_S, target_id=_S, added_ids=T.ArrayType(_S), done=_B, adopted=_B)

KINDS = ("owned", "followed", "liked_songs")
CONFIDENCES = ("exact", "high", "low", "none")
METHODS = ("isrc", "search", "none")


def absent(c: Column | str) -> Column:
    """Whether a string is absent."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def present(c: Column | str) -> Column:
    return ~absent(c)


def text_or_null(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def number_or_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, c)
