"""Text functions of the collection model as Column expressions; all stay in the JVM, but lab_norm of texts with rare characters.

An absent (NULL) string is read as ''. Three kinds of folding are kept apart: `normalize` deletes
punctuation, `slugify` turns it into '-', `lab_norm` turns it into spaces and drops accents.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Text = Column | str
DURATION_TOLERANCE_MS = 2500
HIGH, LOW = 0.85, 0.55
SEPARATORS = (" — ", " | ", " - ")


def _s(c: Text) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_s(c), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def normalize(c: Text) -> Column:
    """Lower case letters and numbers, words one space apart; other characters vanish and join what they stood between."""
    kept = F.regexp_replace(F.lower(_s(c)), r"[^\p{L}\p{N}\p{IsWhite_Space}]", "")
    return F.trim(F.regexp_replace(kept, r"\p{IsWhite_Space}+", " "))


def clean_title(c: Text) -> Column:
    """Without a version: cut at the first ' - ', then at the last ' (' before a final ')'."""
    c = _s(c)
    cut = F.when(F.instr(c, " - ") > 1, F.substring_index(c, " - ", 1)).otherwise(c)
    return strip(F.regexp_replace(cut, r"(?s)^(.+) \(.*\)\z", "$1"))


def track_key(c: Text) -> Column:
    """The identity of a recording by base title."""
    return normalize(clean_title(c))


def title_score(source: Text, candidate: Text) -> Column:
    """1 for equal titles, 0.95 once the source's version is cut off, 0.8 where one begins with the other, else 0."""
    return title_score_normalized(normalize(source), track_key(source), normalize(candidate))


def title_score_normalized(source: Column, source_key: Column, candidate: Column) -> Column:
    return (
        F.when(source == candidate, F.lit(1.0))
        .when(source_key == candidate, F.lit(0.95))
        .when((candidate != "") & (F.startswith(source, candidate) | F.startswith(candidate, source)), F.lit(0.8))
        .otherwise(F.lit(0.0))
    )


def contains_norm(hay: Text, needle: Text) -> Column:
    n = normalize(needle)
    return F.when((n != "") & F.contains(normalize(hay), n), F.lit(1.0)).otherwise(F.lit(0.0))


def match_score(title: Column, artist: Column, near: Column) -> Column:
    """Weighted sum of title score, artist containment and duration closeness, as doubles."""
    return F.lit(0.5) * title + F.lit(0.35) * artist + F.lit(0.15) * F.when(near, F.lit(1.0)).otherwise(F.lit(0.0))


def band(score: Column) -> Column:
    return F.when(score >= F.lit(HIGH), F.lit("high")).when(score >= F.lit(LOW), F.lit("low")).otherwise(F.lit("none"))


def duration_delta(a: Text, b: Text) -> Column:
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0)) for x in (a, b))
    return F.abs(a - b)


def match_key(isrc: Text, title: Text, artists: Text) -> Column:
    """'isrc:' and the code where there is one, else 'tt:' title and all artists."""
    code = _s(isrc)
    names = F.col(artists) if isinstance(artists, str) else artists
    return F.when(code != "", F.concat(F.lit("isrc:"), F.upper(code))).otherwise(F.concat(F.lit("tt:"), normalize(title), F.lit("|"), normalize(F.array_join(F.coalesce(names, F.array().cast("array<string>")), " "))))


def ref_key(title: Text, artist: Text) -> Column:
    return F.concat(normalize(title), F.lit("|"), normalize(artist))


def slugify(c: Text) -> Column:
    dashed = F.regexp_replace(F.lower(_s(c)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("playlist"))


def split_title(line: Text) -> Column:
    """struct(title, artist) of a hand-written line; the first separator in SEPARATORS that isn't at the start splits it."""
    line = _s(line)
    out = F.struct(line.alias("title"), F.lit("").alias("artist"))
    for sep in reversed(SEPARATORS):
        at = F.instr(line, sep)
        cut = F.struct(strip(F.substring(line, F.lit(1), at - 1)).alias("title"), strip(F.substring(line, at + len(sep), F.length(line))).alias("artist"))
        out = F.when(at > 1, cut).otherwise(out)
    return out


def comma_list(c: Text) -> Column:
    return F.filter(F.transform(F.split(_s(c), ","), strip), lambda x: x != "")


def artists_overlap(a: Column, b: Column) -> Column:
    """Whether one of two normalised names contains the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def join_artists(c: Text) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, ", ")


def truncate(c: Text, n: int) -> Column:
    """At most n characters; a cut text ends in an ellipsis."""
    c = _s(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def lab_norm_text(s: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", s or "").lower() if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^0-9a-z\s]", " ", plain)).strip()


@F.pandas_udf(T.StringType())
def _lab_norm(s: pd.Series) -> pd.Series:
    return s.map(lab_norm_text)


@F.pandas_udf(T.StringType())
def _lab_norm_some(s: pd.Series) -> pd.Series:
    return s.map(lab_norm_text, na_action="ignore")


#: Stands for a character that becomes several letters or digits; a text that has it anyway is looked at closer, no more.
_SEVERAL = "\ue000"


@functools.cache
def _folds() -> tuple[str, str]:
    """Arguments of translate: characters that become one ASCII letter or digit, or _SEVERAL, and after these the ones that vanish.

    lab_norm_text reads each character by itself, as reordered marks vanish. All characters that aren't here become spaces.
    """
    one, several, none = {}, [], []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        kept = re.sub(r"[^0-9a-z]", " ", plain)
        if not plain:
            none.append(c)
        elif kept.strip():
            if len(kept) == 1:
                one[c] = kept
            else:
                several.append(c)
    return "".join([*one, *several, *none]), "".join(one.values()) + _SEVERAL * len(several)


def lab_norm(c: Text) -> Column:
    """Accents dropped, then only ASCII letters, digits and single spaces. Only texts with a character that becomes several letters (a ligature, a fraction) go to Python."""
    s = _s(c)
    ascii_ = F.rlike(s, F.lit(r"\A\p{ASCII}*\z"))
    folded = F.translate(s, *_folds())
    plain = F.trim(F.regexp_replace(F.lower(F.when(ascii_, s).otherwise(folded)), r"[^0-9a-z]+", " "))
    return F.coalesce(_lab_norm_some(F.when(~ascii_ & F.contains(folded, F.lit(_SEVERAL)), s)), plain)


def lab_key(title: Text, artist: Text) -> Column:
    return F.concat(lab_norm(title), F.lit("|"), lab_norm(artist))


def curated_name(seed: Text) -> Column:
    return F.concat(F.lit("Around "), _s(seed))


def register(spark: SparkSession) -> None:
    """The functions by name in SQL: JVM ones as temporary SQL functions, lab_norm as a vectorised UDF."""
    white = r"\\p{IsWhite_Space}"
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION norm_text(s STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(lower(coalesce(s, '')), '[^\\p{{L}}\\p{{N}}{white}]', ''), '{white}+', ' '))")
    spark.sql(
        rf"CREATE OR REPLACE TEMPORARY FUNCTION clean_title(s STRING) RETURNS STRING RETURN regexp_replace(regexp_replace("
        rf"CASE WHEN instr(coalesce(s, ''), ' - ') > 1 THEN substring_index(s, ' - ', 1) ELSE coalesce(s, '') END, '(?s)^(.+) \\(.*\\)\\z', '$1'), '^{white}+|{white}+$', '')"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION track_key(s STRING) RETURNS STRING RETURN norm_text(clean_title(s))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION slug(s STRING) RETURNS STRING RETURN coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(s, '')), '[^\\p{L}\\p{N}]+', '-'), '^-+|-+$', ''), ''), 'playlist')")
    spark.udf.register("lab_norm", _lab_norm)
