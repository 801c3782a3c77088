"""Queries of the text functions and of entity resolution over the star-schema and document tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.functions import text as tx
from ostinata.functions import transport as tp
from ostinata.operators import library as lb
from ostinata.operators import matching as mt
from ostinata.operators import merge as mg
from ostinata.operators import report as rp


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace(CASE WHEN strpos({x}, ' - ') > 1 THEN split_part({x}, ' - ', 1) ELSE {x} END, '(?s)^(.+) \(.*\)$', '\1')")


def slug_sql(x: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-'), ''), 'playlist')"


def norm_title(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.normalize("text").alias("norm"))


def clean_title(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.clean_title("text").alias("title"))


def track_key(spark, sf):
    return t(spark, sf, "part").select("p_partkey", tx.track_key(F.concat("p_name", F.lit(" ("), "p_type", F.lit(") - "), "p_brand")).alias("key"))


def slugify(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.slugify("url").alias("slug"))


def lab_norm(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.lab_norm("text").alias("norm"))


def split_line(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.split_title("text").alias("s")).select("doc_id", "s.title", "s.artist")


def _split_sql() -> str:
    arms = lambda f: " ".join(f"WHEN strpos(text, '{s}') > 1 THEN {f(s)}" for s in tx.SEPARATORS)
    title = arms(lambda s: strip_sql(f"substr(text, 1, strpos(text, '{s}') - 1)"))
    artist = arms(lambda s: strip_sql(f"substr(text, strpos(text, '{s}') + {len(s)})"))
    return f"SELECT doc_id, CASE {title} ELSE text END AS title, CASE {artist} ELSE '' END AS artist FROM documents"


def artist_split(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(tx.comma_list("text"), "|").alias("names"))


def truncated(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.truncate("text", 40).alias("title"))


def match_keys(spark, sf):
    """Identity keys: every third part has a code, the others title and artists."""
    isrc = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lower("p_brand"), F.lit("-"), "p_partkey"))
    return t(spark, sf, "part").select("p_partkey", tx.match_key(isrc, "p_name", F.array("p_brand", "p_type")).alias("key"), tx.ref_key("p_name", "p_brand").alias("ref"))


def _title_pairs(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("ms"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("o_name"), F.col("p_brand").alias("o_brand"), F.col("ms").alias("o_ms"))
    both = p.join(other, "p_partkey").select("p_partkey", F.lit("next").alias("kind"), F.col("p_name").alias("source"), F.col("o_name").alias("cand"), F.col("p_brand").alias("s_artist"), F.col("o_brand").alias("c_artist"), F.abs(F.col("ms") - F.col("o_ms")).alias("delta"))
    cut = p.select("p_partkey", F.lit("version").alias("kind"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("source"), F.col("p_name").alias("cand"), F.col("p_brand").alias("s_artist"), F.concat("p_brand", F.lit(" & Co")).alias("c_artist"), (F.col("p_partkey") % 2 * 2501).alias("delta"))
    word = p.select("p_partkey", F.lit("prefix").alias("kind"), F.col("p_name").alias("source"), F.substring_index("p_name", " ", 1).alias("cand"), F.col("p_brand").alias("s_artist"), F.lit("").alias("c_artist"), F.lit(0).cast("bigint").alias("delta"))
    return both.unionByName(cut).unionByName(word)


_PAIRS = """p AS (SELECT p_partkey, p_name, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS ms FROM part),
pairs AS (
  SELECT a.p_partkey, 'next' AS kind, a.p_name AS source, b.p_name AS cand, a.p_brand AS s_artist, b.p_brand AS c_artist, abs(a.ms - b.ms) AS delta FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1
  UNION ALL SELECT p_partkey, 'version', p_name || ' (' || p_brand || ')', p_name, p_brand, p_brand || ' & Co', p_partkey % 2 * 2501 FROM p
  UNION ALL SELECT p_partkey, 'prefix', p_name, split_part(p_name, ' ', 1), p_brand, '', 0 FROM p)"""


def title_sql(source: str, cand: str) -> str:
    s, c = norm_sql(source), norm_sql(cand)
    return f"CASE WHEN {s} = {c} THEN 1.0 WHEN {norm_sql(clean_sql(source))} = {c} THEN 0.95 WHEN {c} <> '' AND (starts_with({s}, {c}) OR starts_with({c}, {s})) THEN 0.8 ELSE 0.0 END::DOUBLE"


def contains_sql(hay: str, needle: str) -> str:
    return f"CASE WHEN {norm_sql(needle)} <> '' AND contains({norm_sql(hay)}, {norm_sql(needle)}) THEN 1.0 ELSE 0.0 END::DOUBLE"


def title_scores(spark, sf):
    return _title_pairs(spark, sf).select("p_partkey", "kind", tx.title_score("source", "cand").alias("score"), tx.contains_norm("c_artist", "s_artist").alias("artist"))


def match_score_bands(spark, sf):
    score = tx.match_score(tx.title_score("source", "cand"), tx.contains_norm("c_artist", "s_artist"), F.col("delta") <= tx.DURATION_TOLERANCE_MS)
    return _title_pairs(spark, sf).select("p_partkey", "kind", score.alias("s")).select("p_partkey", "kind", F.round("s", 6).alias("score"), tx.band(F.col("s")).alias("confidence"))


def _score_sql(title: str, artist: str, delta: str) -> str:
    return f"CAST(0.5 AS DOUBLE) * {title} + CAST(0.35 AS DOUBLE) * {artist} + CAST(0.15 AS DOUBLE) * CASE WHEN {delta} <= 2500 THEN 1.0 ELSE 0.0 END::DOUBLE"


_BAND = "CASE WHEN s >= CAST(0.85 AS DOUBLE) THEN 'high' WHEN s >= CAST(0.55 AS DOUBLE) THEN 'low' ELSE 'none' END"


def _tracks(spark, sf):
    """Parts as tracks: a version suffix on every other title, a code on every third."""
    k = F.col("p_partkey")
    return t(spark, sf, "part").select(
        k.alias("ord"), F.when(k % 2 == 0, F.concat("p_name", F.lit(" - "), "p_type")).otherwise(F.col("p_name")).alias("title"), F.array("p_brand").alias("artists"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("duration_ms"), F.when(k % 3 == 0, F.concat(F.lower("p_name"), F.lit("/"), "p_brand", F.lit("/"), F.col("p_size") % 10)).alias("isrc"),
    )


def _catalog(spark, sf):
    """One song for each name, brand and size digit; codes in capitals; those of size digit 7 have none."""
    d = (F.col("p_size") % 10).alias("d")
    g = t(spark, sf, "part").groupBy("p_name", "p_brand", d).agg(F.min("p_partkey").alias("k"), F.min(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("ms"))
    return g.select(F.concat(F.lit("S"), "k").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("The "), "p_brand").alias("artist"), F.col("ms").alias("duration_ms"), F.when(F.col("d") != 7, F.upper(F.concat("p_name", F.lit("/"), "p_brand", F.lit("/"), "d"))).alias("isrc"), F.col("k").alias("cand_pos"))


_TRACKS = """t AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' - ' || p_type ELSE p_name END AS title, p_brand AS artist, CAST(round(p_retailprice * 100) AS BIGINT) AS ms,
  CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) || '/' || p_brand || '/' || CAST(p_size % 10 AS VARCHAR) END AS isrc FROM part),
c AS (SELECT 'S' || CAST(min(p_partkey) AS VARCHAR) AS id, p_name AS title, 'The ' || p_brand AS artist, min(CAST(round(p_retailprice * 100) AS BIGINT)) AS song_ms,
  CASE WHEN p_size % 10 <> 7 THEN upper(p_name || '/' || p_brand || '/' || CAST(p_size % 10 AS VARCHAR)) END AS code, min(p_partkey) AS cand_pos FROM part GROUP BY p_name, p_brand, p_size % 10)"""
_EXACT = "x AS (SELECT ord, arg_min(id, (abs(ms - song_ms), cand_pos)) AS target_id FROM t JOIN c ON upper(t.isrc) = c.code GROUP BY ord)"
_NORMED = f"""tn AS (SELECT ord, ms, {norm_sql("title")} AS ns, {norm_sql(clean_sql("title"))} AS nk, {norm_sql("artist")} AS na FROM t),
cn AS (SELECT id, cand_pos, song_ms, {norm_sql("title")} AS nc, {norm_sql("artist")} AS ca FROM c),
sc AS (SELECT ord, id, cand_pos, CAST(0.5 AS DOUBLE) * (CASE WHEN ns = nc THEN 1.0 WHEN nk = nc THEN 0.95 WHEN nc <> '' AND (starts_with(ns, nc) OR starts_with(nc, ns)) THEN 0.8 ELSE 0.0 END)::DOUBLE
  + CAST(0.35 AS DOUBLE) * (CASE WHEN na <> '' AND contains(ca, na) THEN 1.0 ELSE 0.0 END)::DOUBLE + CAST(0.15 AS DOUBLE) * (CASE WHEN abs(ms - song_ms) <= 2500 THEN 1.0 ELSE 0.0 END)::DOUBLE AS s
  FROM tn JOIN cn ON starts_with(ns, nc) OR starts_with(nc, ns)),
b AS (SELECT ord, arg_max(id, (s, -cand_pos)) AS target_id, max(s) AS s FROM sc GROUP BY ord),
f AS (SELECT ord, target_id, s, {_BAND} AS confidence FROM b WHERE s >= CAST(0.55 AS DOUBLE))"""
_ALL = """m AS (SELECT t.ord, coalesce(x.target_id, f.target_id) AS target_id, CASE WHEN x.target_id IS NOT NULL THEN 'exact' ELSE coalesce(f.confidence, 'none') END AS confidence,
  CASE WHEN x.target_id IS NOT NULL THEN 'isrc' WHEN f.target_id IS NOT NULL THEN 'search' ELSE 'none' END AS method FROM t LEFT JOIN x ON t.ord = x.ord LEFT JOIN f ON t.ord = f.ord)"""


def isrc_resolve(spark, sf):
    return mt.resolve_by_isrc(_tracks(spark, sf), _catalog(spark, sf))


def text_resolve(spark, sf):
    return mt.resolve_by_title(_tracks(spark, sf), _catalog(spark, sf)).withColumn("score", F.round("score", 6))


def match_two_pass(spark, sf):
    return mt.match(_tracks(spark, sf), _catalog(spark, sf)).drop("note")


def match_resume(spark, sf):
    """Parts with an even half of the key space matched before, some of which have left."""
    tracks = _tracks(spark, sf).withColumn("key", F.concat(F.lit("k"), "ord"))
    prior = t(spark, sf, "part").where("p_partkey % 4 < 2").select(F.concat(F.lit("k"), F.col("p_partkey") * 2).alias("key"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("P"), "p_partkey")).alias("target_id"), F.lit("high").alias("confidence"), F.lit("search").alias("method"), F.lit(None).cast("string").alias("note"))
    return mt.match_resumed(tracks, prior, _catalog(spark, sf)).select("key", "target_id", "confidence", "method")


def enrich_lookup(spark, sf):
    tracks = _tracks(spark, sf).select("ord", "title", F.element_at("artists", 1).alias("artist"), F.when(F.col("ord") % 5 > 0, F.col("duration_ms")).alias("durationMs"))
    songs = _catalog(spark, sf).select(F.col("cand_pos").alias("id"), "title", "artist", ((F.col("duration_ms") - F.col("cand_pos") % 40 * 1000) / 1000).cast("int").alias("duration_sec"), "cand_pos")
    return mg.pick_features(tracks, songs)


_ENRICH = f"""WITH {_TRACKS},
a AS (SELECT ord, {norm_sql(clean_sql("title"))} AS k, {norm_sql("artist")} AS a, CASE WHEN ord % 5 > 0 THEN ms ELSE 0 END AS ms FROM t),
g AS (SELECT cand_pos AS id, {norm_sql(clean_sql("title"))} AS k, {norm_sql("artist")} AS b, CAST(trunc((song_ms - cand_pos % 40 * 1000) / 1000.0) AS BIGINT) * 1000 AS song_ms, cand_pos FROM c),
n AS (SELECT ord, id, ms, cand_pos, CASE WHEN ms > 0 THEN abs(song_ms - ms) ELSE 1073741824 END AS delta FROM a JOIN g ON a.k = g.k AND (contains(a, b) OR contains(b, a))),
r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY delta, cand_pos) AS rn FROM n)
SELECT ord, id, delta FROM r WHERE rn = 1 AND NOT (ms > 0 AND delta > 15000)"""


def match_summary(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    band = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "exact").when(F.col("quality") == 0, "high").otherwise("none")
    return rp.match_summary(d.select(band.alias("confidence")))


_SUMMARY = """WITH d AS (SELECT CASE WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'exact' WHEN quality = 0 THEN 'high' ELSE 'none' END AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (c <> 'none') AS matched, count(*) FILTER (c = 'exact') AS exact, count(*) FILTER (c = 'high') AS high, count(*) FILTER (c = 'low') AS low, count(*) FILTER (c = 'none') AS unmatched,
round(100.0::DOUBLE * count(*) FILTER (c <> 'none') / nullif(count(*), 0), 1) AS percent FROM d"""


def unmatched_report(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(F.col("doc_id").alias("ord"), F.col("text").alias("title"), F.col("quality").cast("string").alias("target_id"))
    return rp.unmatched(d, "ord").select("ord", "title")


def unmatched_more(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(F.col("quality").cast("string").alias("target_id"))
    return rp.unmatched_more(d)


def unique_names(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"))
    return lb.unique_names(p)


_UNIQUE_NAMES = """WITH b AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 7 = 0 THEN 'Untitled Playlist' ELSE p_name END AS base FROM part),
n AS (SELECT ord, base, row_number() OVER (PARTITION BY base ORDER BY ord) AS k FROM b)
SELECT ord, CASE WHEN k > 1 THEN base || ' (' || CAST(k AS VARCHAR) || ')' ELSE base END AS name FROM n"""


def lab_keys(spark, sf):
    return t(spark, sf, "part").select("p_partkey", tx.lab_key(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), "p_brand").alias("key"))


def joined_artists(spark, sf):
    """Sorted brands of each size, joined as a display name."""
    g = t(spark, sf, "part").groupBy("p_size").agg(F.sort_array(F.collect_set("p_brand")).alias("artists"))
    return g.select("p_size", tx.join_artists("artists").alias("artist"))


def default_names(spark, sf):
    return t(spark, sf, "part").select("p_partkey", tx.curated_name("p_brand").alias("name"))


def url_challenges(spark, sf):
    return t(spark, sf, "pages").select("page_id", tp.challenge("url").alias("challenge"))


def absolute_links(spark, sf):
    """Links of pages: whole ones, rooted ones, relative ones and none, by turns."""
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/v1/"), "page_id")).when(k == 2, F.concat(F.lit("/x/"), "page_id"))
    return t(spark, sf, "pages").select("page_id", tp.absolute(link, "https://a/v1", "https://h").alias("link"))


def waits(spark, sf):
    e = t(spark, sf, "events")
    asked = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.lit("soon"))
    return e.select("event_id", tp.wait_seconds(asked, F.col("event_id") % 7).alias("seconds"))


def broken_runs(spark, sf):
    """Events of each user until three clicks on end."""
    e = t(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("failed"))
    return tp.until_broken(e, "user_id", "event_id", "failed", 3)


_BROKEN = """WITH e AS (SELECT user_id, event_id, event_type = 'click' AS failed, row_number() OVER w AS n, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, r ORDER BY event_id) AS c FROM e), f AS (SELECT user_id, min(n) AS stop FROM s WHERE c = 3 GROUP BY 1)
SELECT s.user_id, s.event_id, s.failed, s.c = 3 AS broken FROM s LEFT JOIN f ON s.user_id = f.user_id WHERE f.stop IS NULL OR s.n <= f.stop"""


QUERIES = {f.__name__: f for f in (norm_title, clean_title, track_key, slugify, lab_norm, split_line, artist_split, truncated, match_keys, title_scores, match_score_bands, isrc_resolve, text_resolve, match_two_pass, match_resume, enrich_lookup, match_summary, unmatched_report, unmatched_more, unique_names, lab_keys, joined_artists, default_names, url_challenges, absolute_links, waits, broken_runs)}

SQL = {
    "norm_title": f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents",
    "clean_title": f"SELECT doc_id, {clean_sql('text')} AS title FROM documents",
    "track_key": "WITH n AS (SELECT p_partkey, p_name || ' (' || p_type || ') - ' || p_brand AS x FROM part) SELECT p_partkey, " + norm_sql(clean_sql("x")) + " AS key FROM n",
    "slugify": f"SELECT page_id, {slug_sql('url')} AS slug FROM pages",
    "lab_norm": r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^0-9a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents",
    "split_line": _split_sql(),
    "artist_split": "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: " + strip_sql("x") + "), lambda x: x <> ''), '|') AS names FROM documents",
    "truncated": "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS title FROM documents",
    "match_keys": f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'isrc:' || upper(p_brand || '-' || CAST(p_partkey AS VARCHAR)) ELSE 'tt:' || {norm_sql('p_name')} || '|' || {norm_sql("p_brand || ' ' || p_type")} END AS key, {norm_sql('p_name')} || '|' || {norm_sql('p_brand')} AS ref FROM part",
    "title_scores": f"WITH {_PAIRS} SELECT p_partkey, kind, {title_sql('source', 'cand')} AS score, {contains_sql('c_artist', 's_artist')} AS artist FROM pairs",
    "match_score_bands": f"WITH {_PAIRS}, z AS (SELECT p_partkey, kind, {_score_sql(title_sql('source', 'cand'), contains_sql('c_artist', 's_artist'), 'delta')} AS s FROM pairs) SELECT p_partkey, kind, round(s, 6) AS score, {_BAND} AS confidence FROM z",
    "isrc_resolve": f"WITH {_TRACKS}, {_EXACT} SELECT ord, target_id FROM x",
    "text_resolve": f"WITH {_TRACKS}, {_NORMED} SELECT ord, target_id, round(s, 6) AS score, confidence FROM f",
    "match_two_pass": f"WITH {_TRACKS}, {_EXACT}, {_NORMED}, {_ALL} SELECT * FROM m",
    "match_resume": f"""WITH {_TRACKS}, {_EXACT}, {_NORMED}, {_ALL}, pr AS (SELECT 2 * p_partkey AS ord, 'P' || CAST(p_partkey AS VARCHAR) AS target_id FROM part WHERE p_partkey % 4 = 0)
SELECT 'k' || CAST(m.ord AS VARCHAR) AS key, coalesce(pr.target_id, m.target_id) AS target_id, CASE WHEN pr.ord IS NOT NULL THEN 'high' ELSE confidence END AS confidence, CASE WHEN pr.ord IS NOT NULL THEN 'search' ELSE method END AS method FROM m LEFT JOIN pr ON m.ord = pr.ord""",
    "enrich_lookup": _ENRICH,
    "match_summary": _SUMMARY,
    "unmatched_report": "SELECT doc_id AS ord, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS title FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY doc_id LIMIT 50",
    "unmatched_more": "SELECT greatest(count(*) FILTER (quality IS NULL) - 50, 0) AS more FROM documents LEFT JOIN labels USING (doc_id)",
    "unique_names": _UNIQUE_NAMES,
    "lab_keys": r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^0-9a-z]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(p_brand), '[^0-9a-z]+', ' ', 'g')) AS key FROM part",
    "joined_artists": "SELECT p_size, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS artist FROM part GROUP BY 1",
    "url_challenges": "SELECT page_id, rtrim(translate(to_base64(unhex(sha256(url))), '+/', '-_'), '=') AS challenge FROM pages",
    "absolute_links": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://h/v1/' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'https://a/v1/x/' || CAST(page_id AS VARCHAR) ELSE '' END AS link FROM pages",
    "waits": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id + 0.5::DOUBLE ELSE least(pow(2.0::DOUBLE, event_id % 7), 30.0::DOUBLE) END AS seconds FROM events",
    "broken_runs": _BROKEN,
    "default_names": "SELECT p_partkey, 'Around ' || p_brand AS name FROM part",
}
