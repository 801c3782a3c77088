"""Queries of the collection operators over orders as baskets, with their SQL.

A basket is an order, a member one of its lines (in line order, made total by part, supplier and price), an item
a part, its title the part's name and its artist the part's brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinata.operators import affinity as af
from ostinata.operators import curate as cu
from ostinata.operators import evaluate as ev
from ostinata.operators import library as lb
from ostinata.operators import merge as mg
from ostinata.operators import reconcile as rc
from ostinata.operators import report as rp
from ostinata.plans import lab
from ostinata.plans.queries_text import t
from ostinata.streaming.imports import windowed_counts

CAP = af.MAX_BASKET
SEED = "Brand#11"


def members(spark: SparkSession, sf: str) -> DataFrame:
    """The rows lie by basket, in parts of bounded size, so that what is done by basket moves nothing."""
    lines, parts = t(spark, sf, "lineitem"), t(spark, sf, "part")
    n = lines.count()
    lines = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    many = parts.count() > lb.ROWS_A_TASK
    parts = parts.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    if many:  # a table of some MB in Parquet can be too large for a broadcast
        lines, parts = lb.spread(lines, n, "l_partkey"), parts.hint("merge")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = lb.spread(lines.join(parts, "l_partkey"), n, "l_orderkey").withColumn("pos", F.row_number().over(w) - 1)
    return found.select(F.col("l_orderkey").alias("basket"), "pos", F.col("l_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), "p_type", "p_size", "p_retailprice")


_M = """m AS (SELECT l_orderkey AS basket, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
  l_partkey AS item, p_name AS title, p_brand AS artist, p_type, p_size, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_CAPPED = f"{_M}, ok AS (SELECT basket FROM m GROUP BY basket HAVING count(*) <= {CAP})"


def _pairs_sql(x: str) -> str:
    return f"d AS (SELECT DISTINCT basket, {x} AS x FROM m SEMI JOIN ok USING (basket)), pr AS (SELECT a.x AS a, b.x AS b, count(*) AS weight FROM d a JOIN d b ON a.basket = b.basket AND a.x < b.x GROUP BY 1, 2)"


def _resolved(spark, sf):
    """Parts up to size 25 have a target, two neighbouring keys share one."""
    p = t(spark, sf, "part")
    return p.where("p_size <= 25").select(F.col("p_partkey").alias("key"), F.concat(F.lit("T"), F.floor(F.col("p_partkey") / 2)).alias("target_id"))


_R = "r AS (SELECT p_partkey AS key, 'T' || CAST(p_partkey // 2 AS VARCHAR) AS target_id FROM part WHERE p_size <= 25)"
_WANT = "h AS (SELECT basket, target_id, min(pos) AS pos FROM m JOIN r ON m.item = r.key GROUP BY 1, 2), w AS (SELECT basket, list(target_id ORDER BY pos) AS desired FROM h GROUP BY 1)"
_ALL_W = "al AS (SELECT b.basket, coalesce(w.desired, []::VARCHAR[]) AS desired FROM (SELECT DISTINCT basket FROM m) b LEFT JOIN w USING (basket))"


# co-occurrence graph


def artist_cooccurrence(spark, sf):
    return af.cooccurrence(members(spark, sf), "basket", "artist", CAP)


def track_cooccurrence(spark, sf):
    # an order of average size has two pairs for each line, and few come up twice
    return af.cooccurrence(members(spark, sf), "basket", "item", CAP, lb.parts_of(spark, 2 * t(spark, sf, "lineitem").count()))


def neighbours(spark, sf):
    return af.neighbours(artist_cooccurrence(spark, sf), SEED, 12)


def top_neighbours(spark, sf):
    return af.top_neighbours(artist_cooccurrence(spark, sf), 5, 2)


def playlists_per_artist(spark, sf):
    return af.baskets_per_member(members(spark, sf), "basket", "artist")


def pmi(spark, sf):
    m = members(spark, sf)
    out = af.pmi(af.cooccurrence(m, "basket", "artist", CAP), af.baskets_per_member(m, "basket", "artist"), m.agg(F.count_distinct("basket").alias("n")), 2)
    return out.withColumn("pmi", F.round("pmi", 6))


# library


def unique_tracks(spark, sf):
    return lb.first_by(members(spark, sf), ["item"], ["basket", "pos"]).select("item", "basket", "pos", "title")


def distinct_artists(spark, sf):
    return members(spark, sf).groupBy("basket").agg(F.count_distinct("artist").alias("artists"))


def library_overview(spark, sf):
    m = members(spark, sf)
    return m.agg(F.count_distinct("basket").alias("playlists"), F.count_distinct("item").alias("unique_tracks"), F.count("*").alias("memberships"))


def _sizes(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))


def size_describe(spark, sf):
    d = rp.describe(_sizes(spark, sf), "size")
    return d.select("n", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "std", "least", "q25", "q50", "q75", "most")])


def size_histogram(spark, sf):
    return rp.histogram(_sizes(spark, sf), "size", 30)


def top_artists(spark, sf):
    return rp.top_counts(t(spark, sf, "part").withColumnRenamed("p_brand", "artist"), "artist", 20)


def connectors(spark, sf):
    return rp.connectors(members(spark, sf), ["item", "title", "artist"], "basket", 15)


def union_liked(spark, sf):
    """Own and followed orders, then one list of liked parts."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), F.lit(None).cast("string").alias("description"), F.col("o_custkey").cast("string").alias("owner_id"), F.col("o_orderkey").alias("id"))
    items = members(spark, sf).select(F.col("basket").alias("playlist_id"), "pos", F.when(F.col("item") % 10 == 0, F.lit("episode")).when(F.col("item") % 10 == 1, F.lit("")).otherwise(F.lit("track")).alias("type"), F.when(F.col("item") % 11 > 0, F.col("title")).alias("track"))
    liked = t(spark, sf, "part").where("p_size = 50").select(F.col("p_partkey").alias("pos"), F.lit("track").alias("type"), F.col("p_name").alias("track"))
    return lb.pull(o, items, liked, "7").select("name", "kind", F.array_join("tracks", "|").alias("tracks"), F.size("tracks").alias("n"))


_LIKED = f"""WITH {_M}, i AS (SELECT basket, pos, title FROM m WHERE item % 10 <> 0 AND item % 11 > 0), l AS (SELECT basket, string_agg(title, '|' ORDER BY pos) AS tracks, count(*) AS n FROM i GROUP BY 1)
SELECT 'Order ' || CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_custkey = 7 THEN 'owned' ELSE 'followed' END AS kind, coalesce(tracks, '') AS tracks, CAST(coalesce(n, 0) AS INTEGER) AS n FROM orders LEFT JOIN l ON o_orderkey = basket
UNION ALL SELECT 'Liked Songs (from Spotify)', 'liked_songs', string_agg(p_name, '|' ORDER BY p_partkey), CAST(count(*) AS INTEGER) FROM part WHERE p_size = 50 HAVING count(*) > 0"""


def owned_only(spark, sf):
    o = t(spark, sf, "orders")
    return o.where("o_custkey = 7").select("o_orderkey", "o_orderstatus")


def completeness_filter(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("basket"))
    m = members(spark, sf).select("basket", F.col("item").alias("key"))
    return lb.within_missing(o, m, _resolved(spark, sf), 1, "basket")


def resolved_count(spark, sf):
    m = members(spark, sf).select("basket", F.col("item").alias("key"))
    return rp.resolved_counts(m, _resolved(spark, sf), "basket")


def track_surrogates(spark, sf):
    """Dense ids of parts in order of name and key."""
    return lb.with_ids(t(spark, sf, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"])


# reconcile


def _keyed(spark, sf):
    return members(spark, sf).withColumn("key", F.col("item")).withColumn("artists", F.array("artist"))


def resolve_ids(spark, sf):
    return rc.desired(_keyed(spark, sf), _resolved(spark, sf), "basket").select("basket", F.array_join("desired", ",").alias("desired"))


def _recorded(spark, sf):
    """A record of every order: none, the first two, or all but the first of what is desired."""
    want = rc.desired(_keyed(spark, sf), _resolved(spark, sf), "basket")
    k = F.col("basket") % 3
    return want.withColumn("recorded", F.when(k == 0, F.slice("desired", F.lit(1), F.lit(2))).when(k == 1, F.slice("desired", 2, 20)).otherwise(F.array().cast("array<string>")))


def reconcile_prefix(spark, sf):
    return rc.reconcile(_recorded(spark, sf)).select("basket", F.array_join("to_add", ",").alias("to_add"), "ordered")


_RECON = f"""WITH {_M}, {_R}, {_WANT}, q AS (SELECT basket, desired, CASE WHEN basket % 3 = 0 THEN desired[1:2] WHEN basket % 3 = 1 THEN desired[2:21] ELSE []::VARCHAR[] END AS recorded FROM w),
p AS (SELECT *, len(recorded) <= len(desired) AND desired[1:len(recorded)] = recorded AS ordered FROM q)
SELECT basket, array_to_string(CASE WHEN ordered THEN desired[len(recorded) + 1:] ELSE list_filter(desired, lambda x: NOT list_contains(recorded, x)) END, ',') AS to_add, ordered FROM p"""


def adopt_diff(spark, sf):
    m = _keyed(spark, sf)
    refs = m.where("pos = 0").select("basket", F.upper("title").alias("title"), "artist")
    added = _recorded(spark, sf).select("basket", F.explode("recorded").alias("target_id"))
    return rc.missing_from_library(m, _resolved(spark, sf), refs, added, "basket")


_ADOPT = f"""WITH {_M}, {_R}, {_WANT}, q AS (SELECT basket, unnest(CASE WHEN basket % 3 = 0 THEN desired[1:2] WHEN basket % 3 = 1 THEN desired[2:21] ELSE []::VARCHAR[] END) AS target_id FROM w),
hit AS (SELECT m.basket, m.pos, m.title, m.artist, r.target_id FROM m JOIN r ON m.item = r.key),
lf AS (SELECT * FROM hit WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.basket = hit.basket AND q.target_id = hit.target_id) AND NOT EXISTS (SELECT 1 FROM m z WHERE z.pos = 0 AND z.basket = hit.basket AND z.title = hit.title AND z.artist = hit.artist))
SELECT basket, min(pos) AS pos, target_id FROM lf GROUP BY basket, target_id"""


def playlist_decision(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("k"))
    state = o.where("k % 3 = 0").select("name", F.when(F.col("k") % 2 == 0, F.concat(F.lit("A"), "name")).alias("target_id"))
    existing = o.where("k % 5 = 0").select("name", F.concat(F.lit("E"), "name").alias("id"), F.lit(1).alias("ord")).unionByName(o.where("k % 10 = 0").select("name", F.concat(F.lit("L"), "name").alias("id"), F.lit(2).alias("ord")))
    return rc.decisions(o, state, existing)


_DECIDE = """SELECT CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 6 = 0 THEN 'resume' WHEN o_orderkey % 5 = 0 THEN 'skip' ELSE 'create' END AS action,
CASE WHEN o_orderkey % 6 = 0 THEN 'A' WHEN o_orderkey % 10 = 0 THEN 'L' WHEN o_orderkey % 5 = 0 THEN 'E' END || CAST(o_orderkey AS VARCHAR) AS target_id FROM orders"""


def append_batches(spark, sf):
    """Events of each user in requests of 15."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("pos"))
    return rc.batches(e, "name", 15)


# curate


def gather_round_robin(spark, sf):
    pool = cu.pools(members(spark, sf).withColumnRenamed("basket", "ord"))
    near = neighbours(spark, sf).withColumn("rank", F.row_number().over(W.orderBy(F.desc("weight"), "artist")))  # twelve rows
    ns = "brand11"
    ranked = near.select(F.lower(F.regexp_replace("artist", "#", "")).alias("artist_norm"), "rank").unionByName(spark.createDataFrame([(ns, 0)], "artist_norm string, rank int"))
    return cu.gather(pool, ranked, 100).select("pick", "artist", "title")


_GATHER = f"""WITH {_CAPPED}, {_pairs_sql("artist")}, nb AS (SELECT CASE WHEN a = '{SEED}' THEN b ELSE a END AS artist, weight FROM pr WHERE a = '{SEED}' OR b = '{SEED}' ORDER BY weight DESC, artist LIMIT 12),
rk AS (SELECT artist, row_number() OVER (ORDER BY weight DESC, artist) AS rank FROM nb UNION ALL SELECT '{SEED}', 0),
po AS (SELECT DISTINCT artist, title FROM m), rd AS (SELECT artist, title, rank, row_number() OVER (PARTITION BY artist ORDER BY title) AS round FROM po JOIN rk USING (artist)),
c AS (SELECT *, row_number() OVER (ORDER BY round, rank) AS pick FROM rd)
SELECT CAST(pick AS INTEGER) AS pick, artist, title FROM c WHERE pick <= 100"""


def separate(spark, sf):
    """All orders resequenced."""
    return cu.separate(members(spark, sf).select("basket", "pos", "item", "artist"), "basket", "pos", "artist").select("basket", "place", "item", "artist")


def curate(spark, sf):
    return cu.curate(members(spark, sf).select(F.col("basket").alias("ord"), "pos", "title", "artist", "item"), SEED, cap=CAP)


#: One step of the separation rule over `left_`, a list of structs with artist and pos; `pick` was taken last.
def _next_sql(*fields: str) -> str:
    kept = ", ".join(f"'{f}': x.{f}" for f in fields)
    return f"list_min(list_transform(left_, lambda x: {{'same': coalesce(x.artist = pick.artist, false), 'c': -len(list_filter(left_, lambda y: y.artist = x.artist)), 'pos': x.pos, 'artist': x.artist, {kept}}}))"


_SEPARATE = f"""WITH RECURSIVE {_M}, g AS (SELECT basket, list({{'same': false, 'c': 0, 'pos': pos, 'artist': artist, 'item': item}} ORDER BY pos) AS left_ FROM m GROUP BY basket),
r AS (SELECT basket, left_, {{'same': false, 'c': 0, 'pos': CAST(-1 AS BIGINT), 'artist': CAST(NULL AS VARCHAR), 'item': CAST(NULL AS BIGINT)}} AS pick, 0 AS place FROM g
UNION ALL SELECT basket, list_filter(left_, lambda x: x.pos <> p.pos), p, place + 1 FROM (SELECT basket, left_, place, {_next_sql('item')} AS p FROM r WHERE len(left_) > 0))
SELECT basket, CAST(place AS BIGINT) AS place, pick.item AS item, pick.artist AS artist FROM r WHERE place > 0"""

_CURATE = f"""WITH RECURSIVE {_CAPPED}, {_pairs_sql("artist")}, nb AS (SELECT CASE WHEN a = '{SEED}' THEN b ELSE a END AS artist, weight FROM pr WHERE a = '{SEED}' OR b = '{SEED}' ORDER BY weight DESC, artist LIMIT 12),
rk AS (SELECT artist, row_number() OVER (ORDER BY weight DESC, artist) AS rank FROM nb UNION ALL SELECT '{SEED}', 0),
po AS (SELECT artist, title, arg_min(item, (basket, pos)) AS item FROM m GROUP BY artist, title), rd AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY title) AS round FROM po JOIN rk USING (artist)),
c AS (SELECT artist, title, item, row_number() OVER (ORDER BY round, rank) AS pos FROM rd),
g AS (SELECT list({{'same': false, 'c': 0, 'pos': pos, 'artist': artist, 'title': title, 'item': item}} ORDER BY pos) AS left_ FROM c WHERE pos <= {cu.SIZE}),
r AS (SELECT left_, {{'same': false, 'c': 0, 'pos': CAST(-1 AS BIGINT), 'artist': CAST('' AS VARCHAR), 'title': CAST(NULL AS VARCHAR), 'item': CAST(NULL AS BIGINT)}} AS pick, 0 AS place FROM g
UNION ALL SELECT list_filter(left_, lambda x: x.pos <> p.pos), p, place + 1 FROM (SELECT left_, place, {_next_sql('title', 'item')} AS p FROM r WHERE len(left_) > 0))
SELECT CAST(place AS BIGINT) AS place, pick.title AS title, pick.artist AS artist, pick.item AS item FROM r WHERE place > 0"""


def _library(spark, sf):
    """Orders as lists of list tracks: ord, slug, name, tracks."""
    m = members(spark, sf)
    none = F.lit(None)
    ids = F.when(F.col("item") % 3 == 0, F.create_map(F.lit("appleMusic"), F.col("item").cast("string"))).otherwise(none.cast("map<string,string>"))
    features = F.when(F.col("item") % 4 > 0, F.struct((F.col("p_size") % 4 * 30).cast("double").alias("bpm"), F.lit(-7.0).alias("gain"), F.lit("f").alias("source")))
    track = F.struct("title", "artist", F.col("p_type").alias("album"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("durationMs"), F.when(F.col("item") % 5 == 0, F.concat(F.lit("C"), "item")).alias("isrc"), ids.alias("ids"), features.alias("features"))
    lists = m.groupBy("basket").agg(lb.in_order("pos", track).alias("tracks"))
    return lists.select(F.col("basket").alias("ord"), F.concat(F.lit("order-"), "basket").alias("slug"), F.concat(F.lit("Order "), "basket").alias("name"), "tracks")


def flattened(spark, sf):
    """Lists back to memberships."""
    return lb.flatten(_library(spark, sf), "slug").select("slug", "pos", "title", "artist", "durationMs", "isrc", F.element_at("ids", "appleMusic").alias("apple_id"))


def curator_rows(spark, sf):
    """List tracks as curation's rows and back: ids and gain are lost, a tempo gets the catalog's name."""
    return cu.to_tracks(cu.to_rows(_library(spark, sf), "slug")).select("slug", "pos", "title", "artist", "album", "isrc", "durationMs", F.col("features.bpm").alias("bpm"), F.col("features.source").alias("source"))


_ROWS = f"""WITH {_M} SELECT 'order-' || CAST(basket AS VARCHAR) AS slug, CAST(pos AS INTEGER) AS pos, title, artist, p_type AS album, CASE WHEN item % 5 = 0 THEN 'C' || CAST(item AS VARCHAR) END AS isrc, CAST(round(p_retailprice * 100) AS BIGINT) AS "durationMs",
CASE WHEN item % 4 > 0 AND p_size % 4 > 0 THEN CAST(p_size % 4 * 30 AS DOUBLE) END AS bpm, CASE WHEN item % 4 > 0 AND p_size % 4 > 0 THEN 'deezer' END AS source FROM m"""


def track_total(spark, sf):
    return rp.track_count(_library(spark, sf))


def table_rows(spark, sf):
    """Rows of a table through the parameterised SQL."""
    t(spark, sf, "lineitem").createOrReplaceTempView("lineitem_rows")
    return lab.q(spark, "SELECT count(*) AS n FROM lineitem_rows WHERE l_orderkey >= :least", least=0)


def lab_counts(spark, sf):
    """Rows of the analysis tables over all orders."""
    lab.open_lab(_library(spark, sf))
    return lab.q(spark, lab.COUNTS)


_LAB_COUNTS = f"""WITH {_M}, k AS (SELECT basket, title || '|' || lower(replace(artist, '#', ' ')) AS key, artist FROM m), ok AS (SELECT basket FROM m GROUP BY basket HAVING count(*) <= {CAP}),
t AS (SELECT DISTINCT basket, key FROM k SEMI JOIN ok USING (basket)), a AS (SELECT DISTINCT basket, artist FROM k SEMI JOIN ok USING (basket))
SELECT (SELECT count(DISTINCT basket) FROM m) AS playlists, (SELECT count(DISTINCT key) FROM k) AS tracks, (SELECT count(*) FROM m) AS memberships,
(SELECT count(*) FROM (SELECT DISTINCT x.key, y.key FROM t x JOIN t y ON x.basket = y.basket AND x.key < y.key)) AS track_pairs, (SELECT count(*) FROM (SELECT DISTINCT x.artist, y.artist FROM a x JOIN a y ON x.basket = y.basket AND x.artist < y.artist)) AS artist_pairs"""


def list_tracks(spark, sf):
    """The first forty tracks of one list, by its slug."""
    lab.open_lab(_library(spark, sf))
    return lab.q(spark, lab.LIST_TRACKS, slug="order-7", n=40)


def line_surrogates(spark, sf):
    """Dense ids of all order lines, with further columns."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return lb.with_ids(t(spark, sf, "lineitem").select(*keys, "l_returnflag", "l_shipdate"), keys)


def enrich_counters(spark, sf):
    """How many parts were searched, and how many of them got a code and a tempo."""
    p = t(spark, sf, "part")
    tracks = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.lit(0).cast("bigint").alias("durationMs"), F.when(F.col("p_partkey") % 2 == 0, F.lit("own")).alias("isrc"), F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit(90.0).alias("bpm"), F.lit(0.0).alias("gain"), F.lit("x").alias("source"))).alias("features"))
    songs = p.where("p_size % 2 = 0").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"))
    songs = songs.select("id", F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.lit(1).alias("duration_sec"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("C"), "id")).alias("isrc"), F.when(F.col("id") % 5 > 0, 100.0).otherwise(0.0).alias("bpm"), F.lit(-1.0).alias("gain"), F.col("id").alias("cand_pos"))
    return mg.enrich_counts(mg.enrich(tracks, songs))


_COUNTERS = """WITH s AS (SELECT p_name, p_brand, min(p_partkey) AS id FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2), j AS (SELECT p.p_partkey AS k, min(s.id) AS id FROM part p LEFT JOIN s ON p.p_name = s.p_name AND (contains(p.p_brand, s.p_brand) OR contains(s.p_brand, p.p_brand)) WHERE p.p_partkey % 3 <> 0 GROUP BY 1)
SELECT count(*) AS searched, count(*) FILTER (k % 2 <> 0 AND id % 4 > 0) AS with_isrc, count(*) FILTER (id % 5 > 0) AS with_bpm FROM j"""


def camelot_moves(spark, sf):
    m = members(spark, sf).withColumn("code", ev.camelot(F.col("p_size") % 13, F.col("item") % 2))
    return ev.camelot_steps(m, "basket", "pos", "code")


_CAMELOT = f"""WITH {_M}, k AS (SELECT basket, pos, CASE WHEN p_size % 13 < 12 THEN (p_size % 13 * 7 + CASE WHEN item % 2 = 1 THEN 7 ELSE 4 END) % 12 END AS n, item % 2 AS major FROM m),
l AS (SELECT basket, n, major, lag(n) OVER w AS pn, lag(major) OVER w AS pm FROM k WINDOW w AS (PARTITION BY basket ORDER BY pos))
SELECT basket, count(*) FILTER (n IS NOT NULL AND pn IS NOT NULL) AS steps, count(*) FILTER (n IS NOT NULL AND pn IS NOT NULL AND CASE WHEN major = pm THEN (n - pn + 12) % 12 IN (0, 1, 2, 11) ELSE n = pn END) AS smooth FROM l GROUP BY 1"""


def energy_arcs(spark, sf):
    m = members(spark, sf).withColumn("energy", F.col("p_size") / 50.0)
    out = ev.energy_arc(m, "basket", "pos", "energy")
    return out.select("basket", F.round("jump", 6).alias("jump"), F.round("off", 6).alias("off"))


_ARC = f"""WITH {_M}, k AS (SELECT basket, p_size / 50.0::DOUBLE AS e, row_number() OVER (PARTITION BY basket ORDER BY pos) AS p, count(*) OVER (PARTITION BY basket) AS n, abs(p_size / 50.0::DOUBLE - lag(p_size / 50.0::DOUBLE) OVER (PARTITION BY basket ORDER BY pos)) AS j FROM m),
x AS (SELECT *, (p - 1)::DOUBLE / greatest(n - 1, 1) AS x FROM k), y AS (SELECT basket, j, abs(e - CASE WHEN x <= 2::DOUBLE / 3 THEN 0.3::DOUBLE + 0.7::DOUBLE * x / (2::DOUBLE / 3) ELSE 1.0::DOUBLE - 0.5::DOUBLE * (x - 2::DOUBLE / 3) / (1::DOUBLE / 3) END) AS o FROM x)
SELECT basket, round(avg(j), 6) AS jump, round(avg(o), 6) AS off FROM y GROUP BY 1"""


# merge


def _imports(spark, sf):
    """Even parts exist, parts that 3 doesn't divide are imported."""
    p = t(spark, sf, "part")
    old = p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.lit(None).cast("string").alias("album"), F.lit(5).cast("bigint").alias("durationMs"), F.when(F.col("p_partkey") % 4 == 0, F.lit("OLD")).alias("isrc"))
    new = p.where("p_partkey % 3 > 0").select("p_partkey", F.upper("p_name").alias("title"), F.col("p_brand").alias("artist"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).otherwise(F.lit("")).alias("album"), (F.col("p_partkey") % 7 * 100).alias("duration_ms"), F.when(F.col("p_partkey") % 5 == 1, F.lit("NEW")).alias("isrc"))
    return old, new


def merge_tracks(spark, sf):
    return mg.merge_unique(*_imports(spark, sf), ["p_partkey"])


_MERGE = """WITH o AS (SELECT p_partkey, p_name AS title, p_brand AS artist, CAST(5 AS BIGINT) AS dur, CASE WHEN p_partkey % 4 = 0 THEN 'OLD' END AS isrc FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey, upper(p_name) AS title, p_brand AS artist, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS album, p_partkey % 7 * 100 AS dur, CASE WHEN p_partkey % 5 = 1 THEN 'NEW' END AS isrc FROM part WHERE p_partkey % 3 > 0)
SELECT p_partkey, CASE WHEN o.title IS NOT NULL THEN o.title ELSE n.title END AS title, coalesce(o.artist, n.artist) AS artist, n.album, CASE WHEN n.dur > 0 THEN n.dur ELSE o.dur END AS "durationMs", coalesce(n.isrc, o.isrc) AS isrc FROM o FULL JOIN n USING (p_partkey)"""


def merge_fold(spark, sf):
    """The exact sequential merge, a list for each brand."""
    old, new = _imports(spark, sf)
    none = F.lit(None)
    e = old.select(F.col("artist").alias("slug"), F.col("p_partkey").alias("pos"), "title", "artist", "album", "durationMs", "isrc", none.cast("map<string,string>").alias("ids"), none.cast("struct<bpm:double,gain:double,source:string>").alias("features"), F.lower("title").alias("key"))
    i = new.select(F.col("artist").alias("slug"), F.col("p_partkey").alias("pos"), "title", "artist", "album", "duration_ms", "isrc", F.lit("shop").alias("service"), F.col("p_partkey").cast("string").alias("service_id"), F.lower("title").alias("key"))
    return mg.merge_fold(e, i).select("slug", "pos", "title", "artist", "album", "durationMs", "isrc", F.element_at("ids", "shop").alias("shop_id"))


_FOLD = """WITH RECURSIVE o AS (SELECT p_brand AS slug, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'OLD' END AS isrc FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_brand AS slug, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, upper(p_name) AS title, p_name AS key, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS album, p_partkey % 7 * 100 AS dur, CASE WHEN p_partkey % 5 = 1 THEN 'NEW' END AS isrc, CAST(p_partkey AS VARCHAR) AS sid FROM part WHERE p_partkey % 3 > 0),
u AS (SELECT slug FROM o UNION SELECT slug FROM n),
c AS (SELECT slug, map_from_entries(list({'k': isrc, 'v': i})) AS m FROM (SELECT slug, isrc, max(i) AS i FROM o WHERE isrc IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT slug, map_from_entries(list({'k': title, 'v': i})) AS m FROM (SELECT slug, title, max(i) AS i FROM o GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT slug, list({'title': title, 'key': title, 'album': CAST(NULL AS VARCHAR), 'dur': CAST(5 AS BIGINT), 'isrc': isrc, 'sid': CAST(NULL AS VARCHAR)} ORDER BY i) AS r FROM o GROUP BY 1),
z AS (SELECT slug, coalesce(l.r, []) AS r, coalesce(c.m, MAP {}) AS code, coalesce(t.m, MAP {}) AS title, CAST(0 AS BIGINT) AS k FROM u LEFT JOIN l USING (slug) LEFT JOIN c USING (slug) LEFT JOIN t USING (slug)),
f AS (SELECT * FROM z UNION ALL
  SELECT slug, r2, CASE WHEN isrc IS NULL THEN code ELSE map_concat(code, MAP {isrc: i}) END, map_concat(title, MAP {r2[i].key: i}), k FROM (
    SELECT slug, code, title, k, isrc, i, list_transform(r1, lambda x, j: CASE WHEN j = i THEN {'title': x.title, 'key': x.key, 'album': coalesce(album, x.album), 'dur': CASE WHEN dur > 0 THEN dur ELSE x.dur END, 'isrc': coalesce(isrc, x.isrc), 'sid': sid} ELSE x END) AS r2 FROM (
      SELECT g.*, coalesce(hit, len(r) + 1) AS i, CASE WHEN hit IS NULL THEN list_append(r, {'title': ntitle, 'key': key, 'album': CAST(NULL AS VARCHAR), 'dur': CAST(NULL AS BIGINT), 'isrc': CAST(NULL AS VARCHAR), 'sid': CAST(NULL AS VARCHAR)}) ELSE r END AS r1 FROM (
        SELECT f.slug, f.r, f.code, f.title, n.k, n.isrc, n.album, n.dur, n.sid, n.key, n.title AS ntitle, coalesce(CASE WHEN n.isrc IS NOT NULL THEN f.code[n.isrc] END, f.title[n.key]) AS hit FROM f JOIN n ON n.slug = f.slug AND n.k = f.k + 1) g))),
e AS (SELECT slug, max_by(r, k) AS r FROM f GROUP BY slug), w AS (SELECT slug, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM e)
SELECT slug, CAST(i - 1 AS BIGINT) AS pos, x.title AS title, slug AS artist, x.album AS album, x.dur AS "durationMs", x.isrc AS isrc, x.sid AS shop_id FROM w"""


# evaluation


def _held(spark, sf):
    return members(spark, sf).select("basket", F.col("pos").alias("position"), "item")


def holdout_recall(spark, sf):
    tracks = t(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("artist"))
    return ev.holdout_recall(_held(spark, sf), tracks, 2).withColumn("recall", F.round("recall", 6))


_HOLD = f"""WITH {_M}, n AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY pos DESC) <= 2 AS l FROM m), h AS (SELECT DISTINCT basket, item, artist FROM n WHERE l), s AS (SELECT DISTINCT basket, artist FROM n WHERE NOT l)
SELECT h.basket, count(*) AS held, count(s.artist) AS hits, round(count(s.artist)::DOUBLE / count(*), 6) AS recall FROM h LEFT JOIN s ON h.basket = s.basket AND h.artist = s.artist GROUP BY 1"""


def adjacent_repeats(spark, sf):
    return ev.adjacent_repeats(members(spark, sf), "basket", "pos", "artist")


def ranking_metrics(spark, sf):
    """A customer's parts ranked by size, against those of a price over 950."""
    m = members(spark, sf)
    once = m.select("basket", "item", "p_size", "p_retailprice").distinct()
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("basket").orderBy("p_size", "item")))
    out = ev.ranking_metrics(ranked.select("basket", "rank", "item"), once.where("p_retailprice > 950"), 3)
    return out.select("basket", "hit_rate", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "average_precision", "ndcg")], "clicks")


_RANK = f"""WITH {_M}, o AS (SELECT DISTINCT basket, item, p_size, p_retailprice FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY p_size, item) AS rank, CAST(p_retailprice > 950 AS INTEGER) AS rel FROM o),
s AS (SELECT *, sum(rel) OVER (PARTITION BY basket ORDER BY rank) AS sf FROM k),
a AS (SELECT basket, sum(rel) AS n, sum(rel) FILTER (rank <= 3) AS hits, coalesce(sum(sf / rank) FILTER (rank <= 3 AND rel = 1), 0) AS ap, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 3 AND rel = 1), 0) AS dcg, min(rank) FILTER (rel = 1) AS first FROM s GROUP BY 1 HAVING sum(rel) > 0)
SELECT basket, CAST(hits > 0 AS INTEGER) AS hit_rate, round(hits / 3.0::DOUBLE, 6) AS precision, round(hits / n::DOUBLE, 6) AS recall, round(ap / least(n, 3)::DOUBLE, 6) AS average_precision,
round(dcg / CASE least(n, 3) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1 + 1 / log2(3) ELSE 1 + 1 / log2(3) + 1 / log2(4) END, 6) AS ndcg, CAST((first - 1) // 10 AS BIGINT) AS clicks FROM a"""


def r_precision(spark, sf):
    m = members(spark, sf)
    once = m.select("basket", "item", "p_size", "p_retailprice").distinct()
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("basket").orderBy("p_size", "item")))
    return ev.r_precision(ranked.select("basket", "rank", "item"), once.where("p_retailprice > 950")).withColumn("r_precision", F.round("r_precision", 6))


_RPREC = f"""WITH {_M}, o AS (SELECT DISTINCT basket, item, p_size, p_retailprice FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY p_size, item) AS rank FROM o), n AS (SELECT basket, count(*) AS n FROM o WHERE p_retailprice > 950 GROUP BY 1)
SELECT basket, round(count(*) FILTER (p_retailprice > 950 AND rank <= n) / max(n)::DOUBLE, 6) AS r_precision FROM k JOIN n USING (basket) GROUP BY 1"""


def label_diversity(spark, sf):
    e = t(spark, sf, "embeddings")
    out = ev.diversity(e.select(F.col("label").alias("basket"), F.col("vec_id").alias("item")), e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")))
    return out.withColumn("diversity", F.round("diversity", 6))


_DIVERSE = """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.label AS basket, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS diversity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1"""


def concentration(spark, sf):
    return ev.concentration(members(spark, sf), "basket", "artist", "item").select("basket", F.round("top_share", 6).alias("top_share"), F.round("duplicate_rate", 6).alias("duplicate_rate"))


def tempo_steps(spark, sf):
    m = members(spark, sf).withColumn("bpm", F.col("p_size").cast("double") * 4)
    return ev.tempo_steps(m, "basket", "pos", "bpm", 16.0)


def event_counts(spark, sf):
    """Events by hour and type; the same plan runs on a stream."""
    return windowed_counts(t(spark, sf, "events"), "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def event_features(spark, sf):
    """The numeric property of each event from its JSON."""
    return t(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


_NAMES = [
    artist_cooccurrence, track_cooccurrence, neighbours, top_neighbours, playlists_per_artist, pmi, unique_tracks, distinct_artists, library_overview, size_describe, size_histogram, top_artists,
    connectors, union_liked, owned_only, completeness_filter, resolved_count, track_surrogates, resolve_ids, reconcile_prefix, adopt_diff, playlist_decision, append_batches, gather_round_robin, separate,
    curate, flattened, curator_rows, track_total, table_rows, lab_counts, list_tracks, line_surrogates, enrich_counters, camelot_moves, energy_arcs, merge_tracks, merge_fold, holdout_recall, adjacent_repeats, ranking_metrics, r_precision, label_diversity, concentration, tempo_steps, event_counts, event_features,
]
QUERIES = {f.__name__: f for f in _NAMES}

SQL = {
    "artist_cooccurrence": f"WITH {_CAPPED}, {_pairs_sql('artist')} SELECT * FROM pr",
    "track_cooccurrence": f"WITH {_CAPPED}, {_pairs_sql('item')} SELECT * FROM pr",
    "neighbours": f"WITH {_CAPPED}, {_pairs_sql('artist')} SELECT CASE WHEN a = '{SEED}' THEN b ELSE a END AS artist, weight FROM pr WHERE a = '{SEED}' OR b = '{SEED}' ORDER BY weight DESC, artist LIMIT 12",
    "top_neighbours": f"WITH {_CAPPED}, {_pairs_sql('artist')}, s AS (SELECT a AS node, b AS other, weight FROM pr WHERE weight >= 2 UNION ALL SELECT b, a, weight FROM pr WHERE weight >= 2), k AS (SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS INTEGER) AS rank, other, weight FROM s) SELECT * FROM k WHERE rank <= 5",
    "playlists_per_artist": f"WITH {_M} SELECT artist AS member, count(DISTINCT basket) AS n FROM m GROUP BY 1",
    "pmi": f"WITH {_CAPPED}, {_pairs_sql('artist')}, n AS (SELECT count(DISTINCT basket)::DOUBLE AS n FROM m), c AS (SELECT artist, count(DISTINCT basket) AS c FROM m GROUP BY 1) SELECT a, b, weight, round(ln((weight / n) / ((x.c / n) * (y.c / n))), 6) AS pmi FROM pr JOIN c x ON a = x.artist JOIN c y ON b = y.artist, n WHERE weight >= 2",
    "unique_tracks": f"WITH {_M}, k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY basket, pos) AS rn FROM m) SELECT item, basket, CAST(pos AS INTEGER) AS pos, title FROM k WHERE rn = 1",
    "distinct_artists": f"WITH {_M} SELECT basket, count(DISTINCT artist) AS artists FROM m GROUP BY 1",
    "library_overview": f"WITH {_M} SELECT count(DISTINCT basket) AS playlists, count(DISTINCT item) AS unique_tracks, count(*) AS memberships FROM m",
    "size_describe": "WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std, min(size)::DOUBLE AS least, quantile_cont(size, 0.25)::DOUBLE AS q25, quantile_cont(size, 0.5)::DOUBLE AS q50, quantile_cont(size, 0.75)::DOUBLE AS q75, max(size)::DOUBLE AS most FROM s",
    "size_histogram": "WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey), e AS (SELECT min(size) AS lo, max(size) AS hi FROM s) SELECT least(CAST(floor((size - lo)::DOUBLE / (hi - lo) * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS n FROM s, e GROUP BY 1",
    "top_artists": "SELECT p_brand AS artist, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, artist LIMIT 20",
    "connectors": f"WITH {_M} SELECT item, title, artist, count(DISTINCT basket) AS baskets FROM m GROUP BY 1, 2, 3 ORDER BY baskets DESC, item, title, artist LIMIT 15",
    "union_liked": _LIKED,
    "owned_only": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "completeness_filter": f"WITH {_M}, {_R}, x AS (SELECT basket FROM m LEFT JOIN r ON m.item = r.key GROUP BY 1 HAVING count(*) FILTER (target_id IS NULL) > 1) SELECT o_orderkey AS basket FROM orders WHERE o_orderkey NOT IN (SELECT basket FROM x)",
    "resolved_count": f"WITH {_M}, {_R} SELECT basket, count(*) AS tracks, count(target_id) AS resolved, count(*) - count(target_id) AS missing FROM m LEFT JOIN r ON m.item = r.key GROUP BY 1",
    "track_surrogates": "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS id FROM part",
    "resolve_ids": f"WITH {_M}, {_R}, {_WANT} SELECT basket, array_to_string(desired, ',') AS desired FROM w",
    "reconcile_prefix": _RECON,
    "adopt_diff": _ADOPT,
    "playlist_decision": _DECIDE,
    "append_batches": "SELECT user_id AS name, event_id AS pos, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 15 AS batch FROM events",
    "gather_round_robin": _GATHER,
    "separate": _SEPARATE,
    "curate": _CURATE,
    "flattened": f"""WITH {_M} SELECT 'order-' || CAST(basket AS VARCHAR) AS slug, CAST(pos AS INTEGER) AS pos, title, artist, CAST(round(p_retailprice * 100) AS BIGINT) AS "durationMs", CASE WHEN item % 5 = 0 THEN 'C' || CAST(item AS VARCHAR) END AS isrc, CASE WHEN item % 3 = 0 THEN CAST(item AS VARCHAR) END AS apple_id FROM m""",
    "curator_rows": _ROWS,
    "track_total": "SELECT count(*) AS tracks FROM lineitem JOIN part ON l_partkey = p_partkey",
    "table_rows": "SELECT count(*) AS n FROM lineitem WHERE l_orderkey >= 0",
    "lab_counts": _LAB_COUNTS,
    "list_tracks": f"WITH {_M} SELECT CAST(pos AS INTEGER) AS position, title, artist FROM m WHERE basket = 7 AND pos < 40",
    "line_surrogates": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_shipdate, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem",
    "enrich_counters": _COUNTERS,
    "camelot_moves": _CAMELOT,
    "energy_arcs": _ARC,
    "merge_tracks": _MERGE,
    "merge_fold": _FOLD,
    "holdout_recall": _HOLD,
    "adjacent_repeats": f"WITH {_M}, l AS (SELECT basket, artist = lag(artist) OVER (PARTITION BY basket ORDER BY pos) AS same FROM m) SELECT basket, count(*) FILTER (same) AS repeats FROM l GROUP BY 1",
    "ranking_metrics": _RANK,
    "r_precision": _RPREC,
    "label_diversity": _DIVERSE,
    "concentration": f"WITH {_M}, c AS (SELECT basket, artist, count(*) AS c FROM m GROUP BY 1, 2), s AS (SELECT basket, max(c) AS top, sum(c) AS n FROM c GROUP BY 1), d AS (SELECT basket, count(DISTINCT item) AS d FROM m GROUP BY 1) SELECT basket, round(top::DOUBLE / n, 6) AS top_share, round(1 - d::DOUBLE / n, 6) AS duplicate_rate FROM s JOIN d USING (basket)",
    "tempo_steps": f"WITH {_M}, l AS (SELECT basket, p_size * 4.0 AS b, lag(p_size * 4.0) OVER (PARTITION BY basket ORDER BY pos) AS a FROM m) SELECT basket, count(*) FILTER (a > 0 AND b > 0) AS steps, count(*) FILTER (a > 0 AND b > 0 AND (abs(b - a) <= 16 OR abs(b - 2 * a) <= 16 OR abs(2 * b - a) <= 16)) AS smooth FROM l GROUP BY 1",
    "event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_features": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
}
