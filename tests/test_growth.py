"""Work that follows the different inputs, not their repetitions: rows that the plans form, memory and parts."""

import re
from itertools import zip_longest

from pyspark.sql import functions as F

from ostinata.functions import text as tx
from ostinata.operators import affinity as af
from ostinata.operators import curate as cu
from ostinata.operators import library as lb
from ostinata.operators import matching as mt
from ostinata.operators import merge as mg
from ostinata.plans import lab, queries_baskets

TRACKS = "ord bigint, title string, artists array<string>, duration_ms bigint, isrc string"
SONGS = "id string, title string, artist string, duration_ms bigint, isrc string, cand_pos bigint"


def most_rows(df):
    """The result, and the most rows that any operator of its plan put out."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
        n = p.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, most


def alike(spark):
    """Tracks and songs of one title: 3000 tracks of four kinds, 200 songs of eight."""
    t = spark.range(3000).select(F.col("id").alias("ord"), F.lit("Rust").alias("title"), F.array(F.concat(F.lit("a"), F.col("id") % 2)).alias("artists"), (F.col("id") % 4 * 9000).alias("duration_ms"), F.lit(None).cast("string").alias("isrc"))
    c = spark.range(200).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("Rust").alias("title"), F.concat(F.lit("the a"), F.col("id") % 2).alias("artist"), (F.col("id") % 8 * 9000).alias("duration_ms"), F.lit(None).cast("string").alias("isrc"), F.col("id").alias("cand_pos"))
    return t, c


def test_equal_titles_are_resolved_once(spark):
    t, c = alike(spark)
    rows, most = most_rows(mt.resolve_by_title(t, c))
    assert {(r["ord"], r["target_id"]) for r in rows} == {(i, f"s{i % 4}") for i in range(3000)}
    assert most <= 3000


def test_match_resolves_equal_tracks_once(spark):
    t, c = alike(spark)
    coded = F.when(F.col("ord") % 3 == 0, F.lit("x1"))
    rows, most = most_rows(mt.match(t.withColumn("isrc", coded), c.withColumn("isrc", F.when(F.col("cand_pos") >= 100, F.lit("X1")))))
    # by code the closest of the later songs, by title the best of all
    near = {0: "s104", 1: "s105", 2: "s106", 3: "s107"}
    assert {(r["ord"], r["target_id"], r["method"]) for r in rows} == {(i, f"s{i % 4}", "search") if i % 3 else (i, near[i % 4], "isrc") for i in range(3000)}
    assert most <= 3000


def test_resumed_match_resolves_equal_tracks_once(spark):
    t, c = alike(spark)
    t = t.withColumn("key", F.concat(F.lit("k"), "ord"))
    prior = t.where("ord < 10").select("key", F.lit("old").alias("target_id"), F.lit("low").alias("confidence"), F.lit("search").alias("method"), F.lit(None).cast("string").alias("note"))
    rows, most = most_rows(mt.match_resumed(t, prior, c))
    assert {(r["key"], r["ord"], r["target_id"]) for r in rows} == {(f"k{i}", i, f"s{i % 4}" if i >= 10 else "old") for i in range(3000)}
    assert most <= 3000


def test_equal_tracks_are_enriched_once(spark):
    t, c = alike(spark)
    t = t.select("ord", "title", F.element_at("artists", 1).alias("artist"), F.col("duration_ms").alias("durationMs"))
    c = c.select(F.col("cand_pos").alias("id"), "title", "artist", F.col("cand_pos").cast("int").alias("duration_sec"), "cand_pos").withColumn("duration_sec", F.col("duration_sec") % 8 * 9)
    rows, most = most_rows(mg.pick_features(t, c))
    # without a duration the first candidate
    assert {(r["ord"], r["id"], r["delta"]) for r in rows} == {(i, i % 4, 0 if i % 4 else 1 << 30) for i in range(3000)}
    assert most <= 3000


def test_memberships_take_as_many_parts_as_they_need(spark, sf, monkeypatch):
    monkeypatch.setattr(lb, "ROWS_A_TASK", 500, raising=False)
    m = queries_baskets.members(spark, sf).select("basket", F.spark_partition_id().alias("p"))
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    sizes = m.groupBy("p").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 1000 and sum(r["count"] for r in sizes) == n
    assert m.distinct().groupBy("basket").count().where("count > 1").isEmpty()
    pairs = queries_baskets.track_cooccurrence(spark, sf)
    assert pairs.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 1000


def test_pools_normalise_each_spelling_once(spark):
    """Members of few spellings: what is normalised is the first of each, and the first of all spellings that are alike stays."""
    rows = spark.range(4000).select((3999 - F.col("id")).alias("ord"), F.lit(0).alias("pos"), F.when(F.col("id") % 2 == 0, F.lit("A!")).otherwise(F.lit("a")).alias("artist"), F.concat(F.lit("T"), F.col("id") % 3).alias("title")).repartition(3)
    pool = cu.pools(rows)
    assert sorted((r["artist_norm"], r["title_norm"], r["ord"], r["artist"]) for r in pool.collect()) == [("a", "t0", 0, "a"), ("a", "t1", 2, "a"), ("a", "t2", 1, "A!")]
    names = pool._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(names) if "regexp_replace" in x)
    assert any("Window" in x for x in names[first + 1 :])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_pairs_move_no_memberships_that_lie_by_basket(spark):
    """Only what was counted moves, and nothing is sorted or made twice."""
    rows = spark.range(2000).select((F.col("id") % 500).alias("ord"), F.concat(F.lit("a"), F.col("id") % 7).alias("artist")).repartition(9, "ord")
    pairs = af.cooccurrence(rows, "ord", "artist")
    assert exchanges(pairs) == 2  # by basket, and the counted pairs
    assert {(r["a"], r["b"], r["weight"]) for r in pairs.collect()} == {(r["a"], r["b"], r["weight"]) for r in af.cooccurrence(rows.repartition(2), "ord", "artist").collect()}
    assert most_rows(pairs)[1] < 4 * 500 * 6


def test_lab_norm_of_every_character():
    """The JVM's table is right for each of Unicode's characters; few are left to Python, and no letter with an accent."""
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    folds = dict(zip_longest(*tx._folds(), fillvalue=""))
    for c in chars:
        one = folds.get(c, c)
        if one != tx._SEVERAL:
            assert re.sub(r"[^0-9a-z]+", " ", f"x{one.lower()}x") == tx.lab_norm_text(f"x{c}x")
    assert sum(v == tx._SEVERAL for v in folds.values()) < 2000 and not {"é", "Å", "ñ", "ß", "ｆ", "𝐀"} & {c for c, v in folds.items() if v == tx._SEVERAL}


def test_lab_norm_keeps_texts_in_the_jvm(spark):
    texts = ["plain", "Ünïcode — ÇA", "ｆｕｌｌ 𝐛𝐨𝐥𝐝", "日本 語x", "éạ́", "İK", "ﬁn ½ ™", "a", "", None, "a　b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", tx.lab_norm("t").alias("n")).orderBy("i").collect()]
    assert got == [tx.lab_norm_text(t) for t in texts]
    asked = df.select("t", tx.lab_norm("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in asked


def library(spark):
    rows = spark.range(60).select((F.col("id") % 6).alias("ord"), (F.col("id") / 6).cast("int").alias("pos"), F.concat(F.lit("T"), F.col("id") % 4).alias("title"), F.when(F.col("id") % 3 == 0, "É").otherwise(F.lit("e")).alias("artist"))
    none = F.lit(None)
    track = F.struct("title", "artist", none.cast("string").alias("album"), F.col("ord").cast("string").alias("isrc"), none.cast("map<string,string>").alias("ids"))
    return rows.groupBy("ord").agg(lb.in_order("pos", track).alias("tracks")).select("ord", F.concat(F.lit("l"), "ord").alias("slug"), F.lit("x").alias("name"), "tracks")


def test_lab_makes_the_library_once(spark):
    """And keys for each spelling, of which the first member's of all alike names the track."""
    found = lab.open_lab(library(spark))
    for df in (*found.values(), lab.q(spark, lab.COUNTS)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "ArrowEvalPython" not in plan and "translate" not in plan
    assert lab.q(spark, lab.COUNTS).first().asDict() == {"playlists": 6, "tracks": 4, "memberships": 60, "track_pairs": 2, "artist_pairs": 0}
    want = {}
    for r in sorted(library(spark).collect(), key=lambda r: r["ord"]):
        for x in r["tracks"]:
            want.setdefault(tx.lab_norm_text(x["title"]), (x["title"], x["artist"], x["isrc"]))
    assert [(r["title"], r["artist"], r["isrc"]) for r in found["tracks"].orderBy("id").collect()] == list(want.values())


def test_lists_are_ordered_without_a_comparison_in_sql(spark):
    """Ties keep the order in which they are met, members may have maps."""
    rows = spark.createDataFrame([(3, {"a": 1}), (1, {"b": 2}), (2, None), (1, {"c": 3})], "p int, m map<string,int>").coalesce(1)
    got = rows.agg(lb.in_order("p", "m").alias("l"))
    assert got.first()["l"] == [{"b": 2}, {"c": 3}, None, {"a": 1}]
    assert "sort_array" in got._jdf.queryExecution().optimizedPlan().toString()
