"""Entity resolution, reconciliation and pushes on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from ostinata import model
from ostinata.operators import library as lb
from ostinata.operators import matching as mt
from ostinata.operators import reconcile as rc
from ostinata.operators import report as rp
from ostinata.plans import flows
from ostinata.sources.tables import TablePort

TRACKS = "ord bigint, title string, artists array<string>, duration_ms bigint, isrc string"
SONGS = "id string, title string, artist string, duration_ms bigint, isrc string, cand_pos bigint"


def matched(spark, tracks, songs):
    t, c = spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(songs, SONGS)
    return {r["ord"]: (r["target_id"], r["confidence"], r["method"]) for r in mt.match(t, c).collect()}


def test_code_lookup_takes_the_closest_duration(spark):
    songs = [("long", "x", "y", 300_000, "AA1", 0), ("close", "x", "y", 180_900, "aa1", 1), ("same", "x", "y", 180_900, "AA1", 2), ("none", "x", "y", 180_000, None, 3)]
    assert matched(spark, [(1, "other", ["z"], 180_000, "aA1")], songs) == {1: ("close", "exact", "isrc")}


def test_two_passes(spark):
    songs = [("s1", "Far", "A", 1000, "C1", 0), ("s2", "Rust", "The Band", 200_500, None, 1), ("s3", "Rust Never", "The Band", 200_000, None, 2), ("s4", "Rust", "Other", 200_000, None, 3)]
    tracks = [
        (1, "Whatever", ["Q"], 1, "c1"),  # code
        (2, "Rust - Remaster", ["The Band", "X"], 200_000, None),  # 0.95, artist, duration
        (3, "Rust", ["The Band"], 999_000, "missing"),  # an unknown code falls to titles
        (4, "Nothing alike", ["The Band"], 200_000, None),
        (5, None, None, None, None),  # an empty title is a prefix of any: 0.4 + 0.15 of no song
    ]
    assert matched(spark, tracks, songs) == {1: ("s1", "exact", "isrc"), 2: ("s2", "high", "search"), 3: ("s2", "high", "search"), 4: (None, "none", "none"), 5: ("s1", "low", "search")}


def test_best_candidates_against_all_pairs(spark):
    """Of all pairs with a positive title score each track's best, the first of equals, whatever its title."""
    from ostinata.functions import text as tx

    rng = random.Random(2)
    titles = ["", "a", "a b", "ab", "a b (x)", "b", "!!", "a b - c", "- a", None, "é", "é e", "(x) - y", "?? - b", "long title of a song", "long title of a song that goes on", "long title"]
    artists = ["q", "The Q Band", "qq", "", None, "band", "the", "Ü", "xqx"]
    t = spark.createDataFrame([(i, rng.choice(titles), [a] if (a := rng.choice(artists)) is not None else [], rng.choice([0, 1000, 2500, 5001, 9000, None]), None) for i in range(150)], TRACKS)
    c = spark.createDataFrame([(str(i), rng.choice(titles), rng.choice(artists), rng.choice([0, 1000, 3500, 7501, 20000]), None, i) for i in range(120)], SONGS)
    pairs = t.select("ord", F.col("title").alias("s"), F.try_element_at("artists", F.lit(1)).alias("a"), F.coalesce("duration_ms", F.lit(0)).alias("ms")).crossJoin(c.select("cand_pos", "id", F.col("title").alias("c"), F.col("artist").alias("b"), F.col("duration_ms").alias("song_ms")))
    scored = pairs.where(tx.title_score("s", "c") > 0).select("ord", "cand_pos", "id", tx.match_score(tx.title_score("s", "c"), tx.contains_norm("b", "a"), F.abs(F.col("ms") - F.col("song_ms")) <= 2500).alias("score"))
    want = {}
    for r in sorted(scored.collect(), key=lambda r: (r["ord"], -r["score"], r["cand_pos"])):
        want.setdefault(r["ord"], (r["id"], r["score"]))
    got = {r["ord"]: (r["target_id"], r["score"]) for r in mt.resolve_by_title(t, c).collect()}
    assert got == {k: v for k, v in want.items() if v[1] >= 0.55}
    few = {r["ord"]: r["target_id"] for r in mt.resolve_by_title(t.where("ord < 0").union(spark.createDataFrame([(1, "Rust - x", ["B"], 0, None)], TRACKS)), spark.createDataFrame([("r0", "Rust", "A", 9999, None, 0), ("r1", "Rust", "B", 0, None, 1), ("r2", "Rust - x", "A", 0, None, 2)], SONGS), 2).collect()}
    assert few == {1: "r2"}
    plan = mt.match(t, c)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_resumed_matches_keep_what_was_found(spark):
    t = spark.createDataFrame([(1, "Rust", ["A"], 0, None), (2, "Dust", ["A"], 0, None), (3, "Lust", ["A"], 0, None)], TRACKS).withColumn("key", F.concat(F.lit("k"), "ord"))
    c = spark.createDataFrame([("new1", "Rust", "A", 0, None, 0), ("new2", "Dust", "A", 0, None, 1)], SONGS)
    prior = spark.createDataFrame([("k1", "old1", "low", "search", None), ("k2", None, "none", "none", "n"), ("gone", "old9", "high", "search", None)], "key string, target_id string, confidence string, method string, note string")
    got = {r["key"]: r["target_id"] for r in mt.match_resumed(t, prior, c).collect()}
    assert got == {"k1": "old1", "k2": "new2", "k3": None}
    s = rp.match_summary(mt.match_resumed(t, prior, c)).first()
    assert (s["total"], s["matched"], s["low"], s["high"], s["unmatched"], s["percent"]) == (3, 2, 1, 1, 1, 66.7)
    assert rp.match_summary(t.limit(0).withColumn("confidence", F.lit("x"))).first()["percent"] is None


@pytest.mark.parametrize(
    ("recorded", "to_add", "ordered"),
    [([], ["a", "b", "c"], True), (["a", "b"], ["c"], True), (["a", "b", "c"], [], True), (["b"], ["a", "c"], False), (["a", "b", "c", "d"], [], False), (None, ["a", "b", "c"], True)],
)
def test_reconcile(spark, recorded, to_add, ordered):
    df = spark.createDataFrame([(recorded, ["a", "b", "c"])], "recorded array<string>, desired array<string>")
    r = rc.reconcile(df).first()
    assert (r["to_add"], r["ordered"]) == (to_add, ordered)


def playlists(spark, lists):
    rows = [(i, name, None, None, None, None, [(t, [a], None, 0, None, None, None) for t, a in tracks]) for i, (name, tracks) in enumerate(lists)]
    return spark.createDataFrame(rows, "ord bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.PLAYLIST))


def state_of(spark, rows=()):
    return spark.createDataFrame(list(rows), model.STATE)


def plan_of(df):
    return {r["name"]: (r["action"], r["to_add"], r["ordered"]) for r in df.collect()}


def test_push_is_idempotent_and_resumes(spark):
    lists = playlists(spark, [("One", [("Rust", "A"), ("Dust", "A"), ("Lost", "A"), ("Rust", "A")]), ("One", [("Dust", "A")]), ("", [])])
    songs = spark.createDataFrame([("r", "Rust", "A", 0, None, 0), ("d", "Dust", "A", 0, None, 1)], SONGS)
    port = TablePort(songs, spark.createDataFrame([], "name string, id string, ord int"), spark.createDataFrame([], model.REFS))
    m = flows.match_library(lists, port)
    assert m.count() == 3
    state = state_of(spark)
    plan = flows.push(lists, m, state, port)
    assert plan_of(plan) == {"One": ("create", ["r", "d"], True), "One (2)": ("create", ["d"], True), "Untitled Playlist": ("create", [], True)}
    after = spark.createDataFrame(rc.next_state(state, plan).collect(), model.STATE)
    assert {k: v[:2] for k, v in plan_of(flows.push(lists, m, after, port)).items()} == {k: ("resume", []) for k in ("One", "One (2)", "Untitled Playlist")}
    half = state_of(spark, [("One", "t1", ["r"], False, False)])
    assert plan_of(flows.push(lists, m, half, port))["One"] == ("resume", ["d"], True)
    # a list with a missing track is left out under a limit of none
    assert set(plan_of(flows.push(lists, m, state, port, max_missing=0))) == {"One (2)", "Untitled Playlist"}


def test_existing_targets_are_skipped_or_adopted(spark):
    lists = playlists(spark, [("One", [("Rust", "A"), ("Dust", "A"), ("Must", "A")])])
    songs = spark.createDataFrame([("r", "Rust", "A", 0, None, 0), ("d", "Dust", "A", 0, None, 1), ("m", "Must", "A", 0, None, 2)], SONGS)
    there = spark.createDataFrame([("One", "old", 1), ("One", "new", 2)], "name string, id string, ord int")
    port = TablePort(songs, there, spark.createDataFrame([("new", "DUST!", "a"), ("old", "Must", "A")], model.REFS))
    m = flows.match_library(lists, port)
    assert plan_of(flows.push(lists, m, state_of(spark), port)) == {"One": ("skip", [], True)}
    plan = flows.push(lists, m, state_of(spark), port, adopt=True)
    assert plan_of(plan) == {"One": ("adopt", ["r", "m"], True)}
    after = spark.createDataFrame(rc.next_state(state_of(spark), plan).collect(), model.STATE)
    assert after.first()["adopted"] and plan_of(flows.push(lists, m, after, port, adopt=True))["One"][1] == []


def test_create_plans_one_list(spark):
    songs = spark.createDataFrame([("r", "Rust", "A", 0, None, 0)], SONGS)
    port = TablePort(songs, spark.createDataFrame([], "name string, id string, ord int"), spark.createDataFrame([], model.REFS))
    tracks = spark.createDataFrame([(0, "Rust", ["A"]), (1, "Nope", [])], "pos bigint, title string, artists array<string>")
    assert plan_of(flows.create("Mine", tracks, state_of(spark), port)) == {"Mine": ("create", ["r"], True)}
    with pytest.raises(ValueError):
        flows.create("", tracks, state_of(spark), port)


def test_names_filters_and_ids(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["A", " A ", None, "", "A", "B"])], "ord int, name string")
    assert [r["name"] for r in lb.unique_names(names).orderBy("ord").collect()] == ["A", "A (2)", "Untitled Playlist", "Untitled Playlist (2)", "A (3)", "B"]
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = lb.with_ids(rows, ["g", "k"]).orderBy("g", "k").collect()
    assert [r["id"] for r in got] == list(range(1, 1001))
    p = spark.createDataFrame([(f"p{i}", f"n{i}", None, o, i) for i, o in enumerate(["me", "you"])], "id string, name string, description string, owner_id string, ord int")
    items = spark.createDataFrame([("p0", 1, "track", "b"), ("p0", 0, "", "a"), ("p0", 2, "episode", "c"), ("p0", 3, None, None)], "playlist_id string, pos int, type string, track string")
    liked = spark.createDataFrame([(0, "track", "z")], "pos int, type string, track string")
    got = [(r["name"], r["kind"], r["tracks"]) for r in lb.pull(p, items, liked, "me").orderBy("ord").collect()]
    assert got == [("n0", "owned", ["a", "b"]), ("n1", "followed", []), (lb.LIKED, "liked_songs", ["z"])]
    assert [r["name"] for r in lb.pull(p, items, liked.limit(0), "me", owned_only=True).collect()] == ["n0"]
    members = spark.createDataFrame([(0, i) for i in range(205)], "name int, pos int")
    assert {r["batch"]: r["n"] for r in rc.batches(members).groupBy("batch").agg(F.count("*").alias("n")).collect()} == {0: 100, 1: 100, 2: 5}
