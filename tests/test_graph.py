"""Co-occurrence, curation, merging, enrichment and evaluation on small tables."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ostinata.operators import affinity as af
from ostinata.operators import curate as cu
from ostinata.operators import evaluate as ev
from ostinata.operators import merge as mg
from ostinata.operators import report as rp
from ostinata.plans import flows

MEMBERS = "ord bigint, pos bigint, title string, artist string"


def baskets(seed=3, n=40):
    rng = random.Random(seed)
    return [(b, p, f"t{rng.randrange(30)}", rng.choice(["", None, *"ABCDEFGH"])) for b in range(n) for p in range(rng.randrange(1, 9))]


def test_cooccurrence_against_brute_force(spark):
    rows = baskets()
    sets, sizes = {}, Counter(b for b, *_ in rows)
    for b, _, _, a in rows:
        if a and sizes[b] <= 6:
            sets.setdefault(b, set()).add(a)
    want = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame(rows, MEMBERS)
    got = {(r["a"], r["b"]): r["weight"] for r in af.cooccurrence(df, "ord", "artist", 6).collect()}
    assert got == want
    pairs = af.cooccurrence(df, "ord", "artist", 6)
    near = sorted(((-w, b if a == "A" else a) for (a, b), w in want.items() if "A" in (a, b)))[:3]
    assert [(-r["weight"], r["artist"]) for r in af.neighbours(pairs, "A", 3).collect()] == near
    total = spark.createDataFrame([(40,)], "n bigint")
    per = af.baskets_per_member(df, "ord", "artist")
    n = {r["member"]: r["n"] for r in per.collect()}
    for r in af.pmi(pairs, per, total, 2).collect():
        assert r["pmi"] == pytest.approx(math.log(r["weight"] * 40 / (n[r["a"]] * n[r["b"]])))


def greedy(artists, last=None):
    """The separation rule, step by step; a list around a seed begins as if after an empty artist."""
    left, out = list(range(len(artists))), []
    while left:
        count = Counter(artists[i] for i in left)
        other = [i for i in left if artists[i] != last]
        i = max(other, key=lambda i: (count[artists[i]], -left.index(i))) if other else left[0]
        out.append(i)
        left.remove(i)
        last = artists[i]
    return out


def test_separation_follows_the_rule(spark):
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(0, 14))]
        assert cu.separate_order(a) == greedy(a)
        a = [x.replace("d", "") for x in a]
        assert cu.separate_order(a, "") == greedy(a, "")
    assert cu.separate_order(["", "", "a"], "") == [2, 0, 1] and cu.separate_order(["", "", "a"]) == [0, 2, 1]
    rows = [(b, i, rng.choice("abc")) for b in range(5) for i in range(9)]
    got = cu.separate(spark.createDataFrame(rows, "b int, i int, a string"), "b", "i", "a").orderBy("b", "place").collect()
    for b in range(5):
        mine = [r[2] for r in rows if r[0] == b]
        assert [r["i"] for r in got if r["b"] == b] == greedy(mine)


@pytest.mark.parametrize("size", ["3", "7", "10000"])
def test_separation_over_batch_borders(spark, size):
    """Collections are put together whatever the size of Arrow batches, and each keeps its rows."""
    rng = random.Random(int(size))
    rows = [(b, i, rng.choice(["a", "b", "c", "", None])) for b in range(40) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "b int, i int, a string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        for last in (None, ""):
            got = {}
            for r in cu.separate(df, "b", "i", "a", last).orderBy("b", "place").collect():
                got.setdefault(r["b"], []).append((r["i"], r["place"]))
            for b in range(40):
                mine = [a or "" for k, _, a in rows if k == b]
                assert got[b] == [(i, n + 1) for n, i in enumerate(greedy(mine, last))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cu.separate(df.limit(0), "b", "i", "a").count() == 0


def test_arc_keeps_artists_apart(spark):
    rng = random.Random(9)
    for _ in range(50):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 14))]
        e = [rng.random() for _ in a]
        order = cu.arc_order(a, e)
        assert sorted(order) == list(range(len(a)))
        repeats = lambda o: sum(a[x] == a[y] for x, y in zip(o, o[1:]))
        assert repeats(order) <= repeats(greedy(a))
    rows = [(1, i, x, float(i) / 6) for i, x in enumerate("abcdef")] + [(2, 0, "a", None)]
    out = cu.sequence_arc(spark.createDataFrame(rows, "b int, i int, a string, e double"), "b", "i", "a", "e").orderBy("b", "place").collect()
    assert [r["i"] for r in out if r["b"] == 1][0] == 2 and len(out) == 7


def test_curation(spark):
    lists = {0: [("s1", "Seed"), ("n1", "Near"), ("o1", "Other")], 1: [("s2", "seed!"), ("n2", "Near"), ("n1", "near")], 2: [("j1", "Jazz"), ("j2", "Jazzy")]}
    df = spark.createDataFrame([(b, p, t, a) for b, ts in lists.items() for p, (t, a) in enumerate(ts)], MEMBERS)
    got = flows.curate_library(df, "SEED", size=10).orderBy("place").collect()
    assert {r["title"] for r in got} == {"s1", "s2", "n1", "n2", "o1"} and got[0]["name"] == "Around SEED"
    assert all(a["artist"].lower().strip("!") != b["artist"].lower().strip("!") for a, b in zip(got, got[1:]))
    assert {r["artist"].lower().strip("!") for r in cu.curate(df, "seed", breadth=1).collect()} == {"seed", "near"}
    assert cu.curate(df, "nobody").count() == 0 and cu.curate(df.limit(0), "seed").count() == 0
    assert cu.curate(df, "seed", size=2).count() == 2
    more = df.withColumn("isrc", F.concat(F.lit("C"), "title"))
    assert all(r["isrc"] == "C" + r["title"] for r in cu.curate(more, "seed").collect())
    with pytest.raises(ValueError):
        flows.curate_library(df, " ")


def lists_of(spark, rows):
    s = "slug string, pos bigint, title string, artist string, album string, durationMs bigint, isrc string, ids map<string,string>, features struct<bpm:double,gain:double,source:string>, key string"
    return spark.createDataFrame(rows, s)


def imports_of(spark, rows):
    return spark.createDataFrame(rows, "slug string, pos bigint, title string, artist string, album string, duration_ms bigint, isrc string, service string, service_id string, key string")


def test_merge_folds_in_order(spark):
    old = lists_of(spark, [("l", 0, "Rust - Remaster", "A", "Old", 10, "AB1", {"x": "1"}, None, "rust"), ("l", 1, "Dust", "B", None, None, None, None, (120.0, -7.0, "f"), "dust"), ("kept", 0, "K", "C", None, None, None, None, None, "k")])
    new = imports_of(
        spark,
        [
            ("l", 0, "Nothing like it", "Z", "New", 20, "ab1", "y", "2", "nothing like it"),  # by code, whatever its case
            ("l", 1, "Dust (Live)", "Other", "", 0, "CD2", "y", "3", "dust"),  # by base title, whoever plays it
            ("l", 2, "Fresh", "D", None, None, None, "", "", "fresh"),
            ("l", 3, "Fresh - Edit", "E", "Alb", 5, None, "y", "4", "fresh"),  # meets the one before
            ("new", 0, "N", "F", None, 7, None, "y", "5", "n"),
        ],
    )
    got = {(r["slug"], r["pos"]): r for r in mg.merge_fold(old, new).collect()}
    assert {k: r["title"] for k, r in got.items()} == {("l", 0): "Rust - Remaster", ("l", 1): "Dust", ("l", 2): "Fresh", ("kept", 0): "K", ("new", 0): "N"}
    a, b, c = got["l", 0], got["l", 1], got["l", 2]
    assert (a["album"], a["durationMs"], a["isrc"], a["ids"]) == ("New", 20, "ab1", {"x": "1", "y": "2"})
    assert (b["album"], b["durationMs"], b["isrc"], b["ids"], b["features"]["bpm"]) == (None, None, "CD2", {"y": "3"}, 120.0)
    assert (c["artist"], c["album"], c["durationMs"], c["ids"]) == ("D", "Alb", 5, {"y": "4"})
    assert mg.merge_fold(old.limit(0), new.limit(0)).count() == 0


def test_id_maps(spark):
    df = spark.createDataFrame([({"a": "1"}, "a", "2"), (None, "a", "2"), ({"a": "1"}, "", "2"), ({"a": "1"}, "b", None)], "m map<string,string>, s string, i string")
    assert [r[0] for r in df.select(mg.merge_ids(F.col("m"), F.col("s"), F.col("i"))).collect()] == [{"a": "2"}, {"a": "2"}, {"a": "1"}, {"a": "1"}]


def test_feature_lookup(spark):
    songs = spark.createDataFrame(
        [(1, "Rust (Live)", "Band", 240, "L", 100.0, -1.0, 0), (2, "Rust", "Tribute to Nobody", 180, "T", 101.0, -2.0, 1), (3, "Rust", "The Band", 181, "R", 102.0, -3.0, 2), (4, "Far", "Band", 60, "F", 103.0, 0.0, 3), (5, "Zero", "Band", 10, "Z", 0.0, 0.0, 4)],
        "id bigint, title string, artist string, duration_sec int, isrc string, bpm double, gain double, cand_pos bigint",
    )
    s = "ord bigint, title string, artist string, durationMs bigint, isrc string, features struct<bpm:double,gain:double,source:string>"
    tracks = spark.createDataFrame([(0, "Rust", "Band", 180_000, None, None), (1, "Far", "Band", 180_000, None, None), (2, "Rust", "Band", None, "own", None), (3, "Rust", "Band", 180_000, None, (90.0, 0.0, "x")), (4, "Zero", "Band", 10_000, "", None)], s)
    assert {r["ord"]: r["id"] for r in mg.pick_features(tracks, songs).collect()} == {0: 3, 2: 1, 3: 3, 4: 5}
    done, counts = flows.enrich_library(tracks, songs)
    got = {r["ord"]: (r["isrc"], r["features"] and r["features"]["bpm"]) for r in done.collect()}
    assert got == {0: ("R", 102.0), 1: (None, None), 2: ("own", 100.0), 3: (None, 90.0), 4: ("Z", None)}
    assert counts.first().asDict() == {"searched": 4, "with_isrc": 2, "with_bpm": 2}


def test_evaluation(spark):
    m = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "a")], "basket int, position int, item string")
    who = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "X"), ("d", "Z")], "item string, artist string")
    got = {r["basket"]: (r["held"], r["hits"], r["recall"]) for r in ev.holdout_recall(m, who, 2).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 0, 0.0)}
    ranked = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("abcdefghijkl")] + [(2, 1, "q")], "basket int, rank int, item string")
    rel = spark.createDataFrame([(1, "b"), (1, "l"), (2, "z")], "basket int, item string")
    r = {x["basket"]: x for x in ev.ranking_metrics(ranked, rel, 3).collect()}
    assert (r[1]["hit_rate"], r[1]["recall"], r[1]["clicks"]) == (1, 0.5, 0) and r[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (r[2]["hit_rate"], r[2]["ndcg"], r[2]["clicks"]) == (0, 0.0, 51)
    assert {x["basket"]: x["r_precision"] for x in ev.r_precision(ranked, rel).collect()} == {1: 0.5, 2: 0.0}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 0.0]), ("d", [0.0, 0.0])], "item string, v array<double>")
    assert ev.diversity(m.where("basket = 1"), v).first()["diversity"] == pytest.approx(2 / 3)
    c = ev.concentration(m.join(who, "item"), "basket", "artist", "item").where("basket = 1").first()
    assert (c["top_share"], c["duplicate_rate"]) == (0.5, 0.0)
    steps = spark.createDataFrame([(1, 0, 100.0), (1, 1, 104.0), (1, 2, 52.0), (1, 3, 90.0), (1, 4, None)], "b int, p int, bpm double")
    assert ev.tempo_steps(steps, "b", "p", "bpm").first()[1:] == (3, 2)
    assert ev.adjacent_repeats(m.join(who, "item").replace("Y", "X", "artist"), "basket", "position", "artist").where("basket = 1").first()["repeats"] == 2


def test_keys_arcs_and_further_dimensions(spark):
    keys = spark.createDataFrame([(k, m) for k in (*range(12), 12, None) for m in (0, 1, 2)], "k int, m int")
    got = {(r["k"], r["m"]): r["c"] for r in keys.select("k", "m", ev.camelot(F.col("k"), F.col("m")).alias("c")).collect()}
    assert (got[0, 1], got[9, 0], got[7, 1], got[4, 0], got[11, 1], got[6, 0], got[12, 1], got[0, 2], got[None, 1]) == ("8B", "8A", "9B", "9A", "1B", "11A", None, None, None)
    assert len({v for v in got.values() if v}) == 24
    m = spark.createDataFrame([(1, i, c) for i, c in enumerate(["8B", "9B", "8B", "8A", "10A", "10A", "3B", None, "3B", "12B", "1B"])] + [(2, 0, "1A")], "b int, p int, c string")
    assert {r["b"]: (r["steps"], r["smooth"]) for r in ev.camelot_steps(m, "b", "p", "c").collect()} == {1: (8, 6), 2: (0, 0)}
    e = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.65), (1, 2, 1.0), (1, 3, 0.5), (1, 4, None), (2, 0, 0.9)], "b int, p int, e double")
    got = {r["b"]: r for r in ev.energy_arc(e, "b", "p", "e").collect()}
    assert got[1]["jump"] == pytest.approx(0.4) and got[1]["off"] == pytest.approx(0) and got[2]["jump"] is None
    tracks = spark.createDataFrame([(0, "Rust", "Band", 180_000), (1, "None", "Band", 0)], "ord bigint, title string, artist string, durationMs bigint")
    songs = spark.createDataFrame([(7, "Rust (Live)", "The Band", 181, 0, 5, "la la")], "id bigint, title string, artist string, duration_sec int, cand_pos bigint, key int, lyrics string")
    assert {r["ord"]: (r["key"], r["lyrics"]) for r in mg.lookup_dimension(tracks, songs, "key", "lyrics").collect()} == {0: (5, "la la"), 1: (None, None)}


def test_item_vectors(spark):
    m = spark.createDataFrame([(b, i, f"i{(b % 2) * 5 + i}") for b in range(60) for i in range(5)], "basket int, position int, item string")
    model = ev.item_vectors(m, size=8, window=4)
    assert model.getVectors().count() == 10


def test_reports(spark):
    s = spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 10)], "n int")
    d = rp.describe(s, "n").first()
    assert (d["n"], d["q25"], d["q50"], d["q75"], d["most"]) == (5, 2.0, 2.0, 3.0, 10)
    assert {r["bin"]: r["n"] for r in rp.histogram(s, "n", 3).collect()} == {1: 4, 3: 1}
    assert {r["bin"]: r["n"] for r in rp.histogram(s.where("n = 2"), "n", 3).collect()} == {1: 2}
    un = spark.createDataFrame([(i, None if i % 2 else "x", "t" * 80) for i in range(130)], "ord int, target_id string, title string")
    assert rp.unmatched(un).count() == 50 and rp.unmatched_more(un).first()["more"] == 15 and len(rp.unmatched(un).first()["title"]) == 60
    assert rp.track_count(spark.createDataFrame([([1, 2],), ([],), (None,)], "tracks array<int>")).first()["tracks"] == 2
