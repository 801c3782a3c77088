"""Sources, sinks, the analysis tables and the streams."""

import datetime
import io
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from ostinata import model
from ostinata.functions.text import lab_norm_text
from ostinata.plans import flows, lab
from ostinata.sources import lists, paged, services, sinks, tables, wire
from ostinata.streaming import imports
from paged_fixture import fetch


@pytest.fixture
def folder(tmp_path):
    docs = {
        "b-list": {"name": "B", "tracks": [{"title": "Rust", "artist": "A", "durationMs": 5, "isrc": "X1", "ids": {"appleMusic": "9"}, "features": {"bpm": 120.5, "gain": -7, "source": "f"}, "unknown": 1}, {"title": "Dust", "artist": "B"}]},
        "a-list": {"tracks": [{"title": "rust!", "artist": "a"}, {"title": "Lust", "artist": "B"}]},
        "c-list": {"name": "C"},
    }
    for k, d in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=2))
    return str(tmp_path)


def test_library_scan(spark, folder, tmp_path_factory):
    rows = lists.read_library(spark, folder).orderBy("ord").collect()
    assert [(r["ord"], r["slug"], r["name"], len(r["tracks"])) for r in rows] == [(0, "a-list", "a-list", 2), (1, "b-list", "B", 2), (2, "c-list", "C", 0)]
    t = rows[1]["tracks"][0]
    assert (t["durationMs"], t["ids"], t["features"]["bpm"]) == (5, {"appleMusic": "9"}, 120.5)
    with pytest.raises(FileNotFoundError):
        lists.read_library(spark, str(tmp_path_factory.mktemp("none")))


def test_broken_files(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"name": "x", "tracks": [')
    with pytest.raises(Exception):
        lists.read_list(spark, str(tmp_path / "bad.json")).collect()
    for path in ("bad.json", "missing.json"):
        r = lists.read_tolerant(spark, str(tmp_path / path), "Forced").collect()
        assert len(r) == 1 and r[0]["name"] == "Forced" and r[0]["tracks"] == []


def test_track_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# mine\n\n One — A \nTwo | B\r\nThree - C\nFour\n")
    name, t = lists.read_track_list(spark, str(tmp_path / "l.txt"), "Mine")
    assert name == "Mine" and [(r["title"], r["artists"]) for r in t.orderBy("pos").collect()] == [("One", ["A"]), ("Two", ["B"]), ("Three", ["C"]), ("Four", [])]
    (tmp_path / "l.JSON").write_text(json.dumps({"name": "Own", "n": 2, "tracks": [{"title": "T", "artist": "A, B ,", "position": 1}, {"title": " "}]}))
    name, t = lists.read_track_list(spark, str(tmp_path / "l.JSON"))
    assert name == "Own" and [(r["title"], r["artists"]) for r in t.collect()] == [("T", ["A", "B"])]
    (tmp_path / "e.txt").write_text("# nothing\n")
    with pytest.raises(ValueError):
        lists.read_track_list(spark, str(tmp_path / "e.txt"), "E")
    with pytest.raises(ValueError):
        lists.read_track_list(spark, str(tmp_path / "l.txt"))


def test_snapshot_and_state_round_trips(spark, tmp_path):
    p = spark.createDataFrame([(1, "B", None, "owned", "me", "id1", [("T", ["A"], None, 3, None, "s", None)]), (0, "A", "d", "followed", "you", "id0", [])], "ord int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.PLAYLIST))
    sinks.save_snapshot(p, "me", str(tmp_path / "snap"))
    back = tables.load_snapshot(spark, str(tmp_path / "snap")).orderBy("ord").collect()
    assert [(r["ord"], r["name"]) for r in back] == [(0, "A"), (1, "B")] and back[1]["tracks"][0]["artists"] == ["A"]
    assert tables.load_state(spark, str(tmp_path / "nothing")).count() == 0
    sinks.overwrite(spark.createDataFrame([("A", "t", ["x"], True, False)], model.STATE), str(tmp_path / "state"))
    assert tables.load_state(spark, str(tmp_path / "state")).first()["added_ids"] == ["x"]
    plan = spark.createDataFrame([("A", [str(i) for i in range(101)]), ("B", [])], "name string, to_add array<string>")
    sinks.append_tracks(plan, str(tmp_path / "t"))
    sinks.append_tracks(plan, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("batch").count().orderBy("batch").collect() == [(0, 200), (1, 2)]


IMPORTED = "list string, pos bigint, title string, artist string, album string, duration_ms bigint, isrc string, service string, service_id string"


class Shop:
    """A service with two lists of one slug, one that broke off after its first page and one without tracks."""

    label = "shop"

    def __init__(self, spark):
        self.spark = spark

    def lists(self):
        return self.spark.createDataFrame([("B List!", 0, None), ("b list", 1, None), ("Bad", 2, "no access"), ("Empty", 3, None)], "list string, ord bigint, error string")

    def tracks(self):
        rows = [("B List!", 0, "RUST", "Q", "Alb", 7, None, "shop", "1"), ("b list", 0, "Must", "A", None, None, None, "shop", "2"), ("Bad", 0, "x", "y", None, None, None, "shop", "3")]
        return self.spark.createDataFrame(rows, IMPORTED)


def test_import_merges_by_slug_and_keeps_partial_lists(spark, folder):
    from ostinata.operators.library import flatten

    old = flatten(lists.read_library(spark, folder), "slug").where("slug = 'b-list'")
    out = flows.import_lists(old, Shop(spark)).orderBy("slug", "pos").collect()
    assert [(r["slug"], r["title"]) for r in out] == [("b-list", "Rust"), ("b-list", "Dust"), ("b-list", "Must"), ("bad", "x")]
    assert out[0]["album"] == "Alb" and out[0]["ids"] == {"appleMusic": "9", "shop": "1"}
    assert flows.import_counts(Shop(spark)).first().asDict() == {"lists": 4, "incomplete": 1, "tracks": 3}


def test_lists_written_are_lists_read(spark, tmp_path):
    out = str(tmp_path / "lists")
    os.mkdir(out)
    rows = [("Ärger: 1/2", [("T", "A", None, 5, None, {"x": "1"}, (90.0, None, "f"))]), ("A b", [("one", "A", None, None, None, None, None)]), ("a B!", [("two", "B", "", 0, "", None, None)]), ("None", [])]
    sinks.write_lists(spark.createDataFrame(rows, "name string, tracks " + model.LIST_DOC["tracks"].dataType.simpleString()), out)
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["a-b.json", "none.json", "ärger-1-2.json"]
    got = {r["slug"]: r for r in lists.read_library(spark, out).collect()}
    assert [t["title"] for t in got["a-b"]["tracks"]] == ["one", "two"] and got["none"]["tracks"] == [] and got["ärger-1-2"]["name"] == "Ärger: 1/2"
    assert got["ärger-1-2"]["tracks"][0]["features"]["bpm"] == 90.0 and got["ärger-1-2"]["tracks"][0]["ids"] == {"x": "1"}
    assert "null" not in "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".json"))


def test_import_enrich_curate_and_create_on_files(spark, folder):
    """The flows one after another over one folder of list files."""
    assert flows.import_into(folder, Shop(spark)).first()["lists"] == 4
    lib = {r["slug"]: r for r in lists.read_library(spark, folder).collect()}
    assert set(lib) == {"a-list", "b-list", "c-list", "bad", "empty"} and lib["b-list"]["name"] == "b list"
    assert [t["title"] for t in lib["b-list"]["tracks"]] == ["Rust", "Dust", "Must"] and lib["empty"]["tracks"] == []
    again = {r["slug"]: r["tracks"] for r in lists.read_library(spark, folder).collect()}
    flows.import_into(folder, Shop(spark))
    assert {r["slug"]: r["tracks"] for r in lists.read_library(spark, folder).collect()} == again  # a second run changes nothing
    songs = spark.createDataFrame([(1, "Dust", "B", 0, "D9", 98.0, 0.0, 0)], "id bigint, title string, artist string, duration_sec int, isrc string, bpm double, gain double, cand_pos bigint")
    from ostinata.operators.library import flatten, in_order, with_ids

    members = flatten(lists.read_library(spark, folder), "ord", "name")
    done, _ = flows.enrich_library(with_ids(members.withColumnRenamed("ord", "lo"), ["lo", "pos"], "ord"), songs)
    fields = [f.name for f in model.LIST_TRACK]
    sinks.write_lists(done.groupBy("lo", "name").agg(in_order("pos", F.struct(*fields)).alias("tracks")).withColumnRenamed("lo", "ord"), folder)
    made = flows.curate_into(folder, "a").orderBy("place").collect()
    assert {r["title"] for r in made} >= {"rust!", "Must", "Dust"} and made[0]["name"] == "Around a"
    lib = {r["slug"]: r for r in lists.read_library(spark, folder).collect()}
    t = {t["title"]: t for t in lib["around-a"]["tracks"]}
    assert t["Dust"]["isrc"] == "D9" and t["Dust"]["features"]["source"] == "deezer" and t["rust!"]["ids"] is None and t["Must"]["ids"] is None
    name, tracks = lists.read_track_list(spark, os.path.join(folder, "around-a.json"))
    catalog = spark.createDataFrame([("s1", "Dust", "B", 0, None, 0)], "id string, title string, artist string, duration_ms bigint, isrc string, cand_pos bigint")
    port = tables.TablePort(catalog, spark.createDataFrame([], "name string, id string, ord bigint"), spark.createDataFrame([], model.REFS))
    plan = flows.create(name, tracks, flows.empty_state(spark), port).collect()
    assert [(r["name"], r["action"], r["to_add"]) for r in plan] == [("Around a", "create", ["s1"])]


def test_push_is_committed_by_groups_and_goes_on(spark, tmp_path):
    rows = [(f"n{i}", "skip" if i == 3 else "create" if i % 2 else "resume", None if i % 2 else f"t{i}", [f"x{i}", f"y{i}"], True) for i in range(7)]
    plan = spark.createDataFrame(rows, "name string, action string, target_id string, to_add array<string>, ordered boolean")
    state = spark.createDataFrame([(f"n{i}", f"t{i}", ["old"], True, False) for i in (0, 2, 4, 6)], model.STATE)
    path = str(tmp_path / "push")
    out = {r["name"]: r for r in sinks.commit_push(plan, state, path, 2).collect()}
    assert set(out) == {"n0", "n1", "n2", "n4", "n5", "n6"} and out["n0"]["added_ids"] == ["old", "x0", "y0"] and out["n1"]["target_id"].startswith("p.")
    contents = lambda: sorted((r["name"], r["pos"], r["target_id"]) for r in spark.read.parquet(path + "/contents").collect())
    want = contents()
    assert len(want) == 12 and spark.read.parquet(path + "/targets").count() == 2
    shutil.rmtree(path + "/state/2")  # the push broke off before the last record was saved
    again = {r["name"]: r for r in sinks.commit_push(plan, state, path, 2).collect()}
    assert again == out and contents() == want


def test_paged_source(spark):
    assert list(paged.pages(fetch, "bad")) == [("bad", 0, '{"name": "Four"}', None), ("bad", 1, None, "no access")]
    assert list(paged.pages(fetch, "gone")) == [] == list(paged.pages(fetch, "none"))
    records, errors = paged.read_paged(spark, "paged_fixture:fetch", ["u1", "bad", "gone"], "id string, name string")
    assert sorted((r["start"], r["pos"], r["name"]) for r in records.collect()) == [("bad", 0, "Four"), ("u1", 0, "One"), ("u1", 1, "Two"), ("u1", 2, "Three")]
    assert [tuple(r) for r in errors.collect()] == [("bad", "no access")]
    assert paged.read_paged(spark, "paged_fixture:fetch", [], "id string")[0].count() == 0


def test_wire_projections(spark):
    rec = lambda schema, row: spark.createDataFrame([row], schema)
    r = wire.tracks(rec(wire.SOURCE_TRACK, ("i", "u", "T", 5, "track", ("Al",), [("A",), ("B",)], ("",)))).first()
    assert tuple(r) == ("T", ["A", "B"], "Al", 5, None, "i", "u")
    assert wire.tracks(rec(wire.SOURCE_TRACK, ("i", None, "T", None, None, None, None, None))).first()["artists"] == []
    r = wire.songs(rec(wire.CATALOG_SONG, ("9", ("N", "A", "L", 7, "X1", None)))).first()
    assert r.asDict() == {"id": "9", "title": "N", "artist": "A", "album": "L", "duration_ms": 7, "isrc": "X1"}
    assert tuple(wire.found_songs(rec(wire.SEARCH_SONG, (12345678901, "N", "A", "C", 3))).first()) == ("12345678901", "N", "A", "C", 3, None)
    r = wire.library_tracks(rec("list string, pos int, " + wire.CATALOG_SONG, ("l", 4, "x", ("N", "A", "L", 7, None, ("c1",)))), "shop", "list", "pos").first()
    assert r.asDict() == {"list": "l", "pos": 4, "title": "N", "artist": "A", "album": "L", "duration_ms": 7, "isrc": None, "service": "shop", "service_id": "c1"}
    assert tuple(wire.features(rec(wire.FEATURE_TRACK, (1, "T", 200, "I", 120.0, -7.5, ("A",), ("L",)))).first()) == (1, "T", "A", "L", 200, "I", 120.0, -7.5)
    assert wire.user(spark.createDataFrame([("me",)], "id string")).first()["user_id"] == "me"
    front = lambda ids: wire.storefront(spark.createDataFrame([([(i,) for i in ids],)], "data array<struct<id: string>>")).first()["storefront"]
    assert front(["de", "us"]) == "de"
    with pytest.raises(Exception, match="empty response"):
        front([])
    kinds = spark.createDataFrame([("track", "x"), ("", "x"), (None, "x"), ("episode", "x"), ("track", None)], "k string, t string")
    assert kinds.where(paged.music(F.col("k"), F.col("t"))).count() == 3


def test_sources_by_name_and_places(spark, monkeypatch):
    existing = spark.createDataFrame([("B", "1", 0), ("A", "2", 1), ("B", "3", 2)], "name string, id string, ord bigint")
    rows = [("3", 0, "T", "A", None, 1, None, "shop", "9"), ("1", 0, "old", "A", None, 1, None, "shop", "8"), ("2", 0, "U", "A", None, 1, None, "shop", "7")]
    tracks = spark.createDataFrame(rows, IMPORTED.replace("list", "playlist_id"))
    errors = spark.createDataFrame([("2", "timeout")], "playlist_id string, error string")
    known = services.Sources()
    known.register("shop", lambda owned_only=False: services.by_name("Shop", existing, tracks, errors))
    src = known.open("shop", owned_only=True)
    assert [tuple(r) for r in src.lists().orderBy("ord").collect()] == [("A", 0, "timeout"), ("B", 1, None)]
    assert {(r["list"], r["title"]) for r in src.tracks().collect()} == {("A", "U"), ("B", "T")}
    with pytest.raises(ValueError, match="shop"):
        known.open("other")
    lib = spark.createDataFrame([(0, "L", [("T", ["A", "B"], None, 3, "I", "s", None)])], "ord int, name string, tracks " + model.PLAYLIST["tracks"].dataType.simpleString())
    src = services.by_library("Pulled", "pulled", lib)
    assert src.tracks().first()["artist"] == "A, B" and src.lists().first()["error"] is None
    monkeypatch.setenv("OSTINATA_HOME", "/x/")
    assert services.Places().state == "/x/state" and services.Places("s3a://b/c").matches == "s3a://b/c/matches"
    with pytest.raises(AttributeError):
        services.Places().other


def test_hand_written_list_from_a_stream(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("# x\nOne - A\n\nTwo\r\n"))
    name, t = lists.read_track_list(spark, None, " Mine ")
    assert name == "Mine" and [(r["title"], r["artists"]) for r in t.orderBy("pos").collect()] == [("One", ["A"]), ("Two", [])]


def test_intermediate_tables_are_deleted(spark):
    from ostinata.sources import storage

    scratch = storage.Scratch(spark)
    kept, parted = scratch.keep(spark.range(3)), scratch.keep_bucketed(spark.range(5), "id")
    assert kept.count() == 3 and parted.groupBy("id").count().count() == 5 and scratch.root.startswith(storage.shared_folder(spark))
    plan = parted.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # a grouping by the buckets' column moves nothing
    before = {t.name for t in spark.catalog.listTables()}
    storage.clean()
    with pytest.raises(Exception):
        spark.read.parquet(scratch.root + "/1").count()
    assert any(t.startswith("scratch_") for t in before) and not any(t.name.startswith("scratch_") for t in spark.catalog.listTables())


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_are_dense_with_further_columns(spark, adaptive):
    from ostinata.operators.library import with_ids

    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("k"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 13).alias("w"))
        r = with_ids(rows, ["k"]).agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("v")).first()
        assert tuple(r) == (400_000, 400_000, 1, 400_000, 400_000)
        late = with_ids(rows, ["k"]).select("id", "k").orderBy("id").limit(1000).collect()
        assert [x["k"] for x in late] == sorted(x["k"] for x in late)
        assert with_ids(rows.limit(0), ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_catalog_without_codes(spark):
    port = tables.TablePort(spark.createDataFrame([("1", "X1")], "id string, isrc string"))
    assert port.without_codes().songs().where("isrc IS NOT NULL").count() == 0
    t = spark.createDataFrame([("T", ["A", "B"], None, 1, None, "s1")], "title string, artists array<string>, album string, duration_ms bigint, isrc string, source_id string")
    r = tables.imported_tracks(t, "shop").first()
    assert (r["artist"], r["service"], r["service_id"]) == ("A, B", "shop", "s1")


def test_analysis_tables_and_sql(spark, folder):
    found = lab.open_lab(lists.read_library(spark, folder))
    assert lab.q(spark, lab.OVERVIEW).first().asDict() == {"playlists": 3, "unique_tracks": 3, "memberships": 4}
    keys = {r["id"]: r["key"] for r in found["tracks"].collect()}
    assert keys == {1: "rust|a", 2: "lust|b", 3: "dust|b"}
    assert [(r["artist"], r["tracks"]) for r in lab.q(spark, lab.TOP_ARTISTS).collect()] == [("B", 2), ("a", 1)]
    assert lab.q(spark, lab.CONNECTORS).first()["in_playlists"] == 2
    # artists keep their spelling in pairs
    assert sorted((r["artist_a"], r["artist_b"]) for r in found["artist_cooccurrence"].collect()) == [("A", "B"), ("B", "a")]
    assert [r["artist"] for r in lab.q(spark, lab.NEIGHBOURS, a="B", k=1).collect()] == ["A"]
    assert lab.artist_pmi(found, 1).count() == 2
    assert lab_norm_text("ÀÉ-b ﬁ") == "ae b fi"


def test_merge_stream_and_windows(spark, tmp_path):
    rows = "list string, pos bigint, title string, artist string, album string, duration_ms bigint, isrc string, service string, service_id string"
    src = str(tmp_path / "in")
    for i, title in enumerate(["Rust", "Dust", "Rust - Live"]):
        spark.createDataFrame([("L", i, title, "A", f"alb{i}", None, None, "shop", str(i))], rows).coalesce(1).write.mode("append").parquet(src)
        imports.merge_stream(spark.readStream.schema(rows).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/v3")).orderBy("pos").collect()
    assert [(r["title"], r["album"], r["ids"]["shop"]) for r in got] == [("Rust", "alb2", "2"), ("Dust", "alb1", "1")]
    t0 = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(t0 + datetime.timedelta(minutes=m), k) for m, k in ((0, "a"), (59, "a"), (60, "a"), (1, "b"))], "ts timestamp_ntz, k string")
    assert sorted((r["start"].hour, r["k"], r["n"]) for r in imports.windowed_counts(ev, "ts", "k").collect()) == [(0, "a", 2), (0, "b", 1), (1, "a", 1)]


@pytest.mark.skipif(not os.environ.get("LIST_CORPUS"), reason="LIST_CORPUS names no folder of lists")
def test_a_real_corpus(spark):
    """Golden values of a corpus of 68 lists, computed apart from this code."""
    found = lab.open_lab(lists.read_library(spark, os.environ["LIST_CORPUS"]))
    assert tuple(lab.q(spark, lab.OVERVIEW).first()) == (68, 3369, 3621)
    assert [(r[0], r[1]) for r in lab.q(spark, lab.TOP_ARTISTS).collect()[:4]] == [("Foo Fighters", 121), ("Bad Suns", 72), ("Jamiroquai", 52), ("The Black Keys", 52)]
    assert found["track_cooccurrence"].count() == 127_613 and found["artist_cooccurrence"].count() == 49_313
    pmi = lab.artist_pmi(found).orderBy(F.desc("pmi"))
    assert pmi.count() == 1054 and round(pmi.first()["pmi"], 6) == 3.526361
