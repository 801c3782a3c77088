"""Text functions, row by row."""

import pytest
from pyspark.sql import functions as F

from ostinata.functions import text as tx


def each(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", f("s").alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_normalize_deletes_punctuation(spark):
    got = each(spark, tx.normalize, ["Good, Day!", "  Many \t  Gaps here ", "AB/CD — Storm", "", None, "Águas 3º", "…"])
    assert got == ["good day", "many gaps here", "abcd storm", "", "", "águas 3º", ""]


def test_clean_title_cuts_versions(spark):
    got = each(spark, tx.clean_title, ["Rust - 2011 Remaster", "By The Sea (Live) (Take 2)", "Plain", "(Whole)", " - x", "A (B) C", None, "X (a)\n(b)"])
    assert got == ["Rust", "By The Sea (Live)", "Plain", "(Whole)", "- x", "A (B) C", "", "X"]
    assert each(spark, tx.track_key, ["Rust! - Edit", "Só (ao vivo)"]) == ["rust", "só"]


def test_three_foldings_are_kept_apart(spark):
    s = ["Último A.B/C!", "数据 – ß", "???"]
    assert each(spark, tx.normalize, s) == ["último abc", "数据 ß", ""]
    assert each(spark, tx.slugify, s) == ["último-a-b-c", "数据-ß", "playlist"]
    assert each(spark, tx.lab_norm, s) == ["ultimo a b c", "", ""]
    assert each(spark, tx.slugify, ["  wide  open  ", None]) == ["wide-open", "playlist"]


@pytest.mark.parametrize(
    ("source", "cand", "score"),
    [("Rust", "rust!", 1.0), ("Rust - Remaster", "Rust", 0.95), ("Rust Never", "Rust", 0.8), ("Rust", "Rust Never", 0.8), ("Rust", "Dust", 0.0), ("", "", 1.0), ("", "Rust", 0.8), ("Rust", "", 0.0), (None, None, 1.0)],
)
def test_title_score(spark, source, cand, score):
    df = spark.createDataFrame([(source, cand)], "s string, c string")
    assert df.select(tx.title_score("s", "c")).first()[0] == score


def test_bands_over_the_truth_table(spark):
    rows = [(t, a, d) for t in (1.0, 0.95, 0.8, 0.0) for a in (1.0, 0.0) for d in (True, False)]
    df = spark.createDataFrame(rows, "t double, a double, d boolean")
    got = [(r[0], r[1]) for r in df.select(F.round(tx.match_score(F.col("t"), F.col("a"), F.col("d")), 3), tx.band(tx.match_score(F.col("t"), F.col("a"), F.col("d")))).collect()]
    assert got == [
        (1.0, "high"), (0.85, "high"), (0.65, "low"), (0.5, "none"), (0.975, "high"), (0.825, "low"), (0.625, "low"), (0.475, "none"),
        (0.9, "high"), (0.75, "low"), (0.55, "low"), (0.4, "none"), (0.5, "none"), (0.35, "none"), (0.15, "none"), (0.0, "none"),
    ]


def test_keys(spark):
    rows = [("ab12", "T", ["X"]), ("", "T!", ["The X", "Y"]), (None, None, None)]
    df = spark.createDataFrame(rows, "isrc string, title string, artists array<string>")
    assert [r[0] for r in df.select(tx.match_key("isrc", "title", "artists")).collect()] == ["isrc:AB12", "tt:t|the x y", "tt:|"]
    assert df.limit(1).select(tx.ref_key(F.lit("A-B"), F.lit("C d"))).first()[0] == "ab|c d"


def test_lines_and_lists(spark):
    got = each(spark, tx.split_title, ["One — Two - Three", "One | Two", "One - Two", "One", " - Two", "a | b — c", None])
    assert [tuple(r) for r in got] == [("One", "Two - Three"), ("One", "Two"), ("One", "Two"), ("One", ""), (" - Two", ""), ("a | b", "c"), ("", "")]
    assert each(spark, tx.comma_list, ["a, b ,,c", "", None]) == [["a", "b", "c"], [], []]
    assert each(spark, lambda c: tx.truncate(c, 5), ["abcde", "abcdef", "ééééééé", None]) == ["abcde", "abcd…", "éééé…", ""]
    assert each(spark, lambda c: tx.contains_norm(c, F.lit("The X")), ["and the x!", "x", None]) == [1.0, 0.0, 0.0]


def test_sql_names_give_the_same(spark):
    tx.register(spark)
    df = spark.createDataFrame([(s,) for s in ["Rust - 2 (x)", "A (B) (c)", "É.é ", "", None, " (a)"]], "s string")
    for name, f in (("norm_text", tx.normalize), ("clean_title", tx.clean_title), ("track_key", tx.track_key), ("slug", tx.slugify), ("lab_norm", lambda c: tx._lab_norm(F.col(c)))):
        assert df.where(F.expr(f"{name}(s)") != f("s")).count() == 0


def test_transport_functions(spark):
    from ostinata.functions import transport as tp

    v = spark.createDataFrame([("dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk",)], "v string")
    assert v.select(tp.challenge("v")).first()[0] == "E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM"
    links = spark.createDataFrame([(None,), ("",), ("http://x",), ("/v1/a",), ("/b",), ("c",)], "l string")
    assert [r[0] for r in links.select(tp.absolute("l", "https://a/v1", "https://h")).collect()] == ["", "", "http://x", "https://h/v1/a", "https://a/v1/b", "https://a/v1/c"]
    waits = spark.createDataFrame([("3", 0), ("-1", 0), (None, 2), ("x", 9)], "r string, n int")
    assert [r[0] for r in waits.select(tp.wait_seconds("r", "n")).collect()] == [3.5, 1.0, 4.0, 30.0]
    t = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS e, s FROM VALUES (timestamp'2023-12-31 23:59:59'), (timestamp'2024-01-01 00:00:01') AS x(s)")
    assert [r[0] for r in t.select(tp.expired(t["e"], t["s"])).collect()] == [False, True]
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, None, True, True, True, False])] + [(2, 0, True)], "k int, i int, f boolean")
    assert sorted((r["k"], r["i"], r["broken"]) for r in tp.until_broken(rows, "k", "i", "f", 2).collect()) == [(1, 0, False), (1, 1, False), (1, 2, False), (1, 3, False), (1, 4, False), (1, 5, True), (2, 0, False)]
