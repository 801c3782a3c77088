"""Every query with SQL against DuckDB on the same tables; the others run whole."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from ostinata.plans import queries_baskets, queries_text
from test_graph import greedy

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = queries_text.QUERIES | queries_baskets.QUERIES
SQL = queries_text.SQL | queries_baskets.SQL


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = OWN[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert OWN[name](spark, sf).count() > 0


def test_contract(spark):
    q, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(q) and set(OWN) <= set(q)
    assert entry_module.entry(spark).count() > 0


def test_separate_query_by_brute_force(spark, sf):
    rows = queries_baskets.members(spark, sf).select("basket", "pos", "item", "artist").toPandas().sort_values(["basket", "pos"])
    want = []
    for basket, g in rows.groupby("basket"):
        for place, i in enumerate(greedy(g.artist.tolist()), 1):
            want.append((basket, place, g.item.iloc[i], g.artist.iloc[i]))
    assert sorted(map(tuple, OWN["separate"](spark, sf).collect())) == sorted(want)


def test_curate_query_by_brute_force(spark, sf):
    m = queries_baskets.members(spark, sf).select("basket", "pos", "title", "artist").toPandas().sort_values(["basket", "pos"])
    fold = lambda s: "".join(c for c in s.lower() if c.isalnum() or c.isspace()).strip()
    seed, weight = fold(queries_baskets.SEED), Counter()
    for _, g in m.groupby("basket"):
        artists = {fold(a) for a in g.artist}
        if len(g) <= queries_baskets.CAP and seed in artists:
            weight.update(artists - {seed})
    ranked = [seed] + [a for a, _ in sorted(weight.items(), key=lambda p: (-p[1], p[0]))[:12]]
    pool = {}
    for t, a in zip(m.title, m.artist):
        pool.setdefault(fold(a), {}).setdefault(fold(t), (t, a))
    pool = {a: sorted(p.values()) for a, p in pool.items()}
    picked = [pool[a][k] for k in range(max(map(len, pool.values()))) for a in ranked if k < len(pool.get(a, []))][:30]
    want = [picked[i] for i in greedy([fold(a) for _, a in picked], "")]
    assert [(r["title"], r["artist"]) for r in OWN["curate"](spark, sf).orderBy("place").collect()] == want


def test_merge_fold_query_by_brute_force(spark, sf):
    """Titles repeat within a brand, so imports meet the last part of a title, and those before them."""
    old, new = (d.toPandas().sort_values("p_partkey") for d in queries_baskets._imports(spark, sf))
    want = []
    for brand in sorted({*old.artist, *new.artist}):
        rows, code, title = [], {}, {}
        for r in old[old.artist == brand].itertuples():
            if r.isrc:
                code[r.isrc.upper()] = len(rows)
            title[r.title.lower()] = len(rows)
            rows.append([r.title, brand, None, 5, r.isrc, None])
        for r in new[new.artist == brand].itertuples():
            i = code.get(r.isrc.upper()) if r.isrc else None
            i = title.get(r.title.lower()) if i is None else i
            if i is None:
                i = len(rows)
                rows.append([r.title, brand, None, None, None, None])
            row = rows[i]
            row[2:] = [r.album or row[2], r.duration_ms if r.duration_ms > 0 else row[3], r.isrc or row[4], str(r.p_partkey)]
            if r.isrc:
                code[r.isrc.upper()] = i
            title[row[0].lower()] = i
        want += [(brand, i, *row) for i, row in enumerate(rows)]
    assert sorted(map(tuple, OWN["merge_fold"](spark, sf).collect()), key=repr) == sorted(want, key=repr)
