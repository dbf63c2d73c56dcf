"""Joins that meet as pairs: cut by their counted pairs, classes instead of rows, ties by place in the file."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import integrity, joins
from marlstone.plans import catalog


def test_spread_join_cuts_groups_and_loses_no_pair(spark):
    rng = random.Random(3)
    left = [(rng.choice("aaaaab"), i) for i in range(60)] + [(None, 99)]
    right = [(rng.choice("aaaabc"), i) for i in range(40)] + [(None, 98)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    got = joins.spread_join(a, b, ["k"], pairs=100)
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted((k, x, y) for k, x in left for m, y in right if k is not None and k == m)
    assert joins.spread_join(a, b, ["k"], pairs=10**6).count() == got.count()


def test_pairs_of_one_file_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins.spread_join, "__defaults__", (2_000,))
    df = spark.range(400).coalesce(1).select("id", F.lit("x").alias("brand"), (F.col("id") % 4).alias("size"))
    pairs = integrity.near_names(df, "id", ["brand"], "size", 1)
    assert pairs.count() == sum(1 for i in range(400) for j in range(i) if abs(i % 4 - j % 4) <= 1)
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def brute(parts):
    out = {}
    t = {k: set(n.split()) for k, n, _, _ in parts}
    for k, _, brand, size in parts:
        best = None
        for c, _, other, cs in parts:
            if k % 20 or c == k or other != brand:
                continue
            gap = abs(size - cs)
            score = 6 + 4 * len(t[k] & t[c]) / max(len(t[k]), len(t[c])) + (3 if gap <= 2 else 2 if gap <= 5 else 0)
            best = min(best or (0, 0), (-round(score, 6), c))
        if best and -best[0] >= 8:
            out[k] = (best[1], -best[0])
    return out


def test_match_score_of_copies_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    parts = [(k, f"{rng.choice(['red', 'blue'])} {rng.choice(['bolt', 'nut', 'ring'])}", rng.choice(["A", "B"]), rng.choice([1, 2, 9, 30])) for k in range(400)] + [(400, "red bolt", "C", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    frame = catalog.queries()["match_score"](spark, str(tmp_path))
    assert {r["p_partkey"]: (r["best"], r["score"]) for r in frame.collect()} == {k: (c, pytest.approx(s, abs=1e-4)) for k, (c, s) in brute(parts).items()}


def test_election_takes_the_first_row_of_equal_keys(spark, tmp_path):
    rows = [(1, 5, 1, "R"), (1, 5, 1, "A"), (2, 6, 1, "A"), (2, 6, 1, "N"), (2, 6, 1, "R")]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["election_drift"](spark, str(tmp_path))
    assert sorted((r["l_partkey"], r["stored"]) for r in got.collect()) == [(1, "R"), (2, "A")]


def test_mirex_gives_unknown_keys_nothing_and_keeps_their_pairs(spark):
    pairs = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 0), (12, 1, 0, 1), (1, 0, 12, 0)], "a int, m int, b int, n int")
    from marlstone.operators import scoring

    assert [r[0] for r in pairs.select(scoring.mirex(F.col("a"), F.col("m"), F.col("b"), F.col("n"))).collect()] == [0.0, 0.0, 0.0, 0.5]
    sf = "/root/testdata/sf0.001"
    assert catalog.queries()["mirex"](spark, sf).count() == catalog.queries()["key_compat"](spark, sf).count()


def test_election_with_nulls_matches_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    pick = lambda *xs: rng.choice([*xs, None])
    rows = [(rng.choice([*range(60), None]), pick(*range(50)), pick(1, 2), pick("R", "A", "N")) for _ in range(400)]
    rows = list({r[:3]: r for r in rows}.values()) + [(100, 1, 1, None), (101, 1, None, "A"), (101, 1, 2, None)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["election_drift"]).select("l_partkey", "stored", "winner", "drift").fetchall()
    got = catalog.queries()["election_drift"](spark, str(tmp_path)).select("l_partkey", "stored", "winner", "drift").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_match_score_asks_for_every_part(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(9)
    names = ["red bolt", "blue bolt", "red nut", "old ring", "!", None]
    parts = [(rng.choice([*range(1, 90), None]), rng.choice(names), rng.choice(["A", "B", None]), rng.choice([1, 4, 9, 30, None])) for _ in range(150)] + [(99, "red bolt", "C", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["match_score"]).select("p_partkey", "best", "score").fetchall()
    got = catalog.queries()["match_score"](spark, str(tmp_path)).select("p_partkey", "best", "score").collect()
    assert sum(k % 20 > 0 for k, *_ in want) > 40
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_names_of_equal_rows_are_compared_once_a_block(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(joins.block_pairs, "__defaults__", (8, 30))
    rng = random.Random(6)
    parts = [(rng.choice([*range(250), None]), rng.choice(["red bolt", "blue bolt", "", None]), rng.choice(["A", "A", "A", "B", None]), rng.choice([1, 1, 1, 4, None])) for _ in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["name_similarity"]).select("a", "b", "ratio", "bounded").fetchall()
    got = catalog.queries()["name_similarity"](spark, str(tmp_path)).select("a", "b", "ratio", "bounded").collect()
    assert len(want) > 5_000
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    part = spark.read.parquet(f"{tmp_path}/part.parquet").filter("p_partkey IS NOT NULL")
    blocks = joins.block_pairs(part, ["p_brand", "p_size"], ["p_name"], "p_partkey")
    assert blocks.count() < len(want) / 10
    assert blocks.select(F.spark_partition_id()).distinct().count() > 4


def test_twins_of_one_stem_meet_once_in_cells(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(joins.cell_join, "__defaults__", (20,))
    rng = random.Random(7)
    stem = "x" * 24
    texts = [stem, stem + "a", stem + "b", "other", None]
    docs = [(rng.choice([*range(300), None]), rng.choice(texts[:3] * 4 + texts), rng.choice(["en", "en", "de", None]), rng.choice([1, 2, None])) for _ in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["twin_verdict"]).select("original", "twin", "verdict").fetchall()
    frame = catalog.queries()["twin_verdict"](spark, str(tmp_path)).select("original", "twin", "verdict")
    assert len(want) > 10_000
    assert sorted(repr(tuple(r)) for r in frame.collect()) == sorted(map(repr, want))
    assert frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < len(want) / 4
