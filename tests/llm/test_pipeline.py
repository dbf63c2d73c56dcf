"""The stages of the pipeline on the smallest tables, each against its own input."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r["doc_id"]: r for r in docs.collect()}
        counts.append(docs.count())
        assert set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == cp.COLUMNS
        if name == "line_dedup":
            assert len(after) == len(before) and all(len(after[k]["text"] or "") <= len(before[k]["text"] or "") for k in after)
        elif name != "mixing":
            assert all(after[k] == before[k] for k in after)
    assert counts[0] > counts[1] and counts[2] > counts[3] and counts[5] > 0
    assert docs.filter("copies < 1 OR taken > 3 * size").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_line_dedup_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from marlstone.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(con.sql(sql).select(*columns).fetchall())


def test_line_dedup_cleans_pages_that_are_mostly_boilerplate(spark):
    import corpus_pipeline as cp

    banner = "one long banner that stands on every one of the sites, over and over"
    rows = [(i, f"{banner}\nbody {i}", "en", f"s{i}", 0) for i in range(12)] + [(20, f"{banner}\n \n{banner}", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in dict(cp.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert all(got[i] == f"body {i}" for i in range(12))
    assert got[20] == rows[-1][1]  # nothing but such lines: left to near-dedup
