"""Operators on small literal inputs, against expected values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar, text
from marlstone.operators import energy, evalstats, filters, graph, integrity, labels, relational, sequence, vectors
from marlstone.sources import readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_round_up_is_half_up(spark):
    assert one(spark, *[scalar.round_up(F.lit(x), 0) for x in (-2.5, 2.5, -0.5)])[:] == (-2.0, 3.0, 0.0)


def test_uniform_is_the_sequential_generator(spark):
    def sequential(seed, n):
        out = []
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
            t = seed
            t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
            t = (t ^ (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF))) & 0xFFFFFFFF
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    got = [r[0] for r in spark.range(200).orderBy("id").select(scalar.uniform(F.col("id"), 42)).collect()]
    assert got == sequential(42, 200)
    assert got[0] == pytest.approx(0.60110375, abs=1e-8)


def test_normal_cdf(spark):
    got = one(spark, *[scalar.normal_cdf(F.lit(x)) for x in (0.0, 1.96, -1.96)])
    assert got == pytest.approx((0.5, 0.975, 0.025), abs=1e-4)


def test_name_ratio_exceeds_one(spark):
    a, b = F.lit("night"), F.lit("nights")
    assert one(spark, scalar.name_ratio(a, b), scalar.name_similarity(a, b)) == pytest.approx((2 * 10 / 11, 5 / 6))


def test_text(spark):
    got = one(spark, text.nfc(F.lit("é")), text.strip_copy_suffix(F.lit("song - 2 3")), text.decode_entities(F.lit("&lt;a&amp;b&gt;")), text.search_query(F.lit("Go! (Live) Now feat. X")), text.version(F.lit("Go (Ann Remix)")))
    assert got[:4] == ("é", "song", "<a&b>", "go now")
    assert tuple(got[4]) == ("remix", "go")


def test_two_key_diff(spark):
    a = spark.createDataFrame([("a", "m1", 1), ("b", "m2", 2), ("c", "m3", 3)], "p string, m string, s int")
    b = spark.createDataFrame([("a", "m1", 1), ("x", "m2", 5), ("d", "m4", 4)], "p string, m string, s int")
    got = {(r["a_p"], r["b_p"]): (r["change"], r["matched_by"]) for r in relational.two_key_diff(a, b, "p", "m", "s").collect()}
    assert got == {("a", "a"): ("same", "first"), ("b", "x"): ("changed", "second"), ("c", None): ("removed", None), (None, "d"): ("added", None)}


def test_band_join_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-20, 20, 60), rng.uniform(-20, 20, 60)
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, a double")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "j int, b double")
    got = {(r["i"], r["j"]) for r in relational.band_join(left, right, "a", "b", 1.5).collect()}
    assert got == {(i, j) for i, v in enumerate(x) for j, w in enumerate(y) if abs(v - w) <= 1.5}


def test_nearest_match_prefers_the_earlier(spark):
    left = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 14.0), ("z", 3, 1.0)], "k string, id int, t double")
    right = spark.createDataFrame([("k", 7, 8.0), ("k", 8, 12.0), ("k", 9, 13.0)], "k string, c int, u double")
    got = {r["id"]: r["nearest_id"] for r in relational.nearest_match(left, right, "k", "t", "u", "c").collect()}
    assert got == {1: 7, 2: 9, 3: None}


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    c = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "k int, v string, w string")
    assert rows(relational.upsert(t, c, ["k"]).select("k", F.coalesce("v", F.lit("-")))) == [(1, "a"), (2, "-"), (3, "c")]
    assert rows(relational.fill_upsert(t, c, "k", ["v"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(relational.insert_or_ignore(t, c, ["k"]).select("k", F.coalesce("v", F.lit("-")))) == [(1, "a"), (2, "b"), (3, "c")]


def test_search_needs_two_characters(spark):
    df = spark.createDataFrame([(1, "50% off"), (2, "5000")], "id int, t string")
    assert rows(filters.search(df, ["t"], "0%", "id").select("id")) == [(1,)]
    assert rows(filters.search(df, ["t"], "0%", "id", literal=False).select("id")) == [(1,), (2,)]
    assert filters.search(df, ["t"], "0", "id").count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(rows(graph.connected_components(edges, one_task=0)))
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[101] == 100


def test_islands_and_phrases(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate("aabbbca")], "k string, i int, c string")
    assert [tuple(r)[2:] for r in sequence.islands(df, "k", ["i"], "c").orderBy("island").collect()] == [("a", 0, 2), ("b", 2, 3), ("c", 5, 1), ("a", 6, 1)]
    drops = spark.createDataFrame([("k", i, d) for i, d in enumerate([0.0, 0.9, 0.0, 0.0, 0.9, 0.9, 0.0, 0.0, 0.9])], "k string, i int, d double")
    assert sequence.novelty_phrases(drops, "k", ["i"], F.col("d"), 0.5, 4).first()["starts"] == [0, 4, 8]
    peaks = spark.createDataFrame([("k", i, s) for i, s in enumerate([1.0, 9.0, 8.0, 2.0, 7.0])], "k string, i int, s double")
    assert sequence.spaced_peaks(peaks, "k", ["i"], "s", 2, 3).first()["peaks"] == [1, 4]


def test_tempo_fit_of_a_perfect_grid(spark):
    df = spark.createDataFrame([("k", 0.5 + i * 0.25) for i in range(8)], "k string, t double")
    r = sequence.tempo_fit(df, "k", ["t"], "t").first()
    assert (r["n"], r["step"], r["start"], r["residual"]) == pytest.approx((8, 0.25, 0.5, 0.0), abs=1e-9)


def _vectors(spark, n=60, d=8):
    m = np.random.default_rng(3).normal(size=(n, d))
    return m, spark.createDataFrame([(i, m[i].tolist(), i % 3) for i in range(n)], "vec_id long, embedding array<double>, label int")


def test_knn_matches_brute_force_over_blocks(spark):
    m, df = _vectors(spark)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.floor(u @ u.T * 1e6 + 0.5) / 1e6
    np.fill_diagonal(sims, -9)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in vectors.knn_edges(df, df, 4, same=True, block_rows=16).collect()}
    for q in range(60):
        assert [got[q, r] for r in range(1, 5)] == np.lexsort((np.arange(60), -sims[q]))[:4].tolist()


def test_principal_directions_match_eigenvectors(spark):
    m, df = _vectors(spark, 200, 5)
    m = m * np.array([5, 3, 1, 1, 1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    mean, directions = vectors.principal_directions(df, "embedding", 2)
    values, vecs = np.linalg.eigh(np.cov(m.T))
    assert mean == pytest.approx(m.mean(axis=0))
    for got, want in zip(directions, vecs[:, ::-1].T):
        assert abs(got @ want) > 0.999


def test_mcnemar_textbook(spark):
    a = spark.createDataFrame([(i, i < 10 or i > 20) for i in range(40)], "k int, ok boolean")
    b = spark.createDataFrame([(i, 10 <= i < 13 or i > 20) for i in range(40)], "k int, ok boolean")
    r = evalstats.mcnemar(a, b, "k", "ok").first()
    assert (r["b"], r["c"]) == (10, 3) and r["chi2"] == pytest.approx(36 / 13) and r["p"] == pytest.approx(math.erfc(math.sqrt(36 / 26)), abs=1e-5)


def test_bootstrap_matches_a_loop(spark):
    values = [1.0, 0.0, 1.0, 1.0, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    draws = [r[0] for r in spark.range(250).orderBy("id").select(scalar.uniform(F.col("id"), 42)).collect()]
    means = sorted(np.mean([values[int(draws[b * 5 + j] * 5)] for j in range(5)]) for b in range(50))
    r = evalstats.bootstrap_ci(df, "i", F.col("v"), draws=50).first()
    assert (r["low"], r["high"]) == pytest.approx((means[1], means[48]))


def test_election_rules(spark):
    votes = spark.createDataFrame([("x", "wide", 9.0), ("x", "techno", 2.0), ("y", "wide", 1.0), ("z", "b", 2.0), ("z", "a", 1.0), ("z", "a", 1.0)], "i string, l string, w double")
    assert rows(labels.elect(votes, "i", "l", "w", ["wide"])) == [("x", "techno", 2.0, "wide"), ("y", "wide", 1.0, None), ("z", "b", 2.0, "a")]


def test_dawid_skene_trusts_the_better_annotators(spark):
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 60)
    data = [(i, j, str(t if rng.random() < right else 1 - t)) for i, t in enumerate(truth.tolist()) for j, right in enumerate((0.95, 0.9, 0.6))]
    post, steps = labels.dawid_skene(spark.createDataFrame(data, "i int, j int, l string"), "i", "j", "l", iterations=6)
    best = {r["i"]: r["l"] for r in post.filter("posterior > 0.5").collect()}
    assert sum(best[i] == str(t) for i, t in enumerate(truth.tolist())) >= 54


def test_dawid_skene_passes_shuffle_no_answers(spark, monkeypatch):
    # The joins of every round give the same posteriors; where tasks hold the parameters, answers are written once and no round joins.
    rng = np.random.default_rng(9)
    data = [(f"i{i}", int(rng.integers(4)), str(rng.integers(3))) for i in range(80) for _ in range(1 + i % 5)] + [(None, 1, "0"), ("i1", None, "1"), ("i2", 2, None), ("none", 1, None)]
    df = spark.createDataFrame(data, "i string, j int, l string")
    written = []
    monkeypatch.setattr(labels, "materialise", lambda d, m=labels.materialise: written.append(d) or m(d))
    post, steps = labels.dawid_skene(df, "i", "j", "l", iterations=5)
    assert len(written) == 1
    got = {(r["i"], r["l"]): r["posterior"] for r in post.collect()}
    monkeypatch.setattr(labels, "PARAMETERS", 20)
    joined, again = labels.dawid_skene(df, "i", "j", "l", iterations=5)
    want = {(r["i"], r["l"]): r["posterior"] for r in joined.collect()}
    assert len(written) > 5 and steps == again
    assert got.keys() == want.keys() == {(f"i{i}", t) for i in range(80) for t in "012"}
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_bradley_terry_orders_by_wins(spark):
    pairs = spark.createDataFrame([("a", "b")] * 3 + [("b", "c")] * 3 + [("a", "c")] * 2 + [("b", "a"), ("c", "b")], "w string, l string")
    got = {r["id"]: r["score"] for r in labels.bradley_terry(pairs, "w", "l", iterations=15).collect()}
    assert got["a"] == 1.0 and got["a"] > got["b"] > got["c"]


def test_percentiles_and_bands(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 4])], "i int, v double")
    assert rows(energy.percentile_rank(df, "v", "p").select("i", "p")) == [(0, 0.5), (1, 0.5), (2, 0.75), (3, 1.0)]


def test_sweep_states(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 3, "z"), ("n", 1, "n")], "k string, s int, d string")
    old = spark.createDataFrame([("a", 1, "x", False), ("b", 2, "x", False), ("c", 3, "y", False), ("m", 1, "m", False)], "k string, s int, d string, flagged boolean")
    assert dict(rows(integrity.sweep(now, old, "k", "s", "d"))) == {"a": "unchanged", "b": "truncated", "c": "changed", "n": "new", "m": "missing"}


def test_sets_are_built_from_all_of_part(spark, tmp_path):
    from marlstone.plans import catalog

    rows_ = [(i, i % 50, f"Brand#{i % 25}") for i in range(1, 3001)]
    spark.createDataFrame(rows_, "p_partkey long, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    sessions = {(i // 1200) * 8 + size % 8 for i, size, _ in rows_}
    got = {n: catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("set_greedy", "set_beam", "set_quality")}
    assert all({r["grp"] for r in rows_} == sessions for rows_ in got.values())
    assert max(r["id"] for r in got["set_greedy"]) >= 2400 and max(r["id"] for r in got["set_beam"]) >= 2400
    assert all(r["grp"] == r["id"] // 1200 * 8 + r["id"] % 50 % 8 for r in got["set_greedy"])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/sub/a.mp3").write_bytes(b"12345")
    (tmp_path / "tree/.hidden").write_bytes(b"1")
    got = readers.tree(spark, str(tmp_path / "tree"), ["mp3"]).collect()
    assert [(r["relative"], r["bytes"]) for r in got] == [("sub/a.mp3", 5)]
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "x.json"), "a int")
    assert good.collect()[0]["a"] == 1 and bad.count() == 1
    (tmp_path / "d.xml").write_text("<releases><release id='1'><title>T</title><artists><artist><name>N</name></artist></artists><genres><genre>House</genre></genres><styles><style>Deep</style></styles></release></releases>")
    tables = readers.releases_xml(spark, str(tmp_path / "d.xml"), genre="House")
    assert tables["artists"].collect()[0][:] == (1, "N") and tables["releases"].count() == 1
    assert one(spark, readers.vector(F.lit("[1, 2.5]")), readers.vector(F.lit("[]")), readers.vector(F.lit("[1, null]")))[:] == ([1.0, 2.5], None, None)
    lists = writers.playlist_lines(spark.createDataFrame([("p", 2, "B", "/b", 61.5), ("p", 1, "A\n", "/a", 30.0), ("p", 3, "C", None, 1.0)], "g string, s int, t string, f string, d double"), "g", "s", "t", "f", "d").first()
    assert lists["body"] == "#EXTM3U\n#EXTINF:30,A \n/a\n#EXTINF:61,B\n/b" and lists["skipped"] == 1
    writers.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "t"), "k")
    writers.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), str(tmp_path / "t"), "k")
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("k", "v")) == [(1, "a"), (2, "c")]


def test_heavy_keys_are_joined_by_broadcast(spark):
    from marlstone.operators.joins import join_by_size

    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 2)], "k long, v long")
    right = spark.createDataFrame([(1, "a", 50), (2, "b", 1)], "k long, w string, n long")
    for how, rows in (("inner", 51), ("left", 52)):
        for least in (5, 1000):
            got = join_by_size(left, right, ["k"], how=how, least=least)
            assert got.columns == ["k", "v", "w"] and got.count() == rows and got.filter("k = 1 and w = 'a'").count() == 50
