"""The candidate pool, the intake cascade, neighbours of items and folds, and numbering, on small cases by hand."""

import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar
from marlstone.operators import evalstats, intake, labels, pool, ranks, scoring, vectors

TRACKS = "id long, title string, artist string, genre string, duration_s double, path string, status string, updated_at timestamp"
MIRROR = "id long, content_id long, updated_at long, metadata string"


@pytest.fixture(scope="module")
def sources(spark):
    day = lambda d: datetime(2024, 1, d)
    tracks = [
        (1, "Blue Lake (Original Mix)", "A, B", "House", 200.0, "/v/1.mp3", "downloaded", day(5)),
        (2, "blue lake", "a", None, 200.0, "/v/2.mp3", "downloaded", day(9)),  # the later one of the same title stays
        (3, "Other", "x", None, 200.0, "/V/2.MP3", "downloaded", day(3)),  # the same place as 2
        (4, "Moved", "x", None, 200.0, "/home/u/Music/DJ-Imports/s/4.mp3", "downloaded", day(1)),
        (5, "Gone but measured", "x", None, None, "/nowhere", "downloaded", day(8)),
        (6, "Gone and unknown", "x", None, None, "/nowhere", "downloaded", day(8)),
        (7, "Mirror only", "x", None, None, None, "downloaded", day(8)),
        (8, "Pending", "x", None, None, "/v/8.mp3", "pending", day(8)),
        (9, "  ", "x", None, None, "/v/9.mp3", "downloaded", day(8)),
        (10, None, None, None, None, "/v/10.mp3", "downloaded", None),
        (11, "Real Name - Song [Free DL", "Trap Nation", None, None, "/v/11.mp3", "downloaded", day(2)),
        (12, "Song (Extended Mix).mp3", "Real Name", None, None, "/v/12.mp3", "downloaded", day(1)),
        (13, "Real Name - Song", "Somebody", None, None, "/v/13.mp3", "downloaded", day(1)),
        (14, "Gone but measured", "X", None, None, "/v/14.mp3", "downloaded", day(1)),  # a file goes before none, whatever the day
    ]
    mirror = [(7, 1, 1, '{"BPM": 12850, "KeyName": " 4A "}'), (7, 2, 0, '{"BPM": 9000}'), (2, 3, 1, "broken"), (9, 4, 1, '{"BPM": -5, "KeyName": ""}'), (12, 5, 1, '{"BPM": "x", "KeyName": "Am"}')]
    keys = [(2, "/v/2.mp3", "8B"), (9, "/v/other.mp3", "1A"), (10, "/v/10.mp3", "")]
    there = [f"/v/{i}.mp3" for i in (1, 2, 8, 9, 10, 11, 12, 13, 14)] + ["/V/2.MP3", "/shelf/s/4.mp3", "/v/1.mp3", None]
    return {
        "tracks": spark.createDataFrame(tracks, TRACKS), "beats": spark.createDataFrame([(1, 120.0), (5, 99.0), (6, float("inf")), (2, None)], "id long, bpm double"), "mood": spark.createDataFrame([(1, 5.0, 6.0, 0.5)], "id long, valence double, arousal double, dance double"),
        "mirror": spark.createDataFrame(mirror, MIRROR), "keys": spark.createDataFrame(keys, "id long, path string, key string"), "files": spark.createDataFrame([(p,) for p in there], "path string"),
    }


def test_pool_outcomes(sources):
    got = {r.id: r for r in pool.judge(**sources, root="/shelf/").collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "same title", 2: "kept", 3: "same path", 4: "kept", 5: "same title", 6: "no file", 7: "kept", 9: "kept", 10: "kept", 11: "kept", 12: "same title", 13: "kept", 14: "kept"}
    assert got[4].file == "/shelf/s/4.mp3" and got[4].relocated and not got[2].relocated
    assert (got[7].bpm, got[7].bpm_from, got[7].key, got[7].key_from, got[7].metadata_only) == (128.5, "mirror", "4A", "mirror", True)
    assert (got[2].bpm, got[2].bpm_from, got[2].key, got[2].key_from) == (None, "none", "8B", "ledger")
    assert (got[9].bpm, got[9].key, got[9].key_from) == (None, None, "unread")
    assert (got[10].key, got[10].key_from) == (None, "ledger") and (got[12].key, got[12].bpm) == ("Am", None)
    assert (got[1].bpm, got[1].bpm_from, got[1].arousal) == (120.0, "beats", 6.0)


def test_pool_census_adds_up(sources, spark):
    judged = pool.judge(**sources, root="/shelf")
    c = pool.census(judged).first()
    assert c.source_total == c.total + c.duplicates + c.unusable == 13
    assert (c.total, c.duplicates, c.unusable, c.missing_files, c.metadata_only, c.relocated_files) == (8, 4, 1, 3, 2, 1)
    assert pool.candidates(judged).count() == c.total
    empty = {k: v.limit(0) for k, v in sources.items()}
    assert pool.judge(**empty).count() == 0 and pool.census(pool.judge(**empty)).first().source_total == 0
    bare = pool.judge(sources["tracks"], **{k: v.limit(0) for k, v in sources.items() if k != "tracks"})
    assert {r.outcome for r in bare.collect()} == {"no file"}


def test_title_keys(spark):
    cases = [
        ("HUGEL, Cumbiafrica", "Morenita (Extended)", "hugel|morenita"), ("Hugel", "Morenita (Extended Mix).MP3", "hugel|morenita"), ("a", "Song (John Summit Remix)", "a|song john summit remix"), ("a", "Song [Pryda Prese", "a|song"),
        ("Trap City", "Some One - Track", "some one|track"), ("unknown", "Some One - Track [x] (radio edit)", "some one|track"), ("unknown", "Track", "unknown|track"), ("Some One", "Else - Track", "some one|else track"), (None, "Ünï", "|n"), ("a", None, "a|"),
    ]
    df = spark.createDataFrame(cases, "artist string, title string, want string").withColumn("got", pool.title_key(F.col("artist"), F.col("title")))
    assert [(r.got, r.want) for r in df.collect() if r.got != r.want] == []


def test_keys_of_all_notations(spark):
    cases = {"8A": (8, 0), " 12 b ": (12, 1), "Am": (8, 0), "C": (8, 1), "F#m": (11, 0), "Db": (3, 1), "7m": (2, 0), "6d": (1, 1), "1d": (8, 1), "12m": (7, 0), "Gmaj": (9, 1), "eb minor": (2, 0), "C m": (5, 0), "Bb": (6, 1), "Gbm": (11, 0), "B": (1, 1), "A": (11, 1)}
    got = spark.createDataFrame([(k,) for k in cases], "k string").select("k", scoring.camelot(F.col("k")).alias("c"))
    assert {r.k: tuple(r.c) for r in got.collect()} == cases
    odd = spark.createDataFrame([(k,) for k in ("13A", "0A", "H", "", "a", "8C", "Am7", None)], "k string")
    assert odd.filter(scoring.camelot(F.col("k")).isNotNull()).count() == 0


def test_intake_stages(spark):
    rows = [
        (1, "/in/a.wav", "a|x", 10, "m1", 5.0, "f1"), (2, "/in/a longer.wav", "a|x", 11, "m2", 5.0, "f2"), (3, "/in/b.mp3", "a|x", 12, "m3", 9.0, None),  # 3 is the best of one identity
        (4, "/in/c.mp3", "c", 20, "m4", 1.0, None), (5, "/in/d.mp3", "d", 20, "m4", 2.0, None), (6, "/in/e.mp3", "e", 20, "m6", 1.0, None), (7, "/in/f.mp3", "f", 21, "m4", 1.0, None),  # 4 equals 5; size or digest alone is none
        (8, "/in/Play Hard.mp3", "g", 30, "m8", 99.0, None), (9, "/x/play-hard.flac", "h", 31, "m9", 1.0, None),
        (10, "/in/one song live.mp3", "i", 40, "ma", 3.0, "fp"), (11, "/in/one song.mp3", "j", 41, "mb", 2.0, "fp"), (12, "/in/quite different.mp3", "k", 42, "mc", 1.0, "fp"),
        (13, "/arc/self.mp3", "arc1", 50, "md", 1.0, None), (14, "/in/up.mp3", "arc2", 51, "me", 10.6, None), (15, "/in/no.mp3", "arc3", 52, "mf", 10.5, None), (16, "/in/null.mp3", None, 53, None, None, None), (17, "/in/null2.mp3", None, 53, None, None, None), (18, "/in/z.mp3", "arc4", 54, "mg", None, None),
    ]
    archive = [(900, "arc1", "/arc/self.mp3", 1.0), (901, "arc2", "/arc/2", 10.0), (902, "arc3", "/arc/3", 10.0), (903, "arc3", "/arc/3b", 1.0), (904, "arc4", None, 1.0), (905, "arc4", "/arc/4", None)]
    got = intake.cascade(spark.createDataFrame(rows, "id long, file string, identity string, size long, md5 string, score double, fp string"), spark.createDataFrame(archive, "id long, identity string, file string, score double"))
    want = {
        1: ("identity", 3, None), 2: ("identity", 3, None), 3: ("new", None, None), 4: ("content", 5, None), 5: ("new", None, None), 6: ("new", None, None), 7: ("new", None, None), 8: ("lossless twin", 9, None), 9: ("new", None, None),
        10: ("new", None, None), 11: ("recording", 10, None), 12: ("new", None, 10), 13: ("self", 900, None), 14: ("upgrade", 901, None), 15: ("archived", 902, None), 16: ("new", None, None), 17: ("new", None, None), 18: ("archived", 905, None),
    }
    assert {r.id: (r.outcome, r.keeper, r.review) for r in got.collect()} == want
    none = spark.createDataFrame([], "id long, file string, identity string, size long, md5 string, score double, fp string")
    assert intake.cascade(none, spark.createDataFrame(archive, "id long, identity string, file string, score double")).count() == 0


def cosine(a, b):
    return math.floor(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) * 1e6 + 0.5) / 1e6


def test_items_of_many_vectors_as_by_hand(spark):
    rnd = np.random.default_rng(4)
    rows = [(v, int(rnd.integers(0, 40)), [0.0] * 4 if v % 17 == 0 else rnd.normal(size=4).tolist()) for v in range(150)]
    kinds = {i: "abc"[i % 3] for i in range(45)}
    df = spark.createDataFrame(rows, "vec_id long, item long, embedding array<double>")
    table = spark.createDataFrame(list(kinds.items()), "item long, kind string")
    edges = vectors.knn_items(df, 4, "item", block_rows=20)
    got = {r["item"]: (r.predicted, round(r.agreement, 6), r.correct) for r in vectors.best_vote(edges, df, table, "item", "vec_id", "kind").collect()}
    real = [(v, i, e) for v, i, e in rows if any(e)]
    for item in kinds:
        best = (0.0, None)
        for v, _, e in sorted(r for r in real if r[1] == item):
            top = {}
            for _, other, f in real:
                if other != item:
                    top[other] = max(top.get(other, -2), cosine(e, f))
            order = [kinds[i] for i, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:4]]
            label, n = max(Counter(order).items(), key=lambda x: (x[1], -order.index(x[0])))
            if n / len(order) > best[0]:
                best = (n / len(order), label)
        assert got[item] == (best[1], round(best[0], 6), best[1] == kinds[item]), item


def test_folds_keep_groups_apart_and_rows_of_a_group_are_no_neighbours(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, int(rnd.integers(0, 9)) if i % 10 else None, rnd.normal(size=3).tolist(), "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, artist long, embedding array<double>, label string").withColumn("fold", vectors.group_fold(F.col("artist"), 4))
    assert df.filter("artist IS NOT NULL").groupBy("artist").agg(F.countDistinct("fold").alias("n")).filter("n <> 1").count() == 0
    edges = {}
    for r in vectors.knn_edges(df, df, 5, apart="artist", block_rows=16).collect():
        edges.setdefault(r["query"], []).append((r["rank"], r.neighbour))
    for i, artist, e, _ in rows:
        others = sorted((-cosine(e, f), j) for j, a, f, _ in rows if j != i and (artist is None or a != artist))[:5]
        assert [j for _, j in sorted(edges[i])] == [j for _, j in others]


def test_fold_centroids_never_see_their_fold(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, int(rnd.integers(0, 12)), (rnd.normal(size=3) * [1, 100, 0.01] + i % 3).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>, y int")
    for scale in (True, False):
        for r in vectors.nearest_centroid_cv(df, "id", "v", "g", "y", 3, scale).collect():
            mine = {i for i, g, _, _ in rows if g in {x for x, f in folds(df).items() if f == r.fold}}
            rest = [(np.array(v), y) for i, _, v, y in rows if i not in mine]
            sd = np.std([v for v, _ in rest], axis=0) if scale else np.ones(3)
            means = {y: np.mean([v for v, z in rest if z == y], axis=0) for y in {z for _, z in rest}}
            assert r.predicted == min(means, key=lambda y: (round(float((((np.array(rows[r.id][2]) - means[y]) / sd) ** 2).sum()), 6), y))


_folds = {}


def folds(df):
    if not _folds:
        _folds.update({r.g: r.f for r in df.select("g", vectors.group_fold(F.col("g"), 3).alias("f")).distinct().collect()})
    return _folds


def test_rows_are_numbered_over_ranges(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    whole = [r.id for r in ranks.number_rows(df, [-F.col("v"), F.col("id")], "n").orderBy("n").collect()]
    assert whole == [i for _, _, i in sorted(rows, key=lambda r: (-r[1], r[2]))]
    for r in ranks.number_rows(df, [F.col("v"), F.col("id")], "n", ["k"]).collect():
        assert r.n == 1 + sum(k == r.k and (v, i) < (r.v, r.id) for k, v, i in rows)
    top = ranks.running_max(df, [F.col("id")], "v", "m")
    assert all(r.m == max(v for _, v, i in rows if i <= r.id) for r in top.collect())
    assert ranks.number_rows(df.limit(0), [F.col("v")], "n").count() == 0


def test_empty_tables(spark):
    votes = spark.createDataFrame([], "i long, j long, l string")
    assert labels.dawid_skene(votes, "i", "j", "l")[0].count() == 0
    assert labels.bradley_terry(spark.createDataFrame([], "w long, l long"), "w", "l").count() == 0
    mean, directions = vectors.principal_directions(spark.createDataFrame([], "v array<double>"), "v", 2)
    assert mean.size == 0 and directions.size == 0
    assert evalstats.holm(spark.createDataFrame([], "p double"), "p").count() == 0


def test_directions_are_those_of_the_scatter(spark):
    x = np.random.default_rng(1).normal(size=(300, 4)) * [5, 2, 1, 0.2]
    mean, found = vectors.principal_directions(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(7), "v", 2)
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(axis=0))
    assert all(abs(f @ axes[:, -1 - i]) > 0.999 for i, f in enumerate(found))


def test_paths_are_repaired_by_the_first_rung(spark):
    from marlstone.operators import matching

    live = [("/v/A/Song.mp3", 5), ("/v/B/Only.mp3", 5), ("/v/C/twin.mp3", 5), ("/v/D/twin.mp3", 9), ("/v/E/copied - 2.mp3", 5), ("/v/a very long folder name/x.mp3", 5), ("/v/F/many 1.mp3", 3), ("/v/F/many 2.mp3", 3), ("/v/Gé.mp3", None), (None, 1), ("/v/D/twin.mp3", 9)]
    cases = {
        "/V/a/SONG.MP3": ("/v/A/Song.mp3", "casefold"), "/old/only.mp3": ("/v/B/Only.mp3", "basename"), "/old/copied.mp3": ("/v/E/copied - 2.mp3", "copy-suffix"), "/old/only 1 - 2.mp3": ("/v/B/Only.mp3", "copy-suffix"), "/v/a very long folder/y.mp3": ("/v/a very long folder name/x.mp3", "prefix20"),
        "/old/twin.mp3": ("/v/D/twin.mp3", "largest-twin"), "/old/many.mp3": ("/v/F/many 1.mp3", "largest-twin"), "/old/none.mp3": (None, "unresolved"), None: (None, "unresolved"), "/v/Gé.mp3": ("/v/Gé.mp3", "casefold"),
    }
    broken = spark.createDataFrame(list(enumerate(cases)), "id int, path string")
    got = matching.repair_paths(broken, spark.createDataFrame(live, "path string, bytes long"))
    assert {r.id: (r.fix, r.via) for r in got.collect()} == dict(enumerate(cases.values()))


def test_knn_stripes_keep_ties_and_exclusions(spark, monkeypatch):
    # Copies of few vectors: ties cross blocks, steps and stripes, and every one goes to the lower id.
    monkeypatch.setattr(vectors, "CELL_ROWS", 32)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(9, 4))
    data = [(i, base[i % 9].tolist(), i % 5, i % 4) for i in range(150)] + [(150, [0.0] * 4, 1, 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, artist int, lane int")
    m = np.array([d[1] for d in data])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sims = np.floor(unit @ unit.T * 1e6 + 0.5) / 1e6

    def want(refuse):
        return {(i, r + 1): j for i in range(151) for r, j in enumerate(sorted((j for j in range(151) if not refuse(i, j)), key=lambda j: (-sims[i, j], j))[:7])}

    rows_ = lambda edges: {(r["query"], r["rank"]): r["neighbour"] for r in edges.collect()}
    assert rows_(vectors.knn_edges(df, df, 7, same=True, block_rows=8)) == want(lambda i, j: i == j)
    assert rows_(vectors.knn_edges(df, df, 7, apart="artist", block_rows=8)) == want(lambda i, j: data[i][2] == data[j][2])


def test_knn_sends_a_row_once_a_stripe(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 64)
    df = spark.range(640).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q, n = vectors._blocks(df.select(F.col("vec_id").alias("__id"), F.col("vec_id").alias("__mark"), "embedding"), "embedding", 8)
    assert n == 80
    met = vectors._meetings(q, n, q, n, 8, 3, 1e6, True)
    # Ten stripes of eight blocks: three rows a query and stripe, where eighty meetings of blocks would give 240.
    assert met.groupBy("query").count().agg(F.max("count")).first()[0] == 30


def test_bootstrap_adds_over_chunks_and_ranges(spark, monkeypatch):
    # Draws are made in tasks over ranges of the values, never as rows; a null stays out of its mean.
    for name, size in (("RANGE_ROWS", 7), ("CHUNK_DRAWS", 50), ("SPAN", 16)):
        monkeypatch.setattr(evalstats, name, size)
    index = [0, 1, 2, 12345, 4_000_000_000, 2**32 + 5, 10**12]
    wanted = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(index)], "k int, x long").orderBy("k").select(scalar.uniform(F.col("x"), 42)).collect()]
    assert evalstats.uniform_array(np.array(index), 42).tolist() == wanted
    values = [float(i * i % 7) if i % 6 else None for i in range(23)]
    draws = evalstats.uniform_array(np.arange(40 * 23), 42)
    picked = [[values[int(x * 23)] for x in draws[b * 23 : b * 23 + 23]] for b in range(40)]
    means = sorted(np.mean([v for v in p if v is not None]) for p in picked)
    r = evalstats.bootstrap_ci(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "i", F.col("v"), draws=40).first()
    assert (r["low"], r["high"]) == pytest.approx((means[1], means[39]))


def test_knn_steps_grow_with_what_was_seen(monkeypatch):
    # The kth best of few rows lets many of a long step in; steps as long as all before let in about k each.
    m = np.random.default_rng(4).normal(size=(9000, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, hits = np.arange(9000), []
    monkeypatch.setattr(vectors, "_hits", lambda mask, found=vectors._hits: hits.append(found(mask)) or hits[-1])
    query, neighbour, similarity = vectors._block_top(ids[:50], ids[:50], m[:50], ids, ids, m, m.astype(np.float32), 20, 1e6, True, False)
    sims = np.floor(m[:50] @ m.T * 1e6 + 0.5)
    want = [sorted((j for j in range(9000) if j != i), key=lambda j: (-sims[i, j], j))[:20] for i in range(50)]
    assert neighbour.reshape(50, 20).tolist() == want and query.tolist() == [i for i in range(50) for _ in range(20)]
    assert sum(len(r) for r, _ in hits[1:]) < 50 * 20 * 6


def test_csls_corrects_by_the_nearest_of_all_vectors(spark, tmp_path):
    from marlstone.plans import catalog

    m = np.random.default_rng(4).normal(size=(1_700, 6))  # a stride of 1,500 rows would leave half of them out
    spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(m)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in catalog.queries()["csls_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["score"]))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.floor(unit @ unit.T * 1e6 + 0.5) / 1e6
    np.fill_diagonal(sims, -2)
    near = np.argsort(-sims, axis=1, kind="stable")[:, :20]
    r = np.take_along_axis(sims, near[:, :10], axis=1).mean(axis=1)
    scores = -np.sort(-(2 * np.take_along_axis(sims, near, axis=1) - r[:, None] - r[near]), axis=1)[:, :5]
    assert len(got) == len(m)
    assert [[s for _, s in sorted(got[i])] for i in range(len(m))] == [pytest.approx(x, abs=1.1e-4) for x in scores.tolist()]
