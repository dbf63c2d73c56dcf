"""Ladders, matching and statistics against small cases and plain loops."""

import random

from pyspark.sql import functions as F

from marlstone.functions import names as nm
from marlstone.operators import energy as en
from marlstone.operators import evalstats as es
from marlstone.operators import evidence as ev
from marlstone.operators import lifecycle as lc
from marlstone.operators import matching as mt
from marlstone.operators import scoring as sc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_artist_gate(spark):
    credits = F.array(F.lit("Various"), F.lit("Anna B"), F.lit("anna"))
    assert one(spark, nm.artist_points(F.lit("Anna, Bob"), credits)) == 4  # the first credit that holds the name counts
    assert one(spark, nm.artist_points(F.lit("VARIOUS & x"), credits)) == 6
    assert one(spark, nm.artist_points(F.lit("DJ"), credits)) == 0 and not one(spark, nm.artist_fails(F.lit("DJ"), credits))
    assert one(spark, nm.artist_fails(F.lit("Carl"), credits)) and not one(spark, nm.artist_fails(F.lit(None).cast("string"), credits))
    assert one(spark, nm.artist_points(F.lit("Carl"), F.lit(None).cast("array<string>"))) == 0
    assert one(spark, nm.artist_points(F.lit("Carl"), F.array(F.lit(None).cast("string"), F.lit("carl")))) == 6


def test_title_overlap(spark):
    assert one(spark, nm.title_overlap(F.lit("The Red Red Sun!"), F.lit("red moon"))) == 1 / 3
    assert one(spark, nm.title_overlap(F.lit("a b"), F.lit("a b"))) == 0.0
    assert one(spark, nm.title_overlap(F.lit(None).cast("string"), F.lit("x"))) == 0.0
    assert one(spark, nm.key_token(F.lit(" 8b "))) == "08B" and one(spark, nm.key_token(F.lit("13A"))) is None


def test_imprint_abstains_in_doubt(spark):
    table = {"drumcode": "techno", "afterlife recordings": "techno", "blue one": "x", "blue two": "y"}
    got = [one(spark, nm.imprint(F.lit(s).cast("string"), table)) for s in ("Drumcode Records", "Afterlife", "blue", "123", "music", "", None)]
    assert got == ["drumcode", "afterlife recordings", None, None, None, None, None]


def test_locate_prefers_exact(spark):
    inv = spark.createDataFrame([("d1", "/a/x.mp3", "Song", "Anna"), ("d2", "/a/song anna.mp3", None, None), ("d3", "/b", "Song", "anna")], "drive string, path string, title string, artist string")
    assert {(r.drive, r.n) for r in mt.locate(inv, " anna - SONG ").collect()} == {("d1", 1), ("d3", 1)}
    assert {r.drive for r in mt.locate(inv, "song").collect()} == {"d1", "d2", "d3"}
    assert mt.locate(inv, " ").count() == 0


def test_archive_verdicts(spark):
    shelf = spark.createDataFrame([("a/X.mp3", 1), ("a/y [usb].mp3", 2), ("a/y.mp3", 9), (".hidden", 5)], "path string, bytes long")
    files = spark.createDataFrame([("a/x.mp3", 1), ("a/y.mp3", 2), ("a/x.mp3", 7), ("b/n", 3), (".hidden", 6)], "path string, bytes long")
    got = sorted((r.path, r.verdict, r.dest) for r in lc.classify_files(files, shelf, "usb").collect())
    assert got == [(".hidden", "copy", ".hidden [usb]"), ("a/x.mp3", "copy", "a/x [usb].mp3"), ("a/x.mp3", "covered", None), ("a/y.mp3", "preserved", None), ("b/n", "copy", "b/n")]


def test_work_queue_force(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, True), (2, 3, 99.0, False), (3, 3, 5.0, True), (4, 3, None, None)], "id long, beats int, seconds double, analyzed boolean")
    got = {r.id: (r.status, r.reason) for r in lc.work_queue(rows, 10).collect()}
    assert got == {1: ("skipped", "no beats"), 2: ("skipped", "over duration cap"), 3: ("analyzed", None), 4: ("pending", None)}
    assert {r.status for r in lc.work_queue(rows, 10, force=True).filter("id = 3").collect()} == {"pending"}


def test_section_match_is_greedy(spark):
    rng = random.Random(3)
    names = ["chorus", "Drop", "up", "buildup", "intro"]
    make = lambda: {k: [(rng.randrange(30), rng.choice(names)) for _ in range(rng.randrange(7))] for k in range(60)}
    p, t = make(), make()
    frame = lambda d: spark.createDataFrame([(k, s, n) for k, v in d.items() for s, n in v], "k long, start long, label string")
    plain = lambda s: {"chorus": "drop", "up": "buildup"}.get(s.lower(), s.lower())
    want = {}
    for k in p:
        ps, ts = sorted(p[k]), sorted(t[k])
        if not ps and not ts:
            continue
        taken, seen, same = set(), 0, 0
        for s, label in ps:
            near = [i for i, (x, _) in enumerate(ts) if abs(x - s) <= 2]
            taken |= set([i for i in near if i not in taken][:1])
            if near:
                seen += 1
                same += plain(ts[near[0]][1]) == plain(label)
        both = bool(ps and ts)
        want[k] = (2 * len(taken) / (len(ps) + len(ts)) if both else 0.0, same / seen if seen else 0.0, max(0, len(ps) - len(ts)) / len(ts) if both else float(bool(ps)), max(0, len(ts) - len(ps)) / len(ts) if both else float(bool(ts)))
    got = {r.k: (r.f1, r.label_accuracy, r.over, r.under) for r in es.section_match(frame(p), frame(t), "k", 2).collect()}
    assert got == want


def test_gates_without_rows(spark):
    empty = spark.createDataFrame([], "a double, b double, g int")
    gates = en.collect_gates([en.gate_dominance(empty, ["a", "b"]), en.gate_not_tempo(empty, "a", "b"), en.gate_direction(empty, F.col("g"), "a"), en.gate_bands(empty, "gain-invariance", "a", "b"), en.gate_bands(empty, "duplicate-consistency", "a", "b", empty=True)])
    rows = gates.collect()
    assert {r.name: r["pass"] for r in rows} == {"bloc-dominance": False, "not-bpm": False, "genre-direction": False, "gain-invariance": False, "duplicate-consistency": True}
    assert {(r.passed, r.total, r.all_pass) for r in rows} == {(1, 5, False)}


def test_opener_falls_back_and_wraps(spark):
    pool = spark.createDataFrame([(1, 120.0, 0.9), (2, 121.0, None), (3, 122.0, 0.1), (4, 70.0, 0.1)], "id long, bpm double, arousal double")
    pick = lambda **kw: sc.opener(pool, 0.1, **kw).first().id
    assert pick(neighbours=3) == 3 and pick(neighbours=3, seed=1) == 2 and pick(neighbours=3, seed=5) == 1
    assert pick(neighbours=50) == 3 and pick(neighbours=50, seed=1) == 4
    assert sc.opener(pool.limit(0), 0.1).count() == 0


def test_evidence_rows(spark):
    votes = spark.createDataFrame([("t", "bp", "House"), ("t", "bp", "deep house"), ("t", "sc", "pop"), ("t", "odd", "house")], "track string, rung string, genre string")
    family = F.when(F.lower("genre").contains("house"), "house")
    rows = ev.votes_to_evidence(votes, family).collect()
    assert [(r.annotator, r.scope, r.family, r.subgenre, r.confidence) for r in rows] == [("vote:bp", "exact_recording", "house", "House", 0.9)]
    sibs = spark.createDataFrame([("t", "a", "same_song_other_version", "House", None, 0.5), ("t", "b", "same_song_other_version", "house", None, 0.7), ("t", "c", "user", "x", None, 0.1)], "track string, annotator string, scope string, family string, subgenre string, confidence double")
    assert sorted((r.annotator, r.family, r.confidence) for r in ev.with_collapsed(sibs).collect()) == [("c", "x", 0.1), ("sibling:collapsed:b", "house", 0.7)]


def test_cumulative_over_ranges(spark):
    from marlstone.operators.ranks import cumulative

    rng = random.Random(5)
    rows = [(k, v) for k in "ab" for v in [rng.randrange(40) * 1.5 for _ in range(300)]] + [("a", None)] * 3
    counts = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    low = lambda x: float("-inf") if x is None else x
    for ranges in (2, 64):
        for r in cumulative(counts, "v", "n", "run", "all", ["k"], ranges).collect():
            mine = [low(v) for k, v in rows if k == r.k]
            assert (r.run, r.all) == (sum(v <= low(r.v) for v in mine), len(mine))
    assert cumulative(counts.filter("n < 0"), "v", "n", "run", "all").count() == 0


def test_copies_share_a_title(spark):
    from marlstone.functions.text import clean_title, stem_key

    got = [one(spark, clean_title(F.lit(s).cast("string"))) for s in ("Song [archive 2]", " SONG (12)", "Song [BACKUP2] (1)", "Song [live]", None)]
    assert got == ["song", "song", "song", "song [live]", None]
    assert [one(spark, stem_key(F.lit(s))) for s in ("/a.b/Song [archive].mp3", ".hidden", "x/a.b.c")] == ["song", ".hidden", "a.b"]
