"""Logs of verification runs, nested search and the batch estimator, on cases by hand."""

import json

from pyspark.sql import functions as F

from marlstone.operators import labels, runlogs

PEOPLE = """scan
  tracks: 120
export.pdb=119 tracks, OneLibrary DB=118 tracks
playlists: 7 entries: 300 dangling: 2
artist FK bad: 1
missing audio: 3
bad grids (generated): 5
pioneer-native variance (informational): 9
=== cross-drive ===
DB byte-identical: true
ANLZ full hash parity: 4/240 mismatches
audio hash spot-check (40): 1 mismatches
"""
SECOND = PEOPLE.replace("120", "999").replace("missing audio: 3", "missing audio: 8")
DRIVES = {"A": {"tracks": 10, "pdb_tracks": 9, "missing_files": ["a", "b"], "no_bpm": [], "bad_grids": ["g"]}, "B": {"tracks": 5, "missing_files": ["c"], "anlz_consistency": ["h", "i"], "no_bpm": ["n"], "missing_anlz": ["m"]}}


def line(x):
    return f"noise\n{runlogs.MARK}{x if isinstance(x, str) else json.dumps(x)}\n"


def test_verify_logs(spark):
    whole = {"drives": DRIVES, "db_identical": False, "anlz_mismatches": ["x"], "anlz_total": 50, "audio_mismatches": []}
    logs = {
        "people": PEOPLE, "two": PEOPLE + SECOND, "json": PEOPLE + line(whole), "cut": PEOPLE + line(json.dumps(whole)[:60]), "null drive": PEOPLE + line({"drives": {"A": None}}), "one null": line({"drives": DRIVES | {"C": None}}), "twice": line(whole) + line("{}"),
        "inner": PEOPLE + "x " + runlogs.MARK + json.dumps(whole), "nothing": "", "null": None, "new grids": "ANLZ consistency failures (generated): 6\nbad grids (generated): 5",
    }
    got = {r.run_id: r for r in runlogs.verify_metrics(spark.createDataFrame(list(logs.items()), "run_id string, log string")).collect()}
    p = got["people"]
    assert (p.structured, p.tracks, p.pdb, p.odb, p.playlists, p.entries, p.dangling, p.artist_fk, p.variance) == (False, 120, 119, 118, 7, 300, 2, 1, 9)
    assert (p.missing_audio, p.missing_analysis, p.bad_grids, p.cross_drive, p.identical, p.parity_bad, p.parity_total, p.audio_bad) == (3, 0, 5, True, True, 4, 240, 1)
    for same in ("two", "cut", "null drive", "inner"):
        assert got[same][1:] == p[1:], same
    j = got["json"]
    assert (j.structured, j.tracks, j.pdb, j.odb, j.dangling, j.variance) == (True, 15, 9, None, None, 9)
    assert (j.missing_audio, j.missing_audio_list, j.no_bpm, j.bad_grids, j.bad_grids_list) == (3, ["a", "b", "c"], 1, 3, ["g", "h", "i"])
    assert (j.missing_analysis, j.missing_analysis_list) == (0, ["m"])  # not listed for every drive: counted from the lines
    assert (j.cross_drive, j.identical, j.parity_bad, j.parity_total, j.audio_bad) == (True, False, 1, 50, 0)
    assert got["twice"][1:9] == (True, 15, 9, None, None, None, None, None) and got["one null"].tracks == 15 and got["one null"].cross_drive is False and got["one null"].parity_bad is None
    assert got["new grids"].bad_grids == 6
    assert got["nothing"][1:] == got["null"][1:] and got["null"].tracks is None and got["null"].dangling == 0


def test_search_over_snapshots(spark):
    snap = {"track_count": 9, "playlists": [{"name": "Warm House", "entries": 5}, {"name": "x", "entries": 1}] + [{"name": f"house {i}", "entries": i} for i in range(12)], "folders": [{"name": "HOUSE", "files": 3}]}
    drives = [(1, "DJMASTER", None, True, json.dumps(snap)), (2, "House Stick", "h2", False, None), (3, "x", "my house", None, "{broken"), (4, "none", None, True, json.dumps(snap | {"playlists": [], "folders": []})), (5, None, None, True, json.dumps({"folders": [{"name": "Deep House", "files": 2}]}))]
    got = {r.drive_id: r for r in runlogs.search_snapshots(spark.createDataFrame(drives, "id long, name string, nickname string, mounted boolean, snapshot string"), "HoUse").collect()}
    assert {i: [tuple(m) for m in r.matches][:2] for i, r in got.items()} == {1: [("playlist", "Warm House", 5), ("playlist", "house 0", 0)], 2: [("drive", "h2", 0)], 3: [("drive", "my house", 0)], 5: [("folder", "Deep House", 2)]}
    assert len(got[1].matches) == 10 and got[2].drive_name == "h2" and got[3].mounted is False


def test_estimator(spark):
    votes = [(i, a, "x" if a < 3 or i % 5 else "y") for i in range(40) for a in range(4)] + [(100, 0, "y"), (100, 1, "x")]
    df = spark.createDataFrame(votes, "i long, a long, l string")
    truth = spark.createDataFrame([(i, "x") for i in range(20)] + [(500, "x")], "i long, truth string")
    got, rule = labels.estimate(df, truth, "i", "a", "l")
    rule = rule.first()
    assert rule.n == 20 and rule.precision == 1.0 and rule.coverage == 1.0 and rule.tau == 0.3
    rows = {r.i: r for r in got.collect()}
    assert set(rows) == {i for i, _, _ in votes} and all(r.label == "x" and r.gated for i, r in rows.items() if i < 40)
    wrong, bad = labels.estimate(df, truth.withColumn("truth", F.lit("z")), "i", "a", "l")
    assert bad.first().tau == 0.95 and {r.gated for r in wrong.collect()} <= {True, False}
    none = labels.estimate(df, truth.limit(0), "i", "a", "l")[1].first()
    assert (none.temperature, none.tau, none.n) == (1.0, 0.5, 0)
    assert labels.estimate(df.limit(0), truth, "i", "a", "l")[0].count() == 0


def test_sub_labels(spark):
    gated = spark.createDataFrame([(1, "house", 0.8), (2, "house", 0.5), (3, None, 0.4)], "i long, label string, probability double")
    subs = spark.createDataFrame([("house", s, n) for n, s in enumerate(["deep house", "house", "tech house", "a", "b", "c"])] + [("pop", "pop", 0)], "family string, sub string, place int")
    evidence = spark.createDataFrame([(1, "house", " Deep House ", 2.0), (1, "house", "deep house/tech house", 1.0), (1, "house", "tech house", 1.0), (1, "pop", "deep house", 9.0)], "i long, family string, raw string, weight double")
    got = {}
    for r in labels.sub_labels(gated, evidence, subs, "i").orderBy("i", "rank").collect():
        got.setdefault(r.i, []).append((r["sub"], round(r.score, 4), r.votes))
    # "tech house" holds "house", which comes first in its family.
    assert got[1] == [("deep house", 0.6, 2), ("house", 0.2, 1)]
    assert [s for s, _, _ in got[2]] == ["deep house", "house", "tech house", "a", "b"] and got[2][0][1:] == (round(0.5 / 6, 4), 0) and set(got) == {1, 2}
