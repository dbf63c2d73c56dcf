"""Gold annotations with bad files among them, and watched progress over several batches with a restart."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marlstone.sources import readers
from marlstone.streaming import events

GOOD = {"hash": "a" * 64, "version": 1, "branch": "house", "firstDownbeatMs": 12.5, "bpm": 126, "phraseBars": [1, 33, 65], "hotCuesMs": [0, 1000.5]}


def test_one_bad_file_costs_one_row(spark, tmp_path):
    bad = {
        "json": "{not json", "list": [1], "hash": GOOD | {"hash": "A" * 64}, "hash2": GOOD | {"hash": 5}, "version": GOOD | {"version": 2}, "branch": GOOD | {"branch": "pop"}, "down": GOOD | {"firstDownbeatMs": -1}, "down2": GOOD | {"firstDownbeatMs": "1"}, "bpm": GOOD | {"bpm": 0.5}, "bpm2": GOOD | {"bpm": 401},
        "bars": GOOD | {"phraseBars": [1, 2.5]}, "bars2": GOOD | {"phraseBars": [1, 1]}, "bars3": GOOD | {"phraseBars": "x"}, "bars4": {k: v for k, v in GOOD.items() if k != "phraseBars"}, "cues": GOOD | {"hotCuesMs": list(range(9))}, "cues2": GOOD | {"hotCuesMs": [5, 4]}, "cues3": GOOD | {"hotCuesMs": [None]}, "cues4": GOOD | {"hotCuesMs": ["5"]}, "note": GOOD | {"note": 3},
    }
    good = {"g1": GOOD, "g2": GOOD | {"hash": "0" * 64, "note": "n", "extra": {"hash": 1}}, "g3": GOOD | {"hash": "5" * 64, "phraseBars": [], "hotCuesMs": []}}
    for name, x in (bad | good).items():
        (tmp_path / f"{name}.json").write_text(x if isinstance(x, str) else json.dumps(x))
    (tmp_path / "readme.txt").write_text("no annotation")
    rows, issues = readers.gold_annotations(spark, str(tmp_path))
    assert {r.file: r.bpm for r in rows.collect()} == {f"{n}.json": 126.0 for n in good}
    errors = {r.file[:-5]: r.error.split(" ")[0] for r in issues.collect()}
    assert errors == {n: {"json": "not", "list": "annotation", "down": "firstDownbeatMs", "bars": "phraseBars", "cues": "hotCuesMs"}.get(n.rstrip("234"), n.rstrip("234")) for n in bad}
    got = {r.file: (r.phrase_bars, r.hot_cues_ms, r.note) for r in rows.collect()}
    assert got["g1.json"] == ([1, 33, 65], [0.0, 1000.5], None) and got["g2.json"][2] == "n" and got["g3.json"] == ([], [], None)


def test_the_split_is_stable(spark):
    for n, dev in ((0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (100, 67)):
        df = spark.createDataFrame([(f"{i * 7919 % 1009:04d}",) for i in range(n)], "hash string")
        sides = {r.hash: r.side for r in readers.dev_and_holdout(df).collect()}
        assert sides == {r.hash: r.side for r in readers.dev_and_holdout(df.orderBy(F.desc("hash"))).collect()}
        assert [h for h, s in sorted(sides.items()) if s == "dev"] == sorted(sides)[:dev]


T0 = datetime(2024, 1, 1)


def test_watched_progress_over_batches_and_a_restart(spark, tmp_path):
    schema = "job string, ts timestamp, done double"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [("a", at(0), 0.0), ("a", at(0.1), 5.0), ("a", at(0.3), 10.0), ("a", at(2), 20.0), ("b", at(0), 50.0), ("c", at(0), 1.0), ("n", None, 1.0)],
        [("a", at(10), 100.0), ("a", at(11), 30.0), ("c", at(20), 2.0), ("d", at(30), 10.0)],
        [("c", at(39), 3.0), ("d", at(40), 11.0), ("e", at(100), 1.0)],
        [("c", at(101), 99.0), ("b", at(101), 60.0), ("e", at(102), 2.0)],
        [("e", at(103), 3.0), ("f", at(103), 1.0)],
    ]
    spark.createDataFrame([], schema).write.parquet(source)

    def run() -> None:
        stream = spark.readStream.schema(schema).parquet(source)
        watched = events.watch(stream, "job", "done", 100.0, every=0.25, stall=30.0, budget=60.0, late="1 second")
        watched.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for rows in batches:  # every batch is a run of its own, which starts from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run()
    got = {}
    for r in spark.read.parquet(out).orderBy("job", "at").collect():
        got.setdefault(r.job, []).append((round((r["at"] - T0).total_seconds(), 3), r.event, r.progress, None if r.seconds_left is None else round(r.seconds_left, 3)))
    assert got["a"] == [(0.0, "progress", 0.0, None), (0.3, "progress", 0.1, None), (2.0, "progress", 0.2, 8.0), (10.0, "done", 1.0, 0.0)]
    assert got["b"] == [(0.0, "progress", 0.5, None), (30.0, "stalled", 0.5, None)]
    assert [x[:2] for x in got["c"]] == [(0.0, "progress"), (20.0, "progress"), (39.0, "progress"), (60.0, "over budget")]
    assert [x[:2] for x in got["d"]] == [(30.0, "progress"), (40.0, "progress"), (70.0, "stalled")]
    assert [x[:2] for x in got["e"]] == [(100.0, "progress"), (102.0, "progress"), (103.0, "progress")]
