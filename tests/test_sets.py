"""Transition scores and sets: rules by hand, the search against brute force, landmarks, edits and cohorts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chains as ch
from marlstone.operators import scoring as sc

SCHEMA = "id long, grp string, bpm double, hour int, mode int, arousal double, dance double, artist string, family string, duration_s double, embedding array<double>, out_bar int, in_bar int"
HALF = {"drum and bass", "dubstep", "hip-hop", "trap", "house", "tech house", "techno", "trance", "breakbeat", "garage", "edm"}
ARCS = {"warmup": ((2.5, 5.5), (0.4, 0.7), (1.0, 1.06)), "peak": ((6, 8.5), (0.7, 0.95), (1.0, 1.02)), "afterhours": ((5, 3), (0.75, 0.6), (1.0, 0.96))}


def item(i, grp="g", bpm=120.0, hour=5, mode=0, arousal=7.0, dance=0.8, artist=None, family=None, seconds=200.0, vec=None, out_bar=None, in_bar=None):
    return (i, grp, bpm, hour, mode, arousal, dance, artist, family, seconds, vec, out_bar, in_bar)


def by_hand(a, b, preset, t, anchor):
    """The score of two items, in plain arithmetic."""
    _, _, ta, ha, ma, ea, _, wa, fa, _, va, *_ = a
    _, _, tb, hb, mb, eb, db, wb, fb, _, vb, *_ = b
    pair = lambda x, y: any(abs(y / (x * f) - 1) <= 0.06 for f in (2, 0.5, 1.5, 2 / 3))
    if abs(tb / anchor - 1) > 0.12 and abs(tb / (2 * anchor) - 1) > 0.06 and abs(tb / (0.5 * anchor) - 1) > 0.06 and not pair(anchor, tb):
        return -1
    d = abs(ta - tb) / max(ta, tb)
    lane = 1 if d <= 0.02 else 0 if d >= 0.06 else 1 - (d - 0.02) / 0.04
    if lane == 0:
        lane = 0.75 * 0.9 if pair(ta, tb) and (fa or "").lower() in HALF and (fb or "").lower() in HALF else 0
    step = min(abs((ha or 0) - (hb or 0)), 12 - abs((ha or 0) - (hb or 0)))
    key = 0.5 if not ha or not hb else 1 if step == 0 or (step == 1 and ma == mb) else 0.9 if step == 1 else 0
    arousal, dance, tempo = ARCS[preset]
    at = lambda p: p[0] + (p[1] - p[0]) * t
    way = 1 if arousal[1] > arousal[0] else -1
    if lane == 0 or key == 0 or (t < 1 and ea is not None and eb is not None and (eb - ea) * way < -0.6):
        return -1
    fit = 1 - min(1, (abs((5 if eb is None else eb) / 9 - at(arousal) / 9) + abs((0.6 if db is None else db) - at(dance))) / 2)
    pull = 1 - min(1, abs(tb / (anchor * at(tempo)) - 1) / 0.02)
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    sim = (dot(va, vb) / math.sqrt(dot(va, va) * dot(vb, vb)) + 1) / 2 if va and vb and len(va) == len(vb) else 0
    head = lambda w: (w or "").split(",")[0].strip().lower()
    raw = 0.45 * lane + 0.3 * key + 0.25 * fit + 0.15 * pull + 0.1 * sim
    return max(0.01, raw - 2) if head(wa) and head(wa) == head(wb) else raw


def pool_of(seed, n, groups=("g",)):
    rnd = random.Random(seed)
    maybe = lambda x, p=0.15: None if rnd.random() < p else x
    return [
        item(i, rnd.choice(groups), maybe(rnd.choice([60.0, 62.0, 90.0, *range(116, 130)]) * 1.0, 0.05), maybe(rnd.randrange(1, 13)), rnd.randrange(2), maybe(rnd.uniform(4, 9)), maybe(rnd.random()),
             maybe(f" Artist{rnd.randrange(6)}, guest{i}"), maybe(rnd.choice(["House", "techno", "pop"])), maybe(rnd.choice([20.0, 180.0, 240.0, 400.0, 1000.0, -1.0])), maybe([rnd.gauss(0, 1) for _ in range(rnd.choice([3, 3, 4]))]), maybe(rnd.randrange(1, 40)), maybe(rnd.randrange(1, 9)))
        for i in range(n)
    ]


def seconds(x):
    return x[9] if x[9] is not None and x[9] > 0 else 300.0


def admitted(rows, grp="g"):
    return {r[0]: r for r in rows if r[1] == grp and r[2] and 60 <= seconds(r) <= 900}


def chain_of(df, grp="g"):
    return [(r.id, r.score) for r in df.filter(F.col("grp") == grp).orderBy("step").collect()]


@pytest.mark.parametrize("preset", list(ARCS))
def test_scores_as_by_hand(spark, preset):
    rows = [r for r in pool_of(1, 60) if r[2]]
    pool = sc.mixable(spark.createDataFrame(rows, SCHEMA))
    a, b = (pool.select("grp", F.struct(*pool.columns).alias(s)) for s in "ab")
    at = F.pmod(F.col("a.id") + F.col("b.id"), F.lit(5)) / 4.0
    fields = [{c: F.col(f"{s}.{c}") for c in sc.FIELDS} for s in "ab"]
    both = a.join(b, "grp").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), at.alias("t"), sc.transition(*fields, preset, at, F.lit(120.0)).alias("s"), sc.evidence(*fields, preset, at, F.lit(120.0)).alias("e"))
    known, seen = {r[0]: r for r in rows}, 0
    for r in both.collect():
        want = by_hand(known[r.a], known[r.b], preset, r.t, 120.0)
        assert r.s == pytest.approx(want, abs=1e-9)
        assert (r.e is None) == (want == -1)
        if r.e:
            seen += 1
            raw = r.e.tempo + r.e.key + r.e.arc_fit + r.e.anchor + r.e.similarity
            assert r.e.total == pytest.approx(max(0.01, raw - 2) if r.e.penalty else raw)
    assert seen > 50


def test_lane_pairs_are_all_pairs_with_a_lane(spark):
    rows = [item(i, bpm=b) for i, b in enumerate([50.0, 53.1, 75.0, 94.0, 100.0, 100.0, 104.0, 106.0, 106.5, 120.0, 141.0, 150.0, 159.0, 200.0, 212.0, 213.0])]
    got = {(r.a.id, r.b.id) for r in sc.lane_pairs(sc.mixable(spark.createDataFrame(rows, SCHEMA)), "grp").collect()}
    lane = lambda x, y: abs(x - y) / max(x, y) < 0.06 or any(abs(y / (x * f) - 1) <= 0.06 for f in (2, 0.5, 1.5, 2 / 3))
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and lane(a[2], b[2])}


def test_types(spark):
    cases = [
        ((False, False, 1, 1, 5.0, 9.0), "hold"), ((True, True, 1, 1, 5.0, 9.0), "half-time-shift"), ((True, False, 30, 4, 6.0, 6.0), "drop-entry"), ((True, False, 30, 5, 4.0, 5.5), "energy-swap"),
        ((True, False, 30, 14, 6.0, 6.0), "long-blend"), ((True, False, 20, 5, 6.0, 6.0), "phrase-cut"), ((True, False, None, 5, 6.0, 8.0), "energy-swap"), ((True, False, 3, None, 6.0, 6.5), "hold"), ((True, False, 20, 4, None, None), "long-blend"),
    ]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "s boolean, h boolean, o int, i int, b double, a double, want string")
    assert df.filter(sc.transition_type(*[F.col(c) for c in "shoiba"]) != F.col("want")).count() == 0


def test_greedy_chain_as_by_hand(spark):
    for seed in range(4):
        rows = pool_of(seed, 80)
        usable = admitted(rows)
        got = chain_of(ch.build_chains(spark.createDataFrame(rows, SCHEMA), ["grp"], "peak", 60, "greedy"))
        near = {i: sum(abs(r[2] - o[2]) / max(r[2], o[2]) < 0.06 for o in usable.values()) for i, r in usable.items()}
        livable = [i for i in usable if near[i] >= 15] or list(usable)
        path = [min(livable, key=lambda i: (abs((5 if usable[i][5] is None else usable[i][5]) / 9 - 6 / 9), i))]
        marks, spent = [None], seconds(usable[path[0]])
        while spent < 3600:
            best = max(((by_hand(usable[path[-1]], r, "peak", min(1, spent / 3600), usable[path[0]][2]), -i) for i, r in usable.items() if i not in path), default=(-1, 0))
            if best[0] <= 0:
                break
            path.append(-best[1])
            marks.append(best[0])
            spent += seconds(usable[path[-1]])
        assert [i for i, _ in got] == path and [s for _, s in got][1:] == pytest.approx(marks[1:])


def test_beam_finds_the_best_of_small_pools(spark):
    """In pools of five no level has more than 24 live chains; where the beam holds them all it is exact."""
    for seed in range(6):
        rnd = random.Random(seed)
        rows = [item(i, bpm=120.0 + rnd.randrange(8), hour=rnd.randrange(1, 4), mode=rnd.randrange(2), arousal=rnd.uniform(5, 9), dance=rnd.random(), seconds=300.0) for i in range(5)]
        got = chain_of(ch.build_chains(spark.createDataFrame(rows, SCHEMA), ["grp"], "peak", 20, "beam"))
        first = next(r for r in rows if r[0] == got[0][0])
        best = (False, 0.0, 1, ())

        def walk(path, total, spent):
            nonlocal best
            rank = (spent >= 1200, total, len(path), tuple(-r[0] for r in path))
            if rank[:2] > (best[0], best[1] + 1e-12):
                best = rank
            if spent < 1200:
                for r in rows:
                    if r not in path and (s := by_hand(path[-1], r, "peak", min(1, spent / 1200), first[2])) > 0:
                        walk([*path, r], total + s, spent + 300)

        walk([first], 0.0, 300)
        assert sum(s for _, s in got[1:]) == pytest.approx(best[1])


def test_search_by_pool_size_and_seed(spark):
    rows = [item(i, "small", bpm=120.0 + i % 6, hour=i % 4 + 1) for i in range(40)] + [item(1000 + i, "big", bpm=120.0 + i % 6, hour=i % 4 + 1) for i in range(250)]
    pool = spark.createDataFrame(rows, SCHEMA)
    which = lambda **kw: {r.grp: r.search for r in ch.build_chains(pool, ["grp"], "peak", 10, **kw).filter("step = 0").collect()}
    assert which() == {"small": "beam", "big": "greedy"} and which(seed=3) == {"small": "greedy", "big": "beam"}
    assert which(search="greedy", seed=1) == {"small": "greedy", "big": "greedy"}
    openers = {r.seed: r.id for r in ch.variants(pool.filter("grp = 'small'"), ["grp"], "peak", 10, 99).filter("step = 0").collect()}
    assert openers == {s: s for s in range(8)}


def test_every_row_is_placed_or_rejected_and_steps_explain_themselves(spark):
    rows = pool_of(7, 300, ("g", "h", "empty"))
    rows = [r if r[1] != "empty" else (*r[:2], None, *r[3:]) for r in rows]
    pool = spark.createDataFrame(rows, SCHEMA)
    chains = ch.build_chains(pool, ["grp"], "warmup", 40, "greedy").cache()
    why = {r.id: r.reason for r in ch.rejected(pool, chains, ["grp"]).collect()}
    placed = {r.id for r in chains.collect()}
    assert placed.isdisjoint(why) and placed | set(why) == {r[0] for r in rows}
    for r in rows:
        if r[0] in why and not 60 <= seconds(r) <= 900:
            assert why[r[0]] == ("too short" if seconds(r) < 60 else "too long")
    told = {(r.grp, r.id): r for r in ch.explain(chains, pool, ["grp"], "warmup", 40).collect()}
    for r in chains.collect():
        assert told[r.grp, r.id].at_s == r.at_s and told[r.grp, r.id].end_s == r.end_s
        assert told[r.grp, r.id].score == (None if r.score is None else pytest.approx(r.score))
    cover = {r.grp: r for r in ch.typed_coverage(ch.explain(chains, pool, ["grp"], "warmup", 40), ["grp"]).collect()}
    assert all(cover[g].total == len(chain_of(chains, g)) - 1 for g in ("g", "h"))


def test_landmarks_go_to_the_first_open_place(spark):
    inserted = 0
    for seed in range(3):
        rows = pool_of(20 + seed, 120, ("g", "h"))
        pool = spark.createDataFrame(rows, SCHEMA)
        chains = ch.build_chains(pool, ["grp"], "peak", 40, "greedy").cache()
        rnd = random.Random(seed)
        pins = [(g, rnd.choice([r[0] for r in rows if r[1] == g]), t) for g in ("g", "h") for t in range(6)] + [("g", 9999, 6), ("h", rows[0][0] if rows[0][1] == "h" else 8888, 0)]
        made, fates = ch.insert_landmarks(chains, pool, spark.createDataFrame(pins, "grp string, id long, turn int"), ["grp"], "peak", 40)
        fate = {(r.grp, r.id): r.outcome for r in fates.collect()}
        for g in ("g", "h"):
            usable = admitted(rows, g)
            want, told = chain_of(chains, g), {}
            asked = {}
            for x, i, t in pins:
                if x == g:
                    asked[i] = min(t, asked.get(i, t))
            for pin in sorted(asked, key=lambda i: (asked[i], i)):
                if pin in [i for i, _ in chain_of(chains, g)]:
                    told[pin] = "chosen"
                    continue
                if pin not in usable:
                    told[pin] = "not in the pool"
                    continue
                told[pin] = "no place"
                for at in range(len(want) - 1):
                    spent = sum(seconds(usable[i]) for i, _ in want[: at + 1])
                    a, p, b = usable[want[at][0]], usable[pin], usable[want[at + 1][0]]
                    into = by_hand(a, p, "peak", min(1, spent / 2400), usable[want[0][0]][2])
                    out = by_hand(p, b, "peak", min(1, (spent + seconds(p)) / 2400), usable[want[0][0]][2])
                    if into > 0 and out > 0:
                        want[at + 1 : at + 2] = [(pin, into), (want[at + 1][0], out)]
                        told[pin] = "inserted"
                        inserted += 1
                        break
            got = chain_of(made, g)
            assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got[1:]] == pytest.approx([s for _, s in want[1:]])
            assert {i: o for (x, i), o in fate.items() if x == g} == told
    assert inserted >= 3


def test_kept_steps_never_move_and_reruns_agree(spark):
    for seed in range(4):
        rows = pool_of(40 + seed, 200, ("g", "h", "i"))
        pool = spark.createDataFrame(rows, SCHEMA)
        chains = ch.build_chains(pool, ["grp"], "peak", 60, "greedy").cache()
        rnd = random.Random(seed)
        kept = [(r.grp, r.id) for r in chains.collect() if rnd.random() < 0.4] + [("g", 12345)]
        for search in ("greedy", "beam"):
            again = lambda: {(r.grp, r.step): r.id for r in ch.regenerate(chains, pool, spark.createDataFrame(kept, "grp string, id long"), ["grp"], "peak", 60, search, seed=1).collect()}  # noqa: E731, B023
            new = again()
            assert new == again()
            assert len(set(new.values())) == len(new)
            for r in chains.collect():
                if (r.grp, r.id) in kept and max((s for g, s in new if g == r.grp), default=-1) >= r.step:
                    assert new[r.grp, r.step] == r.id
                assert (r.grp, r.id) not in kept or new.get((r.grp, r.step), r.id) == r.id


def test_swaps(spark):
    chains = spark.createDataFrame([("g", s, 10 + s) for s in range(4)], "grp string, step long, id long")
    swaps = spark.createDataFrame([("g", 11, 50), ("g", 12, 13), ("g", 99, 60), ("g", 13, 50), ("h", 10, 1)], "grp string, id long, by long")
    assert sorted((r.step, r.id) for r in ch.swap_steps(chains, swaps, ["grp"]).collect()) == [(0, 10), (1, 50), (2, 12), (3, 13)]


def test_cohorts(spark):
    rows = [item(i, bpm=120.0 + i % 5, hour=i % 3 + 1, arousal=3.0 + i % 6, family=["Tech House", "techno", "Deep House", None, ""][i % 5]) for i in range(400)]
    pool = spark.createDataFrame(rows, SCHEMA)
    families = {"house": ["house"], "tech house": ["tech house", "tech-house"], "dub": ["dub"]}
    made = ch.cohorts(pool, families, 20).cache()
    genre = {r[0]: (r[8] or "").lower() for r in rows}
    assert {(r.cohort, r.arm) for r in made.collect()} == {(f, a) for f in ("house", "tech house") for a in ("warmup", "peak")}
    assert all(any(t in genre[r.id] for t in families[r.cohort]) for r in made.collect())
    apart = [r.id for r in ch.cohorts(pool, families, 20, exclusive=True).collect()]
    assert len(apart) == len(set(apart)) and len(apart) >= 16
    told = {(r.cohort, r.arm): r for r in ch.summary(made, ["cohort", "arm"], 20).collect()}
    assert all(r.complete == (r.shortfall_minutes == 0) and r.actual_minutes + r.shortfall_minutes >= 20 for r in told.values())


def test_scorecard(spark):
    rows = [item(1, "a", arousal=6.0, artist="X, y"), item(2, "a", arousal=7.25, artist="z"), item(3, "a", arousal=8.5, artist="Z,k"), item(9, "b", arousal=None)]
    chains = spark.createDataFrame([("a", 0, 1, None, 0.0), ("a", 1, 2, 0.8, 300.0), ("a", 2, 3, 0.4, 600.0), ("b", 0, 9, None, 150.0)], "grp string, step long, id long, score double, end_s double")
    fates = spark.createDataFrame([("a", 1, "chosen"), ("a", 7, "no place")], "grp string, id long, outcome string")
    got = {r["grp"]: r.asDict() for r in ch.scorecard(chains, spark.createDataFrame(rows, SCHEMA), ["grp"], "peak", 20, fates).collect()}
    assert got["a"] == {"grp": "a", "transition": 60.0, "floor": 40.0, "arc": 100.0, "diversity": 0.0, "budget": 50.0, "landmark": 50.0, "total": 54.0}
    assert got["b"] == {"grp": "b", "transition": 100.0, "floor": 100.0, "arc": 50.0, "diversity": 100.0, "budget": 12.5, "landmark": 100.0, "total": 81.3}


def test_no_rows_no_sets(spark):
    pool = spark.createDataFrame([], SCHEMA)
    assert ch.build_chains(pool, ["grp"]).count() == 0
    useless = spark.createDataFrame([item(1, bpm=None), item(2, bpm=0.0), item(3, seconds=10.0)], SCHEMA)
    assert ch.build_chains(useless, ["grp"]).count() == 0
    assert {r.reason for r in ch.rejected(useless, ch.build_chains(useless, ["grp"]), ["grp"]).collect()} == {"no tempo", "too short"}
