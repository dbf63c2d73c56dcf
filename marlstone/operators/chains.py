"""Set building on transition scores: chains, landmarks, edits, cohorts, variants and their scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import scoring as sc
from marlstone.session import materialise

# The shortest and longest item of a set in seconds, and the beam.
SHORTEST, LONGEST = 60, 900
BEAM_POOL, BEAM_WIDTH = 250, 8
NEIGHBOURS = 15
FIELDS = ("bpm", "hour", "mode", "arousal", "felt", "dance", "half")


def _scores(rows: dict, i: int, preset: dict, t: float, anchor: float):
    """The transition score from row ``i`` to every row, as an array; -1 behind a gate."""
    import numpy as np

    alike = (rows["dims"] > 0) & (rows["dims"] == rows["dims"][i])
    sim = np.where(alike, (rows["unit"] @ rows["unit"][i] + 1) / 2, 0.0)
    a = {c: rows[c][i] for c in (*FIELDS, "who")}
    return sc.blend(sc.terms(a, rows, preset, t, anchor, sim, sc.ARRAYS), sc.ARRAYS)


def _search(rows: dict, first: int, preset: dict, budget: float, width: int, slots: dict[int, int]) -> tuple[list[int], list[float], str]:
    """A chain from row ``first``: rows, scores and why it ends. Rows are in the order of their ids.

    Width 1 takes the best next row; more keeps so many chains that are not full, by score, and gives
    the best of all seen: full ones first, then by score, length and ids. ``slots`` holds rows fixed
    at a step; they are taken whatever their score.
    """
    import numpy as np

    anchor, seconds, fixed = float(rows["bpm"][first]), rows["seconds"], set(slots.values())
    rank = lambda c: (-c[3], -c[2], -len(c[0]), c[0])
    live = best = ([first], [float("nan")], 0.0, bool(seconds[first] >= budget), float(seconds[first]))
    frontier = [best]
    while frontier and not (width == 1 and live[3]):
        grown = []
        for path, marks, total, full, spent in frontier:
            if full:
                continue
            s = np.array(_scores(rows, path[-1], preset, min(1.0, spent / budget), anchor), float)
            slot = slots.get(len(path))
            if slot is not None:
                picks = [slot]
            else:
                s[[*path, *fixed]] = -1
                picks = np.lexsort((np.arange(len(s)), -s)) if width > 1 else [int(np.argmax(s))]
                fills = seconds + spent >= budget
                picks = [j for j in picks if s[j] > 0]
                picks = picks if width == 1 else [j for j in picks if not fills[j]][:width] + [j for j in picks if fills[j]][:1]
            grown += [([*path, int(j)], [*marks, float(s[j])], total + float(s[j]), bool(spent + seconds[j] >= budget), spent + float(seconds[j])) for j in picks]
        if not grown:
            break
        best = min([best, *grown], key=rank)
        frontier = sorted((g for g in grown if not g[3]), key=rank)[:width]
        live = grown[0]
    path, marks, _, full, _ = live if width == 1 else best
    why = "budget" if full else "exhausted" if width == 1 and len(path) == len(seconds) else "deadend"
    return path, marks, why


def build_chains(pool: DataFrame, group: list[str], preset: str = "peak", minutes: float = 60, search: str | None = None, seed: int = 0) -> DataFrame:
    """``*group, step, id, score, at_s, end_s, stop, search``: a set for every group of a pool.

    ``pool`` has the columns of :func:`scoring.mixable`, ``opener`` and ``slot`` if wanted: the row
    marked opener opens, a row with a slot stands at that step. Rows of under 1 or over 15 minutes
    and rows without a tempo stay out. Else the row nearest to the preset's first arousal opens
    among those with 15 others in their tempo lane (all, if none has so many); seed s takes the s-th.
    Pools under 250 rows are searched by a beam of 8, larger ones greedily; an odd seed swaps the
    two, ``search`` (beam or greedy) settles it. Columns ``preset``, ``seed`` and ``search`` of the
    pool go before the arguments. ``at_s`` is the clock at which a step was scored, ``end_s`` the one
    behind it; an opener has no score. Ties go by the id.

    The search is sequential in a group and parallel over groups: a group is a session's pool, which
    its caller bounds. Groups without usable rows give none; ``rejected`` tells why rows stay out.
    """
    ready = sc.mixable(pool).filter(F.col("seconds").between(SHORTEST, LONGEST))
    schema = ready.select(*group).schema
    named = {"preset": preset, "search": search, "seed": seed}

    def build(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rows = {c: pdf[c].to_numpy() for c in (*FIELDS, "who", "seconds", "id")}
        lengths = pdf["emb"].map(lambda e: 0 if e is None else len(e)).to_numpy()
        unit = np.zeros((len(pdf), int(lengths.max(initial=0))))
        for i in np.flatnonzero(lengths):
            unit[i, : lengths[i]] = pdf["emb"].iat[i]
        norms = np.linalg.norm(unit, axis=1)
        rows["unit"], rows["dims"] = unit / np.where(norms > 0, norms, 1)[:, None], np.where(norms > 0, lengths, 0)
        args = {k: pdf[k].iat[0] if k in pdf else v for k, v in named.items()}
        shape, turn = sc.PRESETS[args["preset"]], int(args["seed"])
        asked = np.flatnonzero(pdf["opener"].fillna(False).to_numpy(bool)) if "opener" in pdf else ()
        slots = {int(pdf["slot"].iat[i]): int(i) for i in np.flatnonzero(pdf["slot"].notna())} if "slot" in pdf else {}
        if 0 in slots or len(asked):
            first = slots.get(0, int(asked[0]) if len(asked) else None)
        else:
            tempos = np.sort(rows["bpm"])
            near = np.searchsorted(tempos, rows["bpm"] / (1 - sc.LANE), "left") - np.searchsorted(tempos, rows["bpm"] * (1 - sc.LANE), "right")
            order = np.lexsort((np.arange(len(pdf)), np.abs(rows["arousal"] / 9 - shape["arousal"][0] / 9)))
            order = [i for i in order if i not in slots.values()] or list(order)
            livable = [i for i in order if near[i] >= NEIGHBOURS] or order
            first = int(livable[turn % len(livable)])
        beam = args["search"] == "beam" if args["search"] else (len(pdf) < BEAM_POOL) != bool(turn % 2)
        path, marks, why = _search(rows, first, shape, minutes * 60, BEAM_WIDTH if beam else 1, slots)
        ends = np.cumsum(rows["seconds"][path])
        marks = [None if m != m else m for m in marks]
        out = {g: pdf[g].iat[0] for g in group} | {"step": range(len(path)), "id": rows["id"][path], "score": pd.array(marks, "Float64"), "at_s": ends - rows["seconds"][path], "end_s": ends, "stop": why, "search": "beam" if beam else "greedy"}
        return pd.DataFrame(out)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    kind = ready.schema["id"].dataType.simpleString()
    return ready.groupBy(*group).applyInPandas(build, f"{keys}, step long, id {kind}, score double, at_s double, end_s double, stop string, search string")


def rejected(pool: DataFrame, chains: DataFrame, group: list[str]) -> DataFrame:
    """``*group, id, reason`` of the rows of a pool that no chain took.

    Too short, too long, without a tempo, or left over: because the set was full, or because no
    transition to them was open. A row that is only one of an exhausted pool has no reason to be left.
    """
    seconds = F.col("duration_s").cast("double")
    length = F.when((seconds > 0) & (seconds < float("inf")), seconds).otherwise(300.0)
    ends = chains.groupBy(*group).agg(F.max("stop").alias("__stop"))
    left = pool.join(chains.select(*group, "id"), [*group, "id"], "left_anti").join(ends, group, "left")
    usable = F.coalesce((F.col("bpm") > 0) & (F.col("bpm") < float("inf")), F.lit(False))
    reason = F.when(length < SHORTEST, "too short").when(length > LONGEST, "too long").when(F.col("__stop") == "budget", "set is full").when(~usable, "no tempo").otherwise("no open transition")
    return left.select(*group, "id", reason.alias("reason"))


def _fields(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in sc.FIELDS}


def _with_features(chains: DataFrame, pool: DataFrame, group: list[str]) -> DataFrame:
    return chains.join(sc.mixable(pool).select(*group, "id", F.struct(*sc.FIELDS).alias("f")), [*group, "id"])


def explain(chains: DataFrame, pool: DataFrame, group: list[str], preset: str, minutes: float) -> DataFrame:
    """``chains`` (group, step, id) with clock, score, evidence and type of every step, anew from the pool.

    The opener's tempo is the anchor. ``out_bar`` and ``in_bar``, if the pool has them, are the cue
    bars of the types. An opener, or a step behind a closed gate, has no score and no evidence.
    """
    bars = [F.col(c).cast("int").alias(c) if c in pool.columns else F.lit(None).cast("int").alias(c) for c in ("out_bar", "in_bar")]
    rows = _with_features(chains.select(*group, "step", "id"), pool, group).join(pool.select(*group, "id", *bars), [*group, "id"])
    order = Window.partitionBy(*group).orderBy("step")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"end_s": F.sum("f.seconds").over(upto), "__prev": F.lag("f").over(order), "__out": F.lag("out_bar").over(order), "__anchor": F.first("f.bpm").over(upto)})
    rows = rows.withColumn("at_s", F.col("end_s") - F.col("f.seconds"))
    t = F.least(F.lit(1.0), F.col("at_s") / (minutes * 60))
    rows = rows.withColumn("evidence", F.when(F.col("__prev").isNotNull(), sc.evidence(_fields("__prev."), _fields("f."), preset, t, F.col("__anchor"))))
    known = lambda p: F.when(F.col(f"{p}.felt"), F.col(f"{p}.arousal"))
    kind = sc.transition_type(F.col("evidence").isNotNull(), F.coalesce("evidence.half_time", F.lit(False)), F.col("__out"), F.col("in_bar"), known("__prev"), known("f"))
    return rows.select(*group, "step", "id", "at_s", "end_s", F.col("evidence.total").alias("score"), kind.alias("type"), "evidence")


def typed_coverage(explained: DataFrame, group: list[str]) -> DataFrame:
    """``*group, typed, total, ratio``: transitions with a type other than hold; an opener counts for none."""
    moves = F.count_if(F.col("step") > 0)
    typed = F.count_if((F.col("step") > 0) & (F.col("type") != "hold"))
    return explained.groupBy(*group).agg(typed.alias("typed"), moves.alias("total"), F.when(moves == 0, 1.0).otherwise(typed / moves).alias("ratio"))


def insert_landmarks(chains: DataFrame, pool: DataFrame, pins: DataFrame, group: list[str], preset: str, minutes: float) -> tuple[DataFrame, DataFrame]:
    """Chains with pinned items put in, and what became of every pin.

    ``pins``: group, id, turn (0, 1, ...: the order in which a group asks for them). A pin goes
    between the first two steps where both new transitions are open at their places of the set;
    chains never lose a step. All groups go at once, one pin a group and turn, so there are as many
    rounds as the longest list of pins, which its users write. Gives chains (group, step, id, score)
    and pins (group, id, outcome: chosen, inserted, no place, not in the pool). Pins asked for twice
    count once.
    """
    ready = materialise(sc.mixable(pool).filter(F.col("seconds").between(SHORTEST, LONGEST)).select(*group, "id", F.struct(*sc.FIELDS).alias("f")))
    asked = pins.groupBy(*group, "id").agg(F.min("turn").alias("turn"))
    done = chains.join(ready, [*group, "id"]).select(*group, "step", "id", "score", "f")
    here = asked.join(chains.select(*group, "id").withColumn("__in", F.lit(True)), [*group, "id"], "left").join(ready.withColumnRenamed("f", "__p"), [*group, "id"], "left")
    turn = F.row_number().over(Window.partitionBy(*group).orderBy("turn", "id"))
    wanted = materialise(here.filter("__in IS NULL AND __p IS NOT NULL").withColumn("turn", turn).select(*group, F.col("id").alias("__id"), "__p", "turn"))
    order = Window.partitionBy(*group).orderBy("step")
    budget, rounds, placed = minutes * 60, wanted.agg(F.max("turn")).first()[0] or 0, None
    clock = lambda s: F.least(F.lit(1.0), s / budget)
    for r in range(1, rounds + 1):
        spent = F.sum("f.seconds").over(order.rowsBetween(Window.unboundedPreceding, 0))
        gaps = done.select(*group, "step", "f", F.lead("f").over(order).alias("__next"), spent.alias("__s"), F.first("f.bpm").over(order).alias("__anchor"))
        tried = gaps.filter("__next IS NOT NULL").join(wanted.filter(F.col("turn") == r).drop("turn"), group)
        tried = tried.withColumns({"__in": sc.transition(_fields("f."), _fields("__p."), preset, clock(F.col("__s")), F.col("__anchor")), "__out": sc.transition(_fields("__p."), _fields("__next."), preset, clock(F.col("__s") + F.col("__p.seconds")), F.col("__anchor"))})
        taken = tried.filter("__in > 0 AND __out > 0").groupBy(*group).agg(F.min(F.struct("step", "__id", "__in", "__out")).alias("x")).select(*group, F.col("x.step").alias("__at"), F.col("x.__id").alias("__id"), F.col("x.__in").alias("__in"), F.col("x.__out").alias("__out"))
        taken = materialise(taken.join(wanted.select(*group, "__id", "__p"), [*group, "__id"]))
        placed = taken.select(*group, "__id") if placed is None else placed.unionByName(taken.select(*group, "__id"))
        moved = done.join(taken.select(*group, "__at", "__out"), group, "left")
        step, after = F.col("step"), F.col("step") - F.col("__at")
        moved = moved.select(*group, F.when(after > 0, step + 1).otherwise(step).alias("step"), "id", F.when(after == 1, F.col("__out")).otherwise(F.col("score")).alias("score"), "f")
        done = materialise(moved.unionByName(taken.select(*group, (F.col("__at") + 1).alias("step"), F.col("__id").alias("id"), F.col("__in").alias("score"), F.col("__p").alias("f"))))
    if placed is None:
        placed = wanted.select(*group, "__id").limit(0)
    fate = here.join(placed.withColumnRenamed("__id", "id").withColumn("__new", F.lit(True)), [*group, "id"], "left")
    outcome = F.when(F.col("__in"), "chosen").when(F.col("__new"), "inserted").when(F.col("__p").isNull(), "not in the pool").otherwise("no place")
    return done.drop("f"), fate.select(*group, "id", outcome.alias("outcome"))


def swap_steps(chains: DataFrame, swaps: DataFrame, group: list[str]) -> DataFrame:
    """Chains with items replaced in place. ``swaps``: group, id, by. One that names an absent item, or puts in a present one, does nothing."""
    steps = chains.select(*group, "step", "id")
    fresh = swaps.join(steps.select(*group, F.col("id").alias("by")), [*group, "by"], "left_anti").groupBy(*group, "id").agg(F.min("by").alias("by"))
    once = fresh.groupBy(*group, "by").agg(F.min("id").alias("id"))
    return steps.join(once, [*group, "id"], "left").select(*group, "step", F.coalesce("by", "id").alias("id"))


def regenerate(chains: DataFrame, pool: DataFrame, kept: DataFrame, group: list[str], preset: str, minutes: float, search: str | None = "greedy", seed: int = 0) -> DataFrame:
    """Build the chains anew around steps that stay. ``kept``: group, id; items that are in no chain are ignored.

    Kept items stand at their step again; the rest is free, and may come out the same. A chain that
    ends before a kept step, or fills its time, ends there, so ``minutes`` should cover the chain.
    """
    slots = chains.join(kept.select(*group, "id").distinct(), [*group, "id"], "left_semi").select(*group, "id", F.col("step").alias("slot"))
    return build_chains(pool.drop("slot").join(slots, [*group, "id"], "left"), group, preset, minutes, search, seed)


def summary(chains: DataFrame, group: list[str], minutes: float) -> DataFrame:
    """``*group, steps, actual_minutes, shortfall_minutes, complete, avg_transition, min_transition, stop``."""
    places = lambda c, k: F.floor(c * 10**k + 0.5) / 10**k
    real = places(F.max("end_s") / 60, 1)
    short = places(F.greatest(F.lit(0.0), minutes - real), 1)
    return chains.groupBy(*group).agg(F.count("*").alias("steps"), real.alias("actual_minutes"), short.alias("shortfall_minutes"), (short == 0).alias("complete"), places(F.avg(places(F.col("score"), 3)), 3).alias("avg_transition"), F.min(places(F.col("score"), 3)).alias("min_transition"), F.max("stop").alias("stop"))


def cohorts(pool: DataFrame, families: dict[str, list[str]], minutes: float, exclusive: bool = False, within: list[str] | None = None) -> DataFrame:
    """Chains of ``*within, cohort, arm`` (warmup and peak) for every family, from :func:`build_chains`.

    A row belongs to the families of which its genre holds a term; one without a genre to none. The
    arms of a family draw on the same rows; with ``exclusive`` the warm-ups come first, and no item
    is used twice, by the same family or another: families take turns in the order given.
    """
    genre = F.lower("family")
    names = F.array(*[F.when(F.coalesce(F.greatest(*[genre.contains(t) for t in terms], F.lit(False)), F.lit(False)), name) for name, terms in families.items()])
    members = pool.select("*", F.explode(F.array_compact(names)).alias("__family")).drop("preset", "arm")
    rows = members.withColumn("arm", F.explode(F.array(F.lit("warmup"), F.lit("peak")))).withColumn("preset", F.col("arm"))
    key = [*(within or []), "cohort", "arm"]
    if not exclusive:
        return build_chains(rows.withColumnRenamed("__family", "cohort"), key, minutes=minutes)
    made, used = None, None
    for name in families:
        for arm in ("warmup", "peak"):
            free = rows.filter((F.col("__family") == name) & (F.col("arm") == arm))
            free = free if used is None else free.join(used, "id", "left_anti")
            one = materialise(build_chains(free.withColumnRenamed("__family", "cohort"), key, minutes=minutes))
            made = one if made is None else made.unionByName(one)
            used = one.select("id") if used is None else used.unionByName(one.select("id"))
    return made


def variants(pool: DataFrame, group: list[str], preset: str, minutes: float, n: int) -> DataFrame:
    """Up to 8 chains a group, of seeds 0 to n - 1: other openers, and the other search for odd seeds."""
    seeds = F.sequence(F.lit(0), F.lit(max(1, min(8, n)) - 1))
    return build_chains(pool.drop("seed").withColumn("seed", F.explode(seeds)), [*group, "seed"], preset, minutes)


# What each part of the scorecard counts.
PARTS = {"transition": 0.3, "floor": 0.15, "arc": 0.2, "diversity": 0.15, "budget": 0.1, "landmark": 0.1}


def scorecard(chains: DataFrame, pool: DataFrame, group: list[str], preset: str, minutes: float, fates: DataFrame | None = None) -> DataFrame:
    """``*group``, six parts and their weighted ``total``, each from 0 to 100 with one decimal.

    ``chains``: group, step, id, score, end_s. Parts: mean and least transition; 1 - RMSE / 4 of the
    arousal to the preset's line over the clock; neighbours of one artist, half of all pairs being
    0; the share of the ``minutes`` filled; the pins of ``fates`` (group, outcome) that were placed.
    A chain of one step has full transitions and diversity; without arousal the arc is 50.
    """
    artists = pool.select(*pool.columns) if "artist" in pool.columns else pool.withColumn("artist", F.lit(None).cast("string"))
    rows = chains.join(artists.select(*[g for g in group if g in pool.columns], "id", "arousal", sc.artist_key(F.col("artist")).alias("__who")), [*[g for g in group if g in pool.columns], "id"])
    order, whole = Window.partitionBy(*group).orderBy("step"), Window.partitionBy(*group)
    places = lambda c, k: F.floor(c * 10**k + 0.5) / 10**k
    minute = places(F.col("end_s") / 60, 1)
    start, end = sc.PRESETS[preset]["arousal"]
    rows = rows.withColumns({"__m": minute, "__all": F.max(minute).over(whole)})
    meant = start + F.col("__m") / F.col("__all") * (end - start)
    rows = rows.withColumns({"__move": places(F.col("score"), 3), "__off": F.pow(F.col("arousal") - meant, 2), "__same": ((F.lag("__who").over(order) == F.col("__who")) & (F.col("__who") != "")).cast("int")})
    part = lambda x, empty: F.when(x.isNull(), empty).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), places(100 * x, 1))))
    n = F.count("*")
    out = rows.groupBy(*group).agg(
        part(F.avg("__move"), 100.0).alias("transition"),
        part(F.min("__move"), 100.0).alias("floor"),
        part(1 - F.sqrt(F.avg("__off")) / 4, 50.0).alias("arc"),
        part(1 - 2 * F.sum(F.coalesce("__same", F.lit(0))) / F.when(n > 1, n - 1), 100.0).alias("diversity"),
        F.when(F.max("__m") >= minutes, 100.0).otherwise(part(F.max("__m") / minutes, 100.0)).alias("budget"),
    )
    if fates is not None:
        pins = fates.groupBy(*group).agg((F.count_if(F.col("outcome").isin("chosen", "inserted")) / F.count("*")).alias("__placed"))
        out = out.join(pins, group, "left")
    else:
        out = out.withColumn("__placed", F.lit(None).cast("double"))
    out = out.withColumn("landmark", part(F.col("__placed"), 100.0))
    total = sum((w * F.col(c) for c, w in PARTS.items()), F.lit(0.0))
    return out.select(*group, *PARTS, places(total, 1).alias("total"))
