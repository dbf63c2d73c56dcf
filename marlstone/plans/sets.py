"""Queries of transition scores, set building, match scores, gates and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up, token_ratio, tokens
from marlstone.operators import chains as ch
from marlstone.operators import health as hl
from marlstone.operators import scoring as sc
from marlstone.plans.catalog import register, table
from marlstone.session import materialise

R4 = "floor(({}) * 10000 + 0.5) / 10000"
# The same lane, key and gates as in operators.scoring, written out in SQL.
_POOL = """pool AS (SELECT p_partkey AS id, p_partkey // 1200 * 8 + p_size % 8 AS grp, (CASE WHEN p_partkey % 6 = 0 THEN (100 + p_partkey % 40) / 2.0::DOUBLE ELSE 100 + p_partkey % 40 END)::DOUBLE AS bpm, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_partkey % 12 + 1 END AS hour, (p_partkey // 12) % 2 AS mode,
  (CASE WHEN p_partkey % 19 = 0 THEN 5 ELSE 1 + p_size % 9 END)::DOUBLE AS arousal, p_partkey % 19 <> 0 AS felt, (p_partkey % 10)::DOUBLE / 10 AS dance, p_brand AS artist, p_partkey % 3 <> 2 AND p_partkey % 23 <> 0 AS half, embedding::DOUBLE[] AS emb,
  CASE WHEN p_partkey % 5 <> 0 THEN 1 + p_partkey % 40 END AS out_bar, CASE WHEN p_partkey % 7 <> 0 THEN 1 + p_partkey % 9 END AS in_bar FROM part LEFT JOIN embeddings ON vec_id = p_partkey)"""
_STEP = "least(abs(a.hour - b.hour), 12 - abs(a.hour - b.hour))"
_KEY = f"CASE WHEN a.hour = 0 OR b.hour = 0 THEN 0.5 WHEN {_STEP} = 0 OR ({_STEP} = 1 AND a.mode = b.mode) THEN 1.0 WHEN {_STEP} = 1 THEN 0.9 ELSE 0.0 END"
_D = "(abs(a.bpm - b.bpm) / greatest(a.bpm, b.bpm))"
_TEMPO = f"CASE WHEN {_D} <= 0.02::DOUBLE THEN 1.0 WHEN {_D} >= 0.06::DOUBLE THEN 0.0 ELSE 1 - ({_D} - 0.02::DOUBLE) / (0.06::DOUBLE - 0.02::DOUBLE) END"
_HALF_PAIR = "(abs(b.bpm / (a.bpm * 2) - 1) <= 0.06::DOUBLE OR abs(b.bpm / (a.bpm * 0.5::DOUBLE) - 1) <= 0.06::DOUBLE OR abs(b.bpm / (a.bpm * 1.5::DOUBLE) - 1) <= 0.06::DOUBLE OR abs(b.bpm / (a.bpm * (2::DOUBLE / 3)) - 1) <= 0.06::DOUBLE)"
_JOIN = f"pool a JOIN pool b ON a.grp = b.grp AND a.id < b.id AND ({_D} < 0.06::DOUBLE OR {_HALF_PAIR})"
_ALL = "pool a JOIN pool b ON a.grp = b.grp AND a.id < b.id"
# A set at a quarter of its way from 6 to 8.5, anchored at 125: peak's arousal 6.625, dance 0.7625, tempo 1.005.
_TERMS = f"""
t AS (SELECT a.id AS a, b.id AS b, {_TEMPO} = 0 AND {_HALF_PAIR} AND a.half AND b.half AS half, {_TEMPO} AS direct, ({_KEY})::DOUBLE AS k, a.artist = b.artist AS same,
    1 - least(1, (abs(b.arousal / 9 - (6 + (8.5::DOUBLE - 6) * 0.25::DOUBLE) / 9) + abs(b.dance - (0.7::DOUBLE + (0.95::DOUBLE - 0.7::DOUBLE) * 0.25::DOUBLE))) / 2) AS fit,
    1 - least(1, abs(b.bpm / (125 * (1 + (1.02::DOUBLE - 1) * 0.25::DOUBLE)) - 1) / ((0.06::DOUBLE - 0.02::DOUBLE) / 2)) AS pull,
    coalesce((list_dot_product(a.emb, b.emb) / (sqrt(list_dot_product(a.emb, a.emb)) * sqrt(list_dot_product(b.emb, b.emb))) + 1) / 2, 0) AS sim,
    (abs(b.bpm / 125 - 1) <= 0.12::DOUBLE OR abs(b.bpm / 250 - 1) <= 0.06::DOUBLE OR abs(b.bpm / 62.5::DOUBLE - 1) <= 0.06::DOUBLE OR abs(b.bpm / (125 * 1.5::DOUBLE) - 1) <= 0.06::DOUBLE OR abs(b.bpm / (125 * (2::DOUBLE / 3)) - 1) <= 0.06::DOUBLE)
      AND NOT (a.felt AND b.felt AND b.arousal - a.arousal < -0.6::DOUBLE) AS near, a.out_bar, b.in_bar, CASE WHEN a.felt THEN a.arousal ELSE 0 END AS was, CASE WHEN b.felt THEN b.arousal ELSE 0 END AS now FROM {_JOIN}),
u AS (SELECT *, CASE WHEN half THEN 0.675::DOUBLE ELSE direct END AS lane FROM t),
v AS (SELECT *, near AND lane > 0 AND k > 0 AS open, 0.45::DOUBLE * lane + 0.3::DOUBLE * k + 0.25::DOUBLE * fit + 0.15::DOUBLE * pull + 0.1::DOUBLE * sim AS raw FROM u),
w AS (SELECT *, CASE WHEN NOT open THEN -1 WHEN same THEN greatest(0.01::DOUBLE, raw - 2) ELSE raw END AS score FROM v)"""


def features(part, embeddings, group):
    """Items to build sets of: every row of part, its vector by number, and gaps in every field."""
    k = F.col("p_partkey")
    gap = lambda n, c: F.when(k % n != 0, c)
    rows = part.join(embeddings.select(F.col("vec_id").alias("p_partkey"), "embedding"), "p_partkey", "left")
    return rows.select(
        k.alias("id"), group.alias("grp"), F.when(k % 6 == 0, (100 + k % 40) / 2).otherwise(100 + k % 40).cast("double").alias("bpm"), gap(17, (k % 12 + 1).cast("int")).alias("hour"), (F.floor(k / 12) % 2).cast("int").alias("mode"),
        gap(19, (1 + F.col("p_size") % 9).cast("double")).alias("arousal"), (k % 10 / 10.0).alias("dance"), F.col("p_brand").alias("artist"),
        gap(23, F.element_at(F.array(F.lit("Techno"), F.lit("house"), F.lit("pop")), (k % 3 + 1).cast("int"))).alias("family"),
        F.when(k % 31 == 0, 30.0).when(k % 37 == 0, 1200.0).otherwise(gap(29, (120 + k % 300).cast("double"))).alias("duration_s"), "embedding",
        gap(5, (1 + k % 40).cast("int")).alias("out_bar"), gap(7, (1 + k % 9).cast("int")).alias("in_bar"),
    )


def sessions(spark, sf):
    """All of part. A session is a key range of 1,200 and a size class, so sessions stay bounded as part grows; one per brand would leave each a single artist."""
    return features(table(spark, sf, "part"), table(spark, sf, "embeddings"), F.floor(F.col("p_partkey") / 1200) * 8 + F.col("p_size") % 8)


def _lane_pairs(spark, sf):
    pool = sc.mixable(sessions(spark, sf))
    pairs = sc.lane_pairs(pool, "grp")
    return pairs, *({c: F.col(f"{s}.{c}") for c in [*sc.FIELDS, "out_bar", "in_bar"]} for s in "ab")


def _key_pairs(spark, sf):
    """Keys have no range to join on: all pairs of a bounded session."""
    pool = sc.mixable(sessions(spark, sf))
    a, b = (pool.select("grp", F.struct("id", "hour", "mode").alias(s)) for s in "ab")
    return a.join(b, "grp").filter("a.id < b.id")


@register("tempo_score", f"WITH {_POOL} SELECT a.id AS a, b.id AS b, {R4.format(_TEMPO)} AS score, {_HALF_PAIR} AS half FROM {_JOIN}")
def tempo_score(spark, sf):
    """Pairs whose tempos share a lane; every other pair has neither a score nor a half-time lane."""
    pairs, a, b = _lane_pairs(spark, sf)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), round_up(sc.tempo_score(a["bpm"], b["bpm"]), 4).alias("score"), sc.half_time_pair(a["bpm"], b["bpm"]).alias("half"))


@register("key_compat", f"WITH {_POOL} SELECT a.id AS a, b.id AS b, ({_KEY})::DOUBLE AS score FROM {_ALL}")
def key_compat(spark, sf):
    return _key_pairs(spark, sf).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), sc.key_compat(F.col("a.hour"), F.col("a.mode"), F.col("b.hour"), F.col("b.mode")).alias("score"))


@register("mirex", f"WITH {_POOL} SELECT a.id AS a, b.id AS b, (CASE WHEN a.hour = 0 OR b.hour = 0 THEN 0.0 WHEN {_STEP} = 0 AND a.mode = b.mode THEN 1.0 WHEN {_STEP} = 1 AND a.mode = b.mode THEN 0.5 WHEN {_STEP} = 0 THEN 0.3 WHEN {_STEP} = 3 AND a.mode <> b.mode THEN 0.2 ELSE 0.0 END)::DOUBLE AS score FROM {_ALL}")
def mirex(spark, sf):
    return _key_pairs(spark, sf).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), sc.mirex(F.col("a.hour"), F.col("a.mode"), F.col("b.hour"), F.col("b.mode")).alias("score"))


@register("transition_score", f"WITH {_POOL}, {_TERMS} SELECT a, b, {R4.format('score')} AS score FROM w")
def transition_score(spark, sf):
    pairs, a, b = _lane_pairs(spark, sf)
    score = sc.transition(a, b, "peak", F.lit(0.25), F.lit(125.0))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), round_up(score, 4).alias("score"))


@register("transition_evidence", f"""
WITH {_POOL}, {_TERMS} SELECT a, b, {R4.format('0.45::DOUBLE * lane')} AS tempo, {R4.format('0.3::DOUBLE * k')} AS key, {R4.format('0.25::DOUBLE * fit')} AS arc_fit, {R4.format('0.15::DOUBLE * pull')} AS anchor, {R4.format('0.1::DOUBLE * sim')} AS similarity,
  CASE WHEN same THEN 3 ELSE 0 END AS penalty, half AS half_time, {R4.format('score')} AS total FROM w WHERE open""")
def transition_evidence(spark, sf):
    pairs, a, b = _lane_pairs(spark, sf)
    rows = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), sc.evidence(a, b, "peak", F.lit(0.25), F.lit(125.0)).alias("e")).filter("e IS NOT NULL")
    return rows.select("a", "b", *[round_up(F.col(f"e.{c}"), 4).alias(c) for c in [*sc.WEIGHTS, "total"]], "e.penalty", "e.half_time")


@register("transition_types", f"""
WITH {_POOL}, {_TERMS} SELECT CASE WHEN NOT open THEN 'hold' WHEN half THEN 'half-time-shift' WHEN out_bar IS NOT NULL AND in_bar IS NOT NULL THEN CASE WHEN now >= 6 AND in_bar <= 4 THEN 'drop-entry' WHEN abs(now - was) >= 1.5 THEN 'energy-swap' WHEN abs(out_bar - in_bar) >= 16 THEN 'long-blend' ELSE 'phrase-cut' END
  WHEN abs(now - was) >= 1.5 THEN 'energy-swap' ELSE 'hold' END AS type, count(*) AS n FROM w GROUP BY 1""")
def transition_types(spark, sf):
    pairs, a, b = _lane_pairs(spark, sf)
    found = sc.terms(a, b, sc.PRESETS["peak"], F.lit(0.25), F.lit(125.0), F.lit(0.0))
    felt = lambda x: F.when(x["felt"], x["arousal"])
    kind = sc.transition_type(found["open"], found["half_time"], a["out_bar"], b["in_bar"], felt(a), felt(b))
    return pairs.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def _rounded(chains):
    return chains.withColumns({"score": round_up(F.col("score"), 4), "at_s": round_up(F.col("at_s"), 3), "end_s": round_up(F.col("end_s"), 3)})


@register("set_greedy")
def set_greedy(spark, sf):
    return _rounded(ch.build_chains(sessions(spark, sf), ["grp"], "peak", 60, "greedy"))


@register("set_beam")
def set_beam(spark, sf):
    return _rounded(ch.build_chains(sessions(spark, sf), ["grp"], "warmup", 60, "beam"))


@register("set_rejected")
def set_rejected(spark, sf):
    """Why the rows that no greedy chain took stay out."""
    pool = sessions(spark, sf)
    return ch.rejected(pool, materialise(ch.build_chains(pool, ["grp"], "peak", 60, "greedy")), ["grp"])


@register("set_explained")
def set_explained(spark, sf):
    """Clock, score and type of each step of the greedy chains, from the columns rather than the search."""
    pool = sessions(spark, sf)
    chains = materialise(ch.build_chains(pool, ["grp"], "peak", 60, "greedy"))
    return _rounded(ch.explain(chains, pool, ["grp"], "peak", 60).drop("evidence"))


@register("set_landmarks")
def set_landmarks(spark, sf):
    """Every session asks for its items numbered 0 and 40 of each 113; what became of these pins."""
    pool = sessions(spark, sf)
    chains = materialise(ch.build_chains(pool, ["grp"], "peak", 60, "greedy"))
    pins = pool.filter("id % 113 IN (0, 40)").select("grp", "id", (F.col("id") % 113).alias("turn"))
    return ch.insert_landmarks(chains, pool, pins, ["grp"], "peak", 60)[1]


@register("set_regenerated")
def set_regenerated(spark, sf):
    """The greedy chains anew with every third step kept and another opener's seed."""
    pool = sessions(spark, sf)
    chains = materialise(ch.build_chains(pool, ["grp"], "peak", 60, "greedy"))
    return _rounded(ch.regenerate(chains, pool, chains.filter("step % 3 = 2"), ["grp"], "peak", 60, seed=1))


FAMILIES = {"techno": ["techno"], "house": ["house"], "pop": ["pop"]}


@register("set_cohorts")
def set_cohorts(spark, sf):
    """Warm-up and peak sets of each family in each key range."""
    pool = features(table(spark, sf, "part"), table(spark, sf, "embeddings"), F.floor(F.col("p_partkey") / 1200))
    return ch.summary(ch.cohorts(pool, FAMILIES, 60, within=["grp"]), ["grp", "cohort", "arm"], 60)


@register("set_variants")
def set_variants(spark, sf):
    """Four chains a session with their scorecards; the best is the one to propose."""
    pool = sessions(spark, sf)
    made = materialise(ch.variants(pool, ["grp"], "peak", 60, 4))
    return ch.scorecard(made, pool, ["grp", "seed"], "peak", 60)


@register("set_quality")
def set_quality(spark, sf):
    pool = sessions(spark, sf)
    return ch.scorecard(ch.build_chains(pool, ["grp"], "peak", 60, "greedy"), pool, ["grp"], "peak", 60)


@register("match_score", f"""
WITH q AS (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '')) AS t, p_size FROM part), c AS (SELECT p_partkey AS cid, p_brand AS cb, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '')) AS ct, p_size AS cs FROM part),
s AS (SELECT p_partkey, cid, 6 + 4 * (len(list_intersect(t, ct)) / greatest(len(t), len(ct))) + CASE WHEN abs(p_size - cs) <= 2 THEN 3 WHEN abs(p_size - cs) <= 5 THEN 2 ELSE 0 END AS score FROM q JOIN c ON p_brand = cb AND p_partkey <> cid)
SELECT p_partkey, cid AS best, {R4.format('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY floor(score * 1e6 + 0.5) DESC, cid) AS r FROM s) WHERE r = 1 AND score >= 8""")
def match_score(spark, sf):
    """Candidates share the artist (a gate that is also the join key); the best at the floor or above wins.

    Equal (artist, tokens, size) score alike, so classes meet instead of rows. The two least keys of
    a class are enough, as a query is barred from one row only: itself.
    """
    from pyspark.sql import Window

    def first(df, n, keys, *order):
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("r") <= n).drop("r")

    part = table(spark, sf, "part").select("p_partkey", "p_brand", tokens(F.col("p_name")).alias("t"), "p_size").filter("p_partkey IS NOT NULL").distinct()
    q = part.filter("t IS NOT NULL")
    # A candidate without a name has no tokens, a query without one no score.
    c = first(part.select(F.col("p_partkey").alias("best"), "p_brand", F.coalesce("t", F.array().cast("array<string>")).alias("ct"), F.col("p_size").alias("cs")), 2, ["p_brand", "ct", "cs"], "best")
    gap = F.abs(F.col("p_size") - F.col("cs"))
    # Two names without a token score 0 / 0: NaN, which goes before all numbers, whatever the sizes.
    blank = F.explode(F.when(F.size("ct") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    sized = q.select("p_brand", "p_size").distinct().join(c, "p_brand").withColumn("blank", blank).withColumn("points", F.when(F.col("blank"), float("nan")).when(gap <= 2, 3.0).when(gap <= 5, 2.0).otherwise(0.0))
    near = first(sized, 2, ["p_brand", "p_size", "ct", "blank"], F.desc("points"), "best").withColumnsRenamed({"p_brand": "cb", "p_size": "qs"})
    met = q.select("p_brand", "t", "p_size").distinct().join(near, (F.col("p_brand") == F.col("cb")) & F.col("p_size").eqNullSafe(F.col("qs"))).filter(F.col("blank") == ((F.size("t") == 0) & (F.size("ct") == 0)))
    scored = met.select("p_brand", "t", "p_size", "best", (6 + 4 * token_ratio(F.col("t"), F.col("ct")) + F.col("points")).alias("s"))
    order = F.isnan("s").desc(), F.floor(F.col("s") * 1e6 + 0.5).desc(), "best"
    top = first(scored, 2, ["p_brand", "t", "p_size"], *order).select(F.col("p_brand").alias("cb"), F.col("t").alias("qt"), F.col("p_size").alias("qs"), "best", "s")
    mine = q.join(top, (F.col("p_brand") == F.col("cb")) & F.col("t").eqNullSafe(F.col("qt")) & F.col("p_size").eqNullSafe(F.col("qs"))).filter("p_partkey <> best")
    return first(mine, 1, ["p_partkey"], *order).filter("s >= 8").select("p_partkey", "best", F.when(F.isnan("s"), F.col("s")).otherwise(round_up(F.col("s"), 4)).alias("score"))


@register("tolerance_gate", f"SELECT l_returnflag, count(*) AS n, {R4.format('avg((l_linenumber % 4 <> 0 AND abs(l_quantity + l_linenumber % 3 - 1 - l_quantity) <= 0.5)::INT)')} AS within FROM lineitem GROUP BY 1")
def tolerance_gate(spark, sf):
    """Share of outputs within a tolerance, a missing one being a miss; outputs that are all the same fail the gate."""
    rows = table(spark, sf, "lineitem").withColumn("out", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") + F.col("l_linenumber") % 3 - 1))
    hit = F.coalesce((F.abs(F.col("out") - F.col("l_quantity")) <= 0.5).cast("int"), F.lit(0))
    out = rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(hit).alias("w"), F.countDistinct("out").alias("kinds"))
    sound = F.when((F.col("kinds") == 1) & (F.col("n") >= 2), F.raise_error(F.lit("all outputs are the same"))).otherwise(F.col("w"))
    return out.select("l_returnflag", "n", round_up(sound, 4).alias("within"))


@register("key_agreement", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN least(abs(a - b), 12 - abs(a - b)) = 0 THEN 'match' WHEN least(abs(a - b), 12 - abs(a - b)) = 1 THEN 'near' ELSE 'mismatch' END AS band FROM (SELECT p_partkey % 12 AS a, p_size % 12 AS b FROM part)) GROUP BY 1")
def key_agreement(spark, sf):
    off = F.abs(F.col("p_partkey") % 12 - F.col("p_size") % 12)
    d = F.least(off, 12 - off)
    return table(spark, sf, "part").groupBy(F.when(d == 0, "match").when(d == 1, "near").otherwise("mismatch").alias("band")).agg(F.count("*").alias("n"))


@register("quality_score", "SELECT p_partkey, (CASE WHEN p_type = 'STANDARD' THEN 1000000000 ELSE 0 END + p_size * 1000 + p_partkey % 600)::BIGINT AS score, floor((least(greatest(-25 + p_size / 3.0, -25), -8) + 25) / 17 * 9 + 1 + 0.5)::BIGINT AS energy FROM part")
def quality_score(spark, sf):
    loud = F.least(F.greatest(-25 + F.col("p_size") / 3.0, F.lit(-25)), F.lit(-8))
    return table(spark, sf, "part").select("p_partkey", (F.when(F.col("p_type") == "STANDARD", 1000000000).otherwise(0) + F.col("p_size") * 1000 + F.col("p_partkey") % 600).cast("long").alias("score"), F.floor((loud + 25) / 17 * 9 + 1 + 0.5).cast("long").alias("energy"))


_HEALTH = "h AS (SELECT s_nationkey, CASE WHEN s_acctbal < 500 THEN 'fail' WHEN s_acctbal < 2000 THEN 'warn' ELSE 'pass' END AS status FROM supplier)"


@register("health_rollup", f"WITH {_HEALTH} SELECT s_nationkey, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS overall, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail FROM h GROUP BY 1")
def health_rollup(spark, sf):
    b = F.col("s_acctbal")
    return hl.rollup(table(spark, sf, "supplier").withColumn("status", hl.status(b, b < 2000, b < 500)), ["s_nationkey"], "status")


@register("verify_deltas", """
WITH n AS (SELECT s_suppkey, s_acctbal > 3000 AS ok FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey, s_acctbal > 4000 AS ok FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT s_suppkey, CASE WHEN b.ok IS NULL THEN 'new' WHEN n.ok IS NULL THEN 'gone' WHEN n.ok <> b.ok THEN 'changed' ELSE 'same' END AS delta FROM n FULL JOIN b USING (s_suppkey)""")
def verify_deltas(spark, sf):
    s = table(spark, sf, "supplier")
    return hl.deltas(s.filter("s_suppkey % 5 <> 0").withColumn("ok", F.col("s_acctbal") > 3000), s.filter("s_suppkey % 7 <> 0").withColumn("ok", F.col("s_acctbal") > 4000), "s_suppkey", "ok")


@register("speed_regression", "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b > 0 AND value < (1 - 0.4) * b")
def speed_regression(spark, sf):
    return hl.regressions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id")


@register("port_view", "SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal > 5000) DESC, s_suppkey DESC) AS r FROM supplier) WHERE r = 1")
def port_view(spark, sf):
    from marlstone.operators.relational import latest_by

    return latest_by(table(spark, sf, "supplier"), ["s_nationkey"], [(F.col("s_acctbal") > 5000).desc(), F.desc("s_suppkey")]).select("s_nationkey", "s_suppkey")


@register("gold_metrics", f"SELECT l_returnflag, {R4.format('avg((abs(l_tax - l_discount) <= 0.01 + 1e-9)::INT)')} AS within, {R4.format('avg((l_quantity % 8 <= 1)::INT)')} AS aligned FROM lineitem GROUP BY 1")
def gold_metrics(spark, sf):
    share = lambda c: round_up(F.avg(c.cast("int")), 4)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(share(F.abs(F.col("l_tax") - F.col("l_discount")) <= 0.01 + 1e-9).alias("within"), share(F.col("l_quantity") % 8 <= 1).alias("aligned"))
