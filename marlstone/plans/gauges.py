"""Queries of gates, run comparison, section matching, best-of-N votes, disputes, openers and digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.operators import chains as ch
from marlstone.operators import energy as en
from marlstone.operators import evalstats as es
from marlstone.operators import health as hl
from marlstone.operators import lifecycle as lc
from marlstone.operators import scoring as sc
from marlstone.operators import vectors as vc
from marlstone.plans.catalog import register, table
from marlstone.plans.sets import features

R3 = "floor(({}) * 1000 + 0.5) / 1000"
R4 = "floor(({}) * 10000 + 0.5) / 10000"
_BLOCS = {"rhythm": "p_partkey % 7", "brightness": "p_size", "body": "p_partkey % 11 + p_size", "activity": "p_size % 5", "perceptual": "p_size + p_partkey % 13"}
_TRACKS = "t AS (SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k, v in _BLOCS.items()) + ", p_size AS composite, p_size + p_partkey % 40 AS bpm, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 0 END AS high, p_size // 6 AS band, (p_size + p_partkey % 9) // 6 AS gained FROM part)"


def _rho(a, b):
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return f"(SELECT corr(x, y) FROM (SELECT {rank.format(a)} AS x, {rank.format(b)} AS y FROM t))"


def _tracks(spark, sf):
    kind = F.col("p_type")
    cols = {k: F.expr(v) for k, v in _BLOCS.items()}
    return table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in cols.items()], F.col("p_size").alias("composite"), (F.col("p_size") + F.col("p_partkey") % 40).alias("bpm"), F.when(kind == "ECONOMY", 1).when(kind == "STANDARD", 0).alias("high"), F.floor(F.col("p_size") / 6).alias("band"), F.floor((F.col("p_size") + F.col("p_partkey") % 9) / 6).alias("gained"))


_MEANT = "(rhythm + brightness + body + activity)"
_VARS = "[" + ", ".join(f"var_samp({b})" for b in _BLOCS) + "]"


@register("gates_collected", f"""
WITH {_TRACKS}, g AS (SELECT 'bloc-dominance' AS name, {R3.format('list_max(v) / list_sum(v)')} AS value, list_max(v) / list_sum(v) <= 0.4 AS pass FROM (SELECT {_VARS} AS v FROM t)
UNION ALL SELECT 'not-bpm', v, v < 0.5 FROM (SELECT {R3.format('abs(' + _rho('composite', 'bpm') + ')')} AS v) UNION ALL SELECT 'tier-agreement', v, v >= 0.4 FROM (SELECT {R3.format(_rho(_MEANT, 'perceptual'))} AS v)
UNION ALL SELECT 'genre-direction', d, d > 0.5 FROM (SELECT {R3.format('(m1 - m0) / sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2))')} AS d FROM (SELECT avg(composite) FILTER (high = 1) AS m1, avg(composite) FILTER (high = 0) AS m0, var_samp(composite) FILTER (high = 1) AS s1, var_samp(composite) FILTER (high = 0) AS s0, count(*) FILTER (high = 1) AS n1, count(*) FILTER (high = 0) AS n0 FROM t))
UNION ALL SELECT 'gain-invariance', s, s >= 0.95 FROM (SELECT {R3.format('avg((abs(band - gained) <= 1)::INT)')} AS s FROM t) UNION ALL SELECT 'duplicate-consistency', NULL, true)
SELECT name, pass, value, (SELECT count(*) FROM g WHERE pass) AS passed, 6::BIGINT AS total, (SELECT bool_and(pass) FROM g) AS all_pass FROM g""")
def gates_collected(spark, sf):
    t = _tracks(spark, sf)
    return en.collect_gates([
        en.gate_dominance(t, list(_BLOCS)), en.gate_not_tempo(t, "composite", "bpm"), en.gate_tiers(t, [b for b in _BLOCS if b != "perceptual"], "perceptual"), en.gate_direction(t, F.col("high"), "composite"),
        en.gate_bands(t, "gain-invariance", "band", "gained"), en.gate_bands(t.filter("band < 0"), "duplicate-consistency", "band", "gained", empty=True)])


_CURVE = "SELECT i / 20.0::DOUBLE AS threshold, coalesce((SELECT avg({k}::INT) FROM orders WHERE {c} * 20 // 100 >= i), 0) AS acc FROM range(21) r(i)"
_RUNS = (("(o_orderkey * 7 % 100)", "(o_orderkey % 3 <> 0)"), ("(o_orderkey * 13 % 90)", "(o_orderkey % 4 <> 0)"))


@register("run_compare", f"""
WITH x AS ({_CURVE.format(c=_RUNS[0][0], k=_RUNS[0][1])}), y AS ({_CURVE.format(c=_RUNS[1][0], k=_RUNS[1][1])}), w AS (SELECT avg({_RUNS[1][1]}::INT) - avg({_RUNS[0][1]}::INT) AS d, count(*) FILTER ({_RUNS[0][1]} AND NOT {_RUNS[1][1]}) AS b, count(*) FILTER (NOT {_RUNS[0][1]} AND {_RUNS[1][1]}) AS c FROM orders)
SELECT threshold, {R4.format('y.acc - x.acc')} AS delta, {R4.format('d')} AS accuracy_delta, b, c, {R4.format('greatest(abs(b - c) - 1, 0) ** 2 / (b + c)')} AS chi2 FROM x JOIN y USING (threshold), w""")
def run_compare(spark, sf):
    orders = table(spark, sf, "orders")
    a, b = (orders.select("o_orderkey", (F.expr(c) / 100).alias("conf"), F.expr(k).alias("ok")) for c, k in _RUNS)
    out = es.run_compare(a, b, "o_orderkey", "conf", "ok")
    return out.select("threshold", *[round_up(F.col(c), 4).alias(c) for c in ("delta", "accuracy_delta", "chi2")], "b", "c")


@register("section_match")
def section_match(spark, sf):
    """Sections of an order are its lines: quantities as predicted starts, part sizes as true ones."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    predicted = lines.filter("l_linenumber < 7").select("l_orderkey", F.col("l_quantity").cast("long").alias("start"), F.when(F.col("l_returnflag") == "A", "chorus").otherwise("up").alias("label"))
    truth = lines.filter("l_linenumber > 1").select("l_orderkey", F.col("p_size").cast("long").alias("start"), F.when(F.col("l_linestatus") == "F", "Drop").otherwise("buildup").alias("label"))
    return es.section_match(predicted, truth, "l_orderkey", 3)


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_TOP = "p AS (SELECT *, row_number() OVER (PARTITION BY query, place ORDER BY s DESC, n) AS r FROM (SELECT q.vec_id AS query, q.place, s.vec_id AS n, s.label AS l, floor(list_cosine_similarity(q.v, s.v) * 1e6 + 0.5) / 1e6 AS s FROM q JOIN s ON true)), c AS (SELECT query, place, l, count(*) AS n FROM p WHERE r <= 7 GROUP BY 1, 2, 3), t AS (SELECT query, place, l AS predicted, n * 1.0 / sum(n) OVER (PARTITION BY query, place) AS agreement, row_number() OVER (PARTITION BY query, place ORDER BY n DESC, l) AS r FROM c)"


@register("best_of_sections", f"WITH {_E}, q AS (SELECT vec_id, 0 AS place, v FROM e WHERE vec_id % 4 = 0 UNION ALL SELECT vec_id, 1, list_reverse(v) FROM e WHERE vec_id % 4 = 0), s AS (SELECT * FROM e WHERE vec_id % 4 <> 0), {_TOP}, b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY agreement DESC, place) AS k FROM t WHERE r = 1) SELECT query, predicted, {R4.format('agreement')} AS agreement, place::BIGINT AS place, agreement < 0.6 AS refused FROM b WHERE k = 1")
def best_of_sections(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 4 = 0")
    queries = asked.select("vec_id", "embedding", F.lit(0).alias("place")).unionByName(asked.select("vec_id", F.reverse("embedding").alias("embedding"), F.lit(1).alias("place")))
    out = vc.best_of(queries, e.filter("vec_id % 4 <> 0"), 7, "vec_id", "place", "label")
    return out.withColumns({"agreement": round_up(F.col("agreement"), 4), "place": F.col("place").cast("long")})


@register("dispute_review", f"WITH {_E}, q AS (SELECT vec_id, 0 AS place, v FROM e WHERE vec_id % 6 = 0), s AS (SELECT * FROM e WHERE vec_id % 6 <> 0), {_TOP}, w AS (SELECT query, predicted, agreement FROM t WHERE r = 1 AND agreement >= 0.6) SELECT e.vec_id AS query, e.label, (e.vec_id % 30)::BIGINT AS age_days, w.predicted AS consensus, {R4.format('w.agreement')} AS agreement, coalesce(e.label = w.predicted, false) AS agrees FROM e LEFT JOIN w ON w.query = e.vec_id WHERE e.vec_id % 6 = 0")
def dispute_review(spark, sf):
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    e = table(spark, sf, "embeddings").withColumns({"flag": F.when(F.col("vec_id") % 6 == 0, "disputed"), "at": F.timestamp_seconds(now.cast("long") - F.col("vec_id") % 30 * 86400)})
    return vc.disputes(e, 7, "vec_id", "label", "flag", "at", now).withColumn("agreement", round_up(F.col("agreement"), 4))


_OPEN = "p AS (SELECT p_partkey AS id, 100 + p_partkey % 40 AS bpm, p_size / 50.0 AS arousal FROM part), n AS (SELECT p.*, (SELECT count(*) FROM p o WHERE o.bpm > p.bpm * 0.94 AND o.bpm < p.bpm / 0.94) AS neighbours FROM p), r AS (SELECT *, row_number() OVER (ORDER BY floor(abs(arousal - 0.3) * 1e6 + 0.5), id) - 1 AS r, count(*) OVER () AS c FROM n WHERE neighbours >= 15)"


@register("set_opener", f"WITH {_OPEN} SELECT id, bpm::DOUBLE AS bpm, arousal::DOUBLE AS arousal, neighbours FROM r WHERE r = 7 % c")
def set_opener(spark, sf):
    pool = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (100 + F.col("p_partkey") % 40).cast("double").alias("bpm"), (F.col("p_size") / 50.0).alias("arousal"))
    return sc.opener(pool, 0.3, seed=7).select("id", "bpm", "arousal", "neighbours")


_CHAIN = "c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_id, event_type, CASE WHEN event_id % 9 <> 0 THEN value END AS score FROM events)"


def _chains(spark, sf):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select("user_id", step.alias("step"), F.col("event_id").alias("id"), "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("score"))


@register("chain_repeats", f"WITH {_CHAIN}, l AS (SELECT user_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS same FROM c) SELECT user_id, count(*) FILTER (same) AS repeats FROM l GROUP BY 1")
def chain_repeats(spark, sf):
    return lc.chain_repeats(_chains(spark, sf), "user_id", "event_type")


@register("chain_digest", f"WITH {_CHAIN} SELECT user_id, left(sha256(string_agg(event_id || ' ' || CASE WHEN score IS NULL THEN '-' ELSE printf('%.3f', floor(score * 1000 + 0.5) / 1000) END, chr(10) ORDER BY step)), 16) AS digest FROM c GROUP BY 1")
def chain_digest(spark, sf):
    return sc.chain_digest(_chains(spark, sf), "user_id")


_JOBS = "j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 11 <> 0 THEN 1000 + o_orderkey % 500 END AS started, CASE WHEN o_orderkey % 3 = 0 THEN 1000 + o_orderkey % 700 END AS touched, CASE WHEN o_orderkey % 4 = 0 THEN 1000 + o_orderkey % 600 END AS moved, o_orderkey % 5 = 0 AS held FROM orders)"


def _jobs(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.when(s == "F", "done").when(s == "O", "running").otherwise("queued").alias("status"), F.when(k % 11 != 0, 1000 + k % 500).alias("started"),
        F.when(k % 3 == 0, 1000 + k % 700).alias("touched"), F.when(k % 4 == 0, 1000 + k % 600).alias("moved"), (k % 5 == 0).alias("held"))


@register("phantom_jobs", f"WITH {_JOBS} SELECT id, 'completion never delivered' AS error FROM j WHERE status <> 'done' AND started < 1320 AND coalesce(touched, 0) < 1380 AND NOT held")
def phantom_jobs(spark, sf):
    return hl.phantoms(_jobs(spark, sf), F.lit(1500))


@register("stalled_jobs", f"WITH {_JOBS}, l AS (SELECT id, status, greatest(coalesce(moved, 0), coalesce(started, 0)) AS last FROM j) SELECT id, 1500 - last AS idle FROM l WHERE status = 'running' AND last > 0 AND last < 1200")
def stalled_jobs(spark, sf):
    return hl.stalled(_jobs(spark, sf), F.lit(1500).cast("long"), 5)


@register("feed_since", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events), k AS (SELECT *, max(b) OVER (PARTITION BY user_id) AS m FROM r WHERE b <= 50) SELECT user_id, event_id, (m - b + 1)::INT AS place, m::INT AS next FROM k WHERE m - b + 1 > 10 OR m < 10")
def feed_since(spark, sf):
    return hl.feed(table(spark, sf, "events").select("user_id", "event_id"), "user_id", ["event_id"], 10, 50)


@register("mount_events", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'mounted' WHEN s_suppkey % 7 = 0 THEN 'unmounted' ELSE 'relabelled' END AS kind FROM supplier WHERE (s_suppkey % 5 = 0) <> (s_suppkey % 7 = 0) OR (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0)")
def mount_events(spark, sf):
    s = table(spark, sf, "supplier")
    return hl.mount_events(s.filter("s_suppkey % 5 <> 0"), s.filter("s_suppkey % 7 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))), "s_suppkey", "s_name")


@register("set_by_size")
def set_by_size(spark, sf):
    """Sessions of a whole key range of part, some under and some over the size at which the search changes."""
    pool = features(table(spark, sf, "part"), table(spark, sf, "embeddings"), F.floor(F.col("p_partkey") / 1200) * 8 + F.least(F.col("p_size") % 16, F.lit(7)))
    return ch.build_chains(pool, ["grp"], "peak", 60).select("grp", "step", "id", round_up(F.col("score"), 4).alias("score"), "search")
