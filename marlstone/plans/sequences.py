"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.operators import sequence as sq
from marlstone.plans.catalog import register, table

R4 = "floor(({}) * 10000 + 0.5) / 10000"
BY = ["ts", "event_id"]


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@register("play_transitions", """
SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER w AS b, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap > 0 AND gap <= 21600000000 AND a <> b GROUP BY 1, 2""")
def play_transitions(spark, sf):
    return sq.transitions(table(spark, sf, "events"), "user_id", BY, "event_type", _micros(), 6 * 3600e6)


@register("sessionize", """
SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""")
def sessionize(spark, sf):
    return sq.sessions(table(spark, sf, "events"), "user_id", BY, _micros(), 6 * 3600e6).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@register("moving_mean", f"SELECT event_id, {R4.format('m')} AS mean FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4")
def moving_mean(spark, sf):
    return sq.moving_mean(table(spark, sf, "events"), "user_id", BY, "value", 4).select("event_id", round_up(F.col("mean"), 4).alias("mean"))


@register("run_length_sections", """
WITH a AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM a) SELECT user_id, island, any_value(event_type) AS event_type, min(pos) AS start, count(*) AS length FROM b GROUP BY 1, 2""")
def run_length_sections(spark, sf):
    return sq.islands(table(spark, sf, "events"), "user_id", BY, "event_type")


@register("canonical_arc", "SELECT user_id, bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase') AND bool_or(event_type = 'error') AS whole FROM events GROUP BY 1")
def canonical_arc(spark, sf):
    has = lambda t: F.bool_or(F.col("event_type") == t)
    return table(spark, sf, "events").groupBy("user_id").agg((has("signup") & has("purchase") & has("error")).alias("whole"))


@register("section_means", f"""
WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM a) SELECT user_id, island, {R4.format('coalesce(avg(value), 0)')} AS mean FROM b GROUP BY 1, 2""")
def section_means(spark, sf):
    from pyspark.sql import Window

    events = table(spark, sf, "events")
    runs = sq.islands(events, "user_id", BY, "event_type").withColumn("pos", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1))).select("user_id", "island", "pos")
    placed = events.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(*BY)) - 1)
    return placed.join(runs, ["user_id", "pos"]).groupBy("user_id", "island").agg(round_up(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean"))


@register("tempo_fit", f"""
SELECT user_id, count(*) AS n, {R4.format('regr_slope(t, i)')} AS step, {R4.format('sqrt(greatest(regr_syy(t, i) * (1 - regr_r2(t, i)) / count(*), 0))')} AS residual FROM (SELECT user_id, epoch_us(ts) / 3600000000.0 - 473000 AS t, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS i FROM events) GROUP BY 1 HAVING count(*) >= 4""")
def tempo_fit(spark, sf):
    hours = table(spark, sf, "events").withColumn("t", _micros() / 3.6e9 - 473000)
    return sq.tempo_fit(hours, "user_id", BY, "t").select("user_id", "n", round_up(F.col("step"), 4).alias("step"), round_up(F.col("residual"), 4).alias("residual"))


@register("grid_audit", """
SELECT user_id, CASE WHEN abs(step - 10.0) > 2 THEN 'TEMPO' WHEN residual > 24 THEN 'CHAOS' WHEN residual > 8 THEN 'DRIFT' ELSE 'A-OK' END AS bucket FROM (
SELECT user_id, regr_slope(t, i) AS step, sqrt(greatest(regr_syy(t, i) * (1 - regr_r2(t, i)) / count(*), 0)) AS residual FROM (SELECT user_id, epoch_us(ts) / 3600000000.0 - 473000 AS t, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS i FROM events) GROUP BY 1 HAVING count(*) >= 4)""")
def grid_audit(spark, sf):
    fits = sq.tempo_fit(table(spark, sf, "events").withColumn("t", _micros() / 3.6e9 - 473000), "user_id", BY, "t")
    bucket = F.when(F.abs(F.col("step") - 10.0) > 2, "TEMPO").when(F.col("residual") > 24, "CHAOS").when(F.col("residual") > 8, "DRIFT").otherwise("A-OK")
    return fits.select("user_id", bucket.alias("bucket"))


@register("drop_energy", f"""
WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
m AS (SELECT user_id, pos, avg(value) OVER w AS m, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
b AS (SELECT user_id, pos AS start, m AS peak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, pos) AS r FROM m WHERE n = 16) WHERE r = 1)
SELECT user_id, start, {R4.format('peak')} AS peak, {R4.format('peak - coalesce(avg(value) FILTER (pos < start OR pos > start + 15), 0)')} AS contrast FROM p JOIN b USING (user_id) GROUP BY user_id, start, peak""")
def drop_energy(spark, sf):
    out = sq.full_frame_peak(table(spark, sf, "events"), "user_id", BY, "value", 16)
    return out.select("user_id", "start", round_up(F.col("peak"), 4).alias("peak"), round_up(F.col("contrast"), 4).alias("contrast"))


@register("drop_windows", f"""
WITH x AS (SELECT user_id, event_id, ts, epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS gap, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) AS v, 1 - (gap - min(gap) OVER p) / (max(gap) OVER p - min(gap) OVER p) AS g FROM x WHERE gap IS NOT NULL WINDOW p AS (PARTITION BY user_id)),
z AS (SELECT event_id, avg(v) OVER w * 0.6 + avg(g) OVER w * 0.4 AS s, count(*) OVER w AS n FROM y WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT event_id, {R4.format('s')} AS score FROM z WHERE n = 8""")
def drop_windows(spark, sf):
    from pyspark.sql import Window

    w, p = Window.partitionBy("user_id").orderBy(*BY), Window.partitionBy("user_id")
    gaps = table(spark, sf, "events").withColumn("s", _micros() / 1e6).withColumn("gap", F.lead("s").over(w) - F.col("s")).filter("gap is not null")
    scaled = lambda c: (F.col(c) - F.min(c).over(p)) / (F.max(c).over(p) - F.min(c).over(p))
    both = gaps.withColumns({"v": scaled("value"), "g": 1 - scaled("gap")}).withColumn("x", F.col("v") * 0.6 + F.col("g") * 0.4)
    return sq.moving_mean(both, "user_id", BY, "x", 8).select("event_id", round_up(F.col("mean"), 4).alias("score"))


@register("drop_candidates_nms")
def drop_candidates_nms(spark, sf):
    return sq.spaced_peaks(table(spark, sf, "events"), "user_id", BY, "value", 3, 8)


@register("phrase_search")
def phrase_search(spark, sf):
    from pyspark.sql import Window

    from marlstone.functions.scalar import cosine

    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("grp"), v.alias("v"))
    rows = rows.withColumn("drop", 1 - cosine(F.lag("v").over(Window.partitionBy("grp").orderBy("vec_id")), F.col("v")))
    return sq.novelty_phrases(rows, "grp", ["vec_id"], F.col("drop"), 0.9, 4)


@register("arc_shape", """
WITH a AS (SELECT user_id, ts, event_id, value / 100 AS v, value / 100 - lag(value / 100) OVER w AS step, ntile(4) OVER w AS q FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN step > 0.05 THEN 1 WHEN step < -0.05 THEN -1 END AS dir FROM a),
e AS (SELECT *, last_value(dir IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d),
f AS (SELECT user_id, count(*) FILTER (dir <> prev) AS inflections, avg(v) FILTER (q = 1) q1, avg(v) FILTER (q = 2) q2, avg(v) FILTER (q = 3) q3, avg(v) FILTER (q = 4) q4 FROM e GROUP BY 1)
SELECT user_id, inflections, CASE WHEN inflections >= 4 THEN 'rollercoaster' WHEN q4 - q1 > 0.2 THEN 'buildup' WHEN q4 - q1 < -0.2 THEN 'drop' WHEN (q2 + q3) / 2 < q1 - 0.1 AND (q2 + q3) / 2 < q4 - 0.1 THEN 'valley' ELSE 'plateau' END AS shape FROM f""")
def arc_shape(spark, sf):
    rows = table(spark, sf, "events").filter("event_type = 'signup'").withColumn("v", F.col("value") / 100)
    return sq.arc(rows, "user_id", BY, "v")


@register("phrase_cues", """
SELECT event_id, pos, pos % 32 = 0 AS major FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pos % 8 = 0 AND pos + 8 <= n""")
def phrase_cues(spark, sf):
    return sq.every_nth(table(spark, sf, "events"), "user_id", BY, 8).select("event_id", "pos", "major")


@register("mode_length", """
SELECT user_id, length FROM (SELECT user_id, length, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, length) AS r FROM (SELECT user_id, CAST(floor(value / 25) AS BIGINT) AS length FROM events) GROUP BY 1, 2) WHERE r = 1""")
def mode_length(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", F.floor(F.col("value") / 25).alias("length")).agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("length"))


@register("zone_flags", """
SELECT user_id, coalesce(bool_or(value > 120) FILTER (pos < 8 OR pos >= n - 8), false) AS edge, coalesce(bool_or(value > 120) FILTER (pos >= 8 AND pos < n - 8), false) AS body FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1""")
def zone_flags(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "events").withColumns({"pos": F.row_number().over(Window.partitionBy("user_id").orderBy(*BY)) - 1, "n": F.count("*").over(Window.partitionBy("user_id"))})
    edge = (F.col("pos") < 8) | (F.col("pos") >= F.col("n") - 8)
    loud = F.col("value") > 120
    return rows.groupBy("user_id").agg(F.bool_or(edge & loud).alias("edge"), F.bool_or(~edge & loud).alias("body"))
