"""Queries of upserts by rule, verification logs, nested search, gates and watched progress, over stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.operators import labels as lb
from marlstone.operators import relational as rel
from marlstone.operators import runlogs as rl
from marlstone.plans.catalog import register, table
from marlstone.streaming import events as ev

R4 = "floor(({}) * 10000 + 0.5) / 10000"


@register("upsert_relabel", """
WITH t AS (SELECT s_suppkey AS id, s_suppkey % 50 AS position, s_name AS title, 'liked' AS source FROM supplier WHERE s_suppkey % 3 <> 0), c AS (SELECT s_suppkey AS id, s_suppkey % 7 AS position, CASE WHEN s_suppkey % 4 <> 0 THEN upper(s_name) END AS title, 'set:' || s_nationkey AS source, s_suppkey % 5 = 0 AS relabel FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(c.id, t.id) AS id, CASE WHEN c.id IS NULL THEN t.position ELSE c.position END AS position, coalesce(c.title, t.title) AS title, CASE WHEN t.id IS NULL OR c.relabel THEN c.source ELSE t.source END AS source FROM t FULL JOIN c ON t.id = c.id""")
def upsert_relabel(spark, sf):
    """A new position always counts, a title only fills, the source stays unless the change says relabel."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    target = s.filter(k % 3 != 0).select(k.alias("id"), (k % 50).alias("position"), F.col("s_name").alias("title"), F.lit("liked").alias("source"))
    changes = s.filter(k % 2 == 0).select(k.alias("id"), (k % 7).alias("position"), F.when(k % 4 != 0, F.upper("s_name")).alias("title"), F.concat(F.lit("set:"), F.col("s_nationkey").cast("string")).alias("source"), (k % 5 == 0).alias("relabel"))
    return rel.upsert_by_rule(target, changes, ["id"], {"position": "replace", "title": "fill", "source": "keep"}, {"source": F.col("relabel")})


@register("upsert_two_keys", """
WITH t AS (SELECT l_orderkey AS playlist, l_linenumber AS place, l_partkey AS item FROM lineitem WHERE l_orderkey % 3 <> 0), c AS (SELECT l_orderkey AS playlist, l_linenumber AS place, l_suppkey AS item FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT coalesce(c.playlist, t.playlist) AS playlist, coalesce(c.place, t.place) AS place, coalesce(c.item, t.item) AS item FROM t FULL JOIN c ON t.playlist = c.playlist AND t.place = c.place""")
def upsert_two_keys(spark, sf):
    li = table(spark, sf, "lineitem")
    row = lambda x, c: x.select(F.col("l_orderkey").alias("playlist"), F.col("l_linenumber").alias("place"), F.col(c).alias("item"))
    return rel.upsert_by_rule(row(li.filter("l_orderkey % 3 <> 0"), "l_partkey"), row(li.filter("l_linenumber % 2 = 0"), "l_suppkey"), ["playlist", "place"], {"item": "replace"})


@register("upsert_evidence", f"""
WITH e AS (SELECT l_partkey AS track, l_returnflag AS source, l_linestatus AS rung, l_suppkey % 5 AS genre, max(l_quantity) AS weight, min(l_comment) AS detail FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 'q' || l_linenumber END AS l_comment FROM lineitem) GROUP BY ALL), t AS (SELECT * FROM e WHERE track % 3 <> 0), c AS (SELECT track, source, rung, genre, weight / 2 AS weight, upper(detail) AS detail FROM e WHERE genre <> 2)
SELECT coalesce(c.track, t.track) AS track, coalesce(c.source, t.source) AS source, coalesce(c.rung, t.rung) AS rung, coalesce(c.genre, t.genre) AS genre, {R4.format('CASE WHEN c.track IS NULL THEN t.weight ELSE c.weight END')} AS weight, coalesce(c.detail, t.detail) AS detail
FROM t FULL JOIN c ON t.track = c.track AND t.source = c.source AND t.rung = c.rung AND t.genre = c.genre""")
def upsert_evidence(spark, sf):
    """Evidence has a natural key of four columns; a weight replaces, a detail fills."""
    keys = ["track", "source", "rung", "genre"]
    li = table(spark, sf, "lineitem").withColumn("d", F.when(F.col("l_quantity") > 25, F.concat(F.lit("q"), F.col("l_linenumber").cast("string"))))
    e = li.groupBy(F.col("l_partkey").alias("track"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("rung"), (F.col("l_suppkey") % 5).alias("genre")).agg(F.max("l_quantity").alias("weight"), F.min("d").alias("detail"))
    changes = e.filter("genre <> 2").select(*keys, (F.col("weight") / 2).alias("weight"), F.upper("detail").alias("detail"))
    out = rel.upsert_by_rule(e.filter("track % 3 <> 0"), changes, keys, {"weight": "replace", "detail": "fill"})
    return out.withColumn("weight", round_up(F.col("weight"), 4))


_JSON = "'VERIFY_JSON: {\"drives\": {\"A\": {\"tracks\": ' || s_suppkey || ', \"missing_files\": [\"a' || s_suppkey || '\"]}, \"B\": {\"tracks\": ' || s_nationkey || ', \"missing_files\": [], \"no_bpm\": [\"x\"]}}, \"anlz_total\": 9}'"
_LOG = f"l AS (SELECT s_suppkey AS k, s_nationkey AS nk, 'scan' || chr(10) || '  tracks: ' || s_suppkey * 2 || chr(10) || 'playlists: ' || s_nationkey || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ' dangling: 3' END || chr(10) || 'missing audio: 5' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '=== cross-drive ===' || chr(10) || 'ANLZ full hash parity: 2/' || s_suppkey || ' mismatches' || chr(10) ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN {_JSON} WHEN s_suppkey % 7 = 0 THEN left({_JSON}, 40) ELSE '' END AS log FROM supplier)"


@register("verify_metrics", f"""
WITH {_LOG} SELECT k AS run_id, k % 3 = 0 AS structured, CASE WHEN k % 3 = 0 THEN k + nk ELSE k * 2 END AS tracks, CASE WHEN k % 3 = 0 THEN NULL ELSE nk END::BIGINT AS playlists, CASE WHEN k % 3 = 0 THEN NULL ELSE coalesce(TRY_CAST(regexp_extract(log, 'dangling: (\\d+)', 1) AS BIGINT), 0) END AS dangling, CASE WHEN k % 3 = 0 THEN 1 ELSE 5 END::BIGINT AS missing_audio, 0::BIGINT AS no_bpm,
  CASE WHEN k % 3 = 0 THEN false ELSE k % 2 = 0 END AS cross_drive, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 2 = 0 THEN 2 END::BIGINT AS parity_bad, CASE WHEN k % 3 = 0 THEN 9 WHEN k % 2 = 0 THEN k END::BIGINT AS parity_total FROM l""")
def verify_metrics(spark, sf):
    """Logs with a sound structured line, with one that is cut off, and with none."""
    k, nk = F.col("s_suppkey"), F.col("s_nationkey")
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    line = text('VERIFY_JSON: {"drives": {"A": {"tracks": ', k, ', "missing_files": ["a', k, '"]}, "B": {"tracks": ', nk, ', "missing_files": [], "no_bpm": ["x"]}}, "anlz_total": 9}')
    cross = F.when(k % 2 == 0, text("=== cross-drive ===\nANLZ full hash parity: 2/", k, " mismatches\n")).otherwise("")
    tail = F.when(k % 3 == 0, line).when(k % 7 == 0, F.substring(line, 1, 40)).otherwise("")
    log = text("scan\n  tracks: ", k * 2, "\nplaylists: ", nk, F.when(k % 4 == 0, "").otherwise(" dangling: 3"), "\nmissing audio: 5\n", cross, tail)
    out = rl.verify_metrics(table(spark, sf, "supplier").select(k.alias("run_id"), log.alias("log")))
    return out.select("run_id", "structured", "tracks", "playlists", "dangling", "missing_audio", "no_bpm", "cross_drive", "parity_bad", "parity_total")


@register("snapshot_search", """
WITH d AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS nickname, c_custkey % 2 = 0 AS mounted FROM customer),
p AS (SELECT d.id, count(*) AS n, list('playlist:' || o_orderstatus || '-auto' || o_orderkey || ':' || o_orderkey % 100 ORDER BY o_orderkey) AS ms FROM d JOIN orders ON o_custkey = d.id AND o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT d.*, CASE WHEN d.id % 11 = 0 THEN 0 ELSE coalesce(a.n, 0) END AS tracks, list_concat(CASE WHEN contains(lower(coalesce(nickname, '')), 'auto') THEN ['drive:' || coalesce(nickname, name) || ':' || CASE WHEN d.id % 11 = 0 THEN 0 ELSE coalesce(a.n, 0) END] ELSE [] END, CASE WHEN d.id % 11 = 0 THEN [] ELSE coalesce(p.ms, []) END) AS ms FROM d LEFT JOIN p ON p.id = d.id LEFT JOIN a ON a.id = d.id)
SELECT id AS drive_id, coalesce(nickname, name) AS drive_name, mounted, array_to_string(ms[1:10], ',') AS matches FROM m WHERE len(ms) > 0""")
def snapshot_search(spark, sf):
    """Customers as drives, their orders as playlists of a nested snapshot, some of them broken."""
    o = table(spark, sf, "orders")
    name = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "-Auto").otherwise("-x"), F.col("o_orderkey").cast("string"))
    lists = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o_orderkey", name.alias("name"), (F.col("o_orderkey") % 100).alias("entries")))).alias("l"))
    snap = F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("track_count"), F.transform(F.coalesce("l", F.array().cast("array<struct<o_orderkey:bigint,name:string,entries:bigint>>")), lambda x: F.struct(x["name"].alias("name"), x["entries"].alias("entries"))).alias("playlists")))
    c = F.col("c_custkey")
    drives = table(spark, sf, "customer").select(c.alias("id"), F.col("c_name").alias("name"), F.when(c % 3 == 0, F.col("c_mktsegment")).alias("nickname"), (c % 2 == 0).alias("mounted")).join(lists, "id", "left")
    found = rl.search_snapshots(drives.withColumn("snapshot", F.when(F.col("id") % 11 == 0, F.lit("{broken")).otherwise(snap)), "auto")
    label = lambda m: F.concat_ws(":", m["type"], F.when(m["type"] == "playlist", F.replace(m["name"], F.lit("-Auto"), F.lit("-auto"))).otherwise(m["name"]), m["entries"].cast("string"))
    return found.select("drive_id", "drive_name", "mounted", F.array_join(F.transform("matches", label), ",").alias("matches"))


@register("label_gate", f"""
WITH r AS (SELECT least(greatest((l_quantity - 0.5) / 50, 1e-6), 1 - 1e-6)::DOUBLE AS p, (l_linenumber * 7 + l_quantity::INT) % 60 < l_quantity AS k FROM lineitem), t AS (SELECT i / 20.0 AS t, sum(ln(1 + exp(CASE WHEN k THEN -ln(p / (1 - p)) ELSE ln(p / (1 - p)) END / (i / 20.0)))) / count(*) AS loss FROM r, range(2, 101) x(i) GROUP BY 1),
b AS (SELECT t::DOUBLE AS t FROM t ORDER BY floor(loss * 1e9), t LIMIT 1), s AS (SELECT k, pow(p / (1 - p), 1 / t) / (1 + pow(p / (1 - p), 1 / t)) AS s, t FROM r, b), g AS (SELECT tau, max(t) AS t, count(*) AS n, count(*) FILTER (s >= tau) AS above, count(*) FILTER (s >= tau AND k) AS hit FROM s, (SELECT unnest([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3])::DOUBLE AS tau) GROUP BY 1)
SELECT max(t) AS temperature, coalesce(min(tau) FILTER (above > 0 AND hit >= 0.7::DOUBLE * above), 0.95::DOUBLE) AS tau, {R4.format('coalesce(min_by(hit / above, tau) FILTER (above > 0 AND hit >= 0.7::DOUBLE * above), 0)')} AS precision, {R4.format('coalesce(min_by(above / n, tau) FILTER (above > 0 AND hit >= 0.7::DOUBLE * above), 0)')} AS coverage, max(n) AS n FROM g""")
def label_gate(spark, sf):
    """Temperature and threshold of line items taken as labels with a confidence."""
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(((q - 0.5) / 50).alias("p"), ((F.col("l_linenumber") * 7 + q.cast("int")) % 60 < q).alias("k"))
    rule = lb.gate(rows, F.col("p"), F.col("k"), 0.7)
    return rule.withColumns({c: round_up(F.col(c), 4) for c in ("precision", "coverage")})


@register("stream_watch")
def stream_watch(spark, sf):
    """Users' events as reports of work worth 500: thinned to one in six hours, stalled after two days, over budget after thirty."""
    stream = ev.event_stream(spark, f"{sf}/events.parquet").select("user_id", "ts", "value")
    day = 86400.0
    out = ev.watch(stream, "user_id", "value", 500.0, every=day / 4, stall=2 * day, budget=30 * day, late="1 hour")
    return ev.run_once(out, f"s{uuid.uuid4().hex}", "append").withColumns({"progress": round_up(F.col("progress"), 4), "seconds_left": round_up(F.col("seconds_left"), 1)})
