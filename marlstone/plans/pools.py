"""Queries of the candidate pool and of the intake cascade, over stand-ins made of part."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.operators import chains as ch
from marlstone.operators import intake as ik
from marlstone.operators import matching as mt
from marlstone.operators import pool as pl
from marlstone.operators import scoring as sc
from marlstone.plans.catalog import register, table

_PATH = "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 9 = 0 THEN '/home/u/Music/DJ-Imports/d/' || k || '.mp3' WHEN k % 11 = 0 THEN '/VOL/t/' || (k - 11) || '.mp3' ELSE '/vol/t/' || k || '.mp3' END"
_TITLE = "CASE WHEN k % 7 = 0 THEN p_brand || ' - ' || p_name WHEN k % 17 = 0 THEN NULL WHEN k % 4 = 0 THEN p_name || ' (Extended Mix)' WHEN k % 4 = 1 THEN upper(p_name) || '.mp3' WHEN k % 4 = 2 THEN p_name || ' [Free' ELSE p_name || ' ' || k // 40 END"
_ARTIST = "CASE WHEN k % 14 = 0 THEN 'Trap Nation' WHEN k % 7 = 0 THEN 'unknown' WHEN k % 3 = 0 THEN p_brand || ', Guest' ELSE upper(p_brand) END"
_SOURCES = f"""
p AS (SELECT p_partkey AS k, * FROM part),
tracks AS (SELECT k AS id, {_TITLE} AS title, {_ARTIST} AS artist, p_type AS genre, (60 + k % 400)::DOUBLE AS duration_s, {_PATH} AS path, CASE WHEN k % 13 = 0 THEN 'pending' ELSE 'downloaded' END AS status, make_timestamp((k * 7919 % 10007) * 60000000) AS updated_at FROM p),
beats AS (SELECT k AS id, (90 + k % 80)::DOUBLE AS bpm FROM p WHERE k % 3 <> 0),
mirror AS (SELECT k AS id, k * 2 + v AS content_id, (k % 2 + v) % 2 AS updated_at, CASE WHEN k % 22 = 0 THEN 'broken' ELSE '{{"BPM": ' || (9000 + k % 80 * 100) || ', "KeyName": "' || CASE WHEN k % 8 = 0 THEN ' ' ELSE (k + v) % 12 + 1 || 'A' END || '"}}' END AS metadata FROM p, (VALUES (0), (1)) x(v) WHERE k % 2 = 0),
keys AS (SELECT k AS id, {_PATH} AS path, CASE WHEN k % 8 = 0 THEN '' ELSE '4B' END AS key FROM p WHERE k % 4 = 0),
files AS (SELECT {_PATH} AS path FROM p WHERE k % 8 <> 1 AND k % 9 <> 0 UNION SELECT '/shelf/d/' || k || '.mp3' FROM p WHERE k % 18 = 0)"""
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '\\((?:original|extended|club|radio|album|single|vocal)\\s+(?:mix|edit|version)\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'), '\\[[^\\]]*$', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_TNORM = "trim(regexp_replace(" + _NORM + ", '\\b(?:original|extended|club|radio|album|single|vocal)\\s+(?:mix|edit|version)\\b|\\b(?:extended|club|radio|vocal)\\b', ' ', 'g'))"
_RAW = "regexp_replace(coalesce(title, ''), '\\.(?:mp3|wav|aiff|m4a|flac)$', '', 'i')"
_JUDGED = f"""{_SOURCES},
m AS (SELECT id, try_cast(CASE WHEN json_valid(metadata) THEN metadata ->> '$.BPM' END AS DOUBLE) / 100 AS mirror_bpm, nullif(trim(CASE WHEN json_valid(metadata) THEN metadata ->> '$.KeyName' END), '') AS mirror_key FROM mirror QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, content_id DESC) = 1),
b AS (SELECT t.*, CASE WHEN f.path IS NOT NULL THEN t.path WHEN g.path IS NOT NULL THEN g.path END AS file, f.path IS NULL AND g.path IS NOT NULL AS relocated FROM tracks t LEFT JOIN files f ON f.path = t.path LEFT JOIN files g ON g.path = '/shelf/' || nullif(regexp_extract(t.path, '^(?:.*/)?music/dj-imports/(.+)$', 1, 'i'), '') WHERE status = 'downloaded'),
n AS (SELECT b.*, coalesce(x.bpm, m.mirror_bpm) AS bpm, CASE WHEN x.bpm IS NOT NULL THEN 'beats' WHEN mirror_bpm IS NOT NULL THEN 'mirror' ELSE 'none' END AS bpm_from, CASE WHEN y.id IS NOT NULL THEN nullif(y.key, '') ELSE mirror_key END AS key,
  CASE WHEN y.id IS NOT NULL THEN 'ledger' WHEN mirror_key IS NOT NULL THEN 'mirror' WHEN file IS NOT NULL THEN 'unread' ELSE 'none' END AS key_from, file IS NULL AS metadata_only, file IS NOT NULL OR x.bpm IS NOT NULL OR mirror_bpm IS NOT NULL AS usable FROM b LEFT JOIN beats x USING (id) LEFT JOIN m USING (id) LEFT JOIN keys y ON y.id = b.id AND y.path = b.file),
k AS (SELECT *, {_RAW} AS raw, trim(split_part(coalesce(artist, ''), ',', 1)) AS head FROM n),
e AS (SELECT *, regexp_extract(raw, '^(.+?)\\s+-\\s+(.+)$', 1) AS named, regexp_extract(raw, '^(.+?)\\s+-\\s+(.+)$', 2) AS inn, {_NORM.format('head')} AS who FROM k),
h AS (SELECT *, CASE WHEN title IS NULL OR trim(title) = '' THEN NULL WHEN named <> '' AND (who IN ('unknown', 'unknownartist') OR lower(head) IN ('trap city', 'trap nation', 'chill nation')) THEN {_NORM.format('named')} || '|' || {_TNORM.format('inn')} ELSE who || '|' || {_TNORM.format('raw')} END AS name FROM e),
q AS (SELECT *, usable AND (file IS NULL OR row_number() OVER (PARTITION BY usable, lower(file) ORDER BY metadata_only, updated_at DESC, id) = 1) AS single FROM h),
j AS (SELECT *, CASE WHEN NOT usable THEN 'no file' WHEN NOT single THEN 'same path' WHEN name IS NOT NULL AND row_number() OVER (PARTITION BY single, name ORDER BY metadata_only, updated_at DESC, id) > 1 THEN 'same title' ELSE 'kept' END AS outcome FROM q)"""


def _sources(spark, sf):
    k, brand, name = F.col("p_partkey"), F.col("p_brand"), F.col("p_name")
    num = lambda c: c.cast("string")
    part = table(spark, sf, "part")
    path = F.when(k % 5 == 0, None).when(k % 9 == 0, F.concat(F.lit("/home/u/Music/DJ-Imports/d/"), num(k), F.lit(".mp3"))).when(k % 11 == 0, F.concat(F.lit("/VOL/t/"), num(k - 11), F.lit(".mp3"))).otherwise(F.concat(F.lit("/vol/t/"), num(k), F.lit(".mp3")))
    title = F.when(k % 7 == 0, F.concat(brand, F.lit(" - "), name)).when(k % 17 == 0, None).when(k % 4 == 0, F.concat(name, F.lit(" (Extended Mix)"))).when(k % 4 == 1, F.concat(F.upper(name), F.lit(".mp3"))).when(k % 4 == 2, F.concat(name, F.lit(" [Free"))).otherwise(F.concat(name, F.lit(" "), num(F.floor(k / 40))))
    artist = F.when(k % 14 == 0, "Trap Nation").when(k % 7 == 0, "unknown").when(k % 3 == 0, F.concat(brand, F.lit(", Guest"))).otherwise(F.upper(brand))
    status = F.when(k % 13 == 0, "pending").otherwise("downloaded")
    tracks = part.select(k.alias("id"), title.alias("title"), artist.alias("artist"), F.col("p_type").alias("genre"), (60 + k % 400).cast("double").alias("duration_s"), path.alias("path"), status.alias("status"), F.timestamp_micros(k * 7919 % 10007 * 60000000).alias("updated_at"))
    beats = part.filter(k % 3 != 0).select(k.alias("id"), (90 + k % 80).cast("double").alias("bpm"))
    mood = part.filter(k % 6 != 0).select(k.alias("id"), F.lit(5.0).alias("valence"), (1 + F.col("p_size") % 9).cast("double").alias("arousal"), F.lit(0.5).alias("dance"))
    v = F.col("v")
    json = F.concat(F.lit('{"BPM": '), num(9000 + k % 80 * 100), F.lit(', "KeyName": "'), F.when(k % 8 == 0, " ").otherwise(F.concat(num((k + v) % 12 + 1), F.lit("A"))), F.lit('"}'))
    mirror = part.filter(k % 2 == 0).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select(k.alias("id"), (k * 2 + v).alias("content_id"), ((k % 2 + v) % 2).alias("updated_at"), F.when(k % 22 == 0, "broken").otherwise(json).alias("metadata"))
    keys = part.filter(k % 4 == 0).select(k.alias("id"), path.alias("path"), F.when(k % 8 == 0, "").otherwise("4B").alias("key"))
    files = part.filter((k % 8 != 1) & (k % 9 != 0)).select(path.alias("path")).unionByName(part.filter(k % 18 == 0).select(F.concat(F.lit("/shelf/d/"), num(k), F.lit(".mp3")).alias("path")))
    return {"tracks": tracks, "beats": beats, "mood": mood, "mirror": mirror, "keys": keys, "files": files}


@register("candidate_pool", f"WITH {_JUDGED} SELECT id, file, relocated, metadata_only, bpm, bpm_from, key, key_from, name FROM j WHERE outcome = 'kept'")
def candidate_pool(spark, sf):
    kept = pl.candidates(pl.judge(**_sources(spark, sf), root="/shelf"))
    name = F.when(F.trim(F.col("title")) != "", pl.title_key(F.col("artist"), F.col("title")))
    return kept.select("id", "file", "relocated", "metadata_only", "bpm", "bpm_from", "key", "key_from", name.alias("name"))


@register("pool_census", f"""
WITH {_JUDGED} SELECT count(*) AS source_total, count(*) FILTER (outcome = 'kept') AS total, count(*) FILTER (outcome IN ('same path', 'same title')) AS duplicates, count(*) FILTER (outcome = 'no file') AS unusable, count(*) FILTER (metadata_only) AS missing_files,
  count(*) FILTER (metadata_only AND outcome <> 'no file') AS metadata_only, count(*) FILTER (outcome = 'kept' AND relocated) AS relocated_files, count(*) FILTER (outcome = 'kept' AND key_from = 'mirror') AS mirror_keys, count(*) FILTER (outcome = 'kept' AND bpm_from = 'mirror') AS mirror_bpms, count(*) FILTER (outcome = 'kept' AND key_from = 'unread') AS keys_to_read FROM j""")
def pool_census(spark, sf):
    return pl.census(pl.judge(**_sources(spark, sf), root="/shelf"))


_RECORDS = """r AS (SELECT p_partkey AS id, '/in/' || CASE WHEN p_partkey % 11 = 0 THEN 'twin ' || p_partkey // 22 ELSE p_name || ' ' || p_partkey // 3 END || CASE WHEN p_partkey % 2 = 0 THEN '.mp3' ELSE '.wav' END AS file, CASE WHEN p_partkey % 97 <> 0 THEN lower(p_brand) || '|' || p_name || p_partkey % 9 END AS identity,
  1000 + p_partkey % 40 AS size, md5((p_partkey // 160)::VARCHAR) AS md5, CASE WHEN p_partkey % 31 <> 0 THEN (p_size * 10 + p_partkey % 7)::DOUBLE END AS score, CASE WHEN p_partkey % 5 <> 0 THEN 'f' || p_partkey % 150 END AS fp FROM part),
arc AS (SELECT p_partkey AS id, lower(p_brand) || '|' || p_name || p_partkey % 9 AS identity, CASE WHEN p_partkey % 6 = 0 THEN '/in/' || p_name || ' ' || p_partkey // 3 || '.mp3' WHEN p_partkey % 15 <> 0 THEN '/arc/' || p_partkey END AS file, (p_size * 12)::DOUBLE AS score FROM part WHERE p_partkey % 3 = 0)"""
_BEST = "coalesce(score, '-infinity'::DOUBLE) DESC, length(regexp_replace(file, '^.*/', '')), id"
_TOK = "list_distinct(list_filter(string_split_regex(lower(regexp_replace({}, '^.*/', '')), '[^a-z0-9]+'), lambda t: t <> ''))"


@register("intake_cascade", f"""
WITH {_RECORDS}, w1 AS (SELECT *, first_value(id) OVER (PARTITION BY identity ORDER BY {_BEST}) AS lead FROM r), d1 AS (SELECT id, 'identity' AS outcome, lead AS keeper FROM w1 WHERE identity IS NOT NULL AND id <> lead), s1 AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM d1)),
w2 AS (SELECT *, first_value(id) OVER (PARTITION BY size, md5 ORDER BY {_BEST}) AS lead FROM s1), d2 AS (SELECT id, 'content' AS outcome, lead AS keeper FROM w2 WHERE id <> lead), s2 AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(file, '^.*/', ''), '\\.[^.]+$', '')), '[^a-z0-9]', '', 'g') AS stem FROM s1 WHERE id NOT IN (SELECT id FROM d2)),
d3 AS (SELECT s2.id, 'lossless twin' AS outcome, min(l.id) AS keeper FROM s2 JOIN s2 l ON l.stem = s2.stem AND l.file LIKE '%.wav' WHERE s2.file LIKE '%.mp3' GROUP BY 1), s3 AS (SELECT * FROM s2 WHERE id NOT IN (SELECT id FROM d3)),
w4 AS (SELECT *, first_value(id) OVER (PARTITION BY fp ORDER BY {_BEST}) AS lead, first_value(file) OVER (PARTITION BY fp ORDER BY {_BEST}) AS lead_file FROM s3), m4 AS (SELECT *, len(list_intersect({_TOK.format('file')}, {_TOK.format('lead_file')})) / greatest(len({_TOK.format('file')}), len({_TOK.format('lead_file')})) AS alike FROM w4 WHERE fp IS NOT NULL AND id <> lead),
d4 AS (SELECT id, 'recording' AS outcome, lead AS keeper FROM m4 WHERE alike >= 0.5), s4 AS (SELECT * FROM s3 WHERE id NOT IN (SELECT id FROM d4)), a AS (SELECT * FROM arc WHERE file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identity ORDER BY id) = 1),
d5 AS (SELECT s4.id, CASE WHEN a.id IS NULL THEN 'new' WHEN a.file = s4.file THEN 'self' WHEN s4.score > coalesce(a.score, -1) * 1.05::DOUBLE THEN 'upgrade' ELSE 'archived' END AS outcome, a.id AS keeper FROM s4 LEFT JOIN a USING (identity)),
u AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5) SELECT u.id, outcome, keeper, m4.lead AS review FROM u LEFT JOIN m4 ON m4.id = u.id AND NOT alike >= 0.5""")
def intake_cascade(spark, sf):
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    text = lambda c: c.cast("string")
    identity = F.concat(F.lower("p_brand"), F.lit("|"), F.col("p_name"), text(k % 9))
    plain = F.concat(F.col("p_name"), F.lit(" "), text(F.floor(k / 3)))
    name = F.when(k % 11 == 0, F.concat(F.lit("twin "), text(F.floor(k / 22)))).otherwise(plain)
    records = part.select(
        k.alias("id"), F.concat(F.lit("/in/"), name, F.when(k % 2 == 0, ".mp3").otherwise(".wav")).alias("file"), F.when(k % 97 != 0, identity).alias("identity"), (1000 + k % 40).alias("size"), F.md5(text(F.floor(k / 160))).alias("md5"),
        F.when(k % 31 != 0, (F.col("p_size") * 10 + k % 7).cast("double")).alias("score"), F.when(k % 5 != 0, F.concat(F.lit("f"), text(k % 150))).alias("fp"),
    )
    there = F.when(k % 6 == 0, F.concat(F.lit("/in/"), plain, F.lit(".mp3"))).when(k % 15 != 0, F.concat(F.lit("/arc/"), text(k)))
    archive = part.filter(k % 3 == 0).select(k.alias("id"), identity.alias("identity"), there.alias("file"), (F.col("p_size") * 12).cast("double").alias("score"))
    return ik.cascade(records, archive)


@register("set_from_pool")
def set_from_pool(spark, sf):
    """Greedy peak sets of each genre's candidates in key ranges of 1,200."""
    pool = pl.candidates(pl.judge(**_sources(spark, sf), root="/shelf"))
    key = sc.camelot(F.col("key"))
    pool = pool.select("*", F.concat_ws("/", "family", F.floor(F.col("id") / 1200).cast("string")).alias("grp"), key["hour"].alias("hour"), key["mode"].alias("mode"), F.lit(None).cast("array<double>").alias("embedding"))
    made = ch.build_chains(pool, ["grp"], "peak", 60, "greedy")
    return made.withColumns({c: round_up(F.col(c), 4) for c in ("score", "at_s", "end_s")})


_FILES = """f AS (SELECT p_partkey AS k, p_size, '/v/Contents/' || p_brand || '/' || p_name || ' ' || CASE WHEN p_partkey % 6 = 0 THEN 'same' ELSE 'x' || p_partkey // 5 END || CASE WHEN p_partkey % 5 = 0 THEN ' - 1 2' ELSE '' END || '.mp3' AS path FROM part),
live AS (SELECT path, max(p_size * 1000 + k % 977) AS bytes FROM f WHERE k % 7 <> 0 GROUP BY 1),
broken AS (SELECT k AS id, CASE k % 4 WHEN 0 THEN upper(path) WHEN 1 THEN '/old/' || regexp_extract(path, '([^/]*)$', 1) WHEN 2 THEN '/old/' || replace(regexp_extract(path, '([^/]*)$', 1), '.mp3', ' 3.mp3') ELSE left(path, 23) || 'zz.mp3' END AS path FROM f WHERE k % 2 = 0 OR k % 3 = 0)"""
_BASE = "lower(regexp_extract(path, '([^/]*)$', 1))"
_BARE = f"regexp_replace({_BASE}, '((\\s*-\\s*|\\s+)\\d+\\s*)+\\.mp3$', '.mp3')"


@register("repair_paths", f"""
WITH {_FILES}, n AS (SELECT lower(path) AS key, arg_min(path, (-bytes, path)) AS p FROM live GROUP BY 1), b AS (SELECT {_BASE} AS key, count(*) AS n, arg_min(path, (-bytes, path)) AS p FROM live GROUP BY 1), s AS (SELECT {_BARE} AS key, count(*) AS n, arg_min(path, (-bytes, path)) AS p FROM live GROUP BY 1), h AS (SELECT left(lower(path), 20) AS key, count(*) AS n, arg_min(path, (-bytes, path)) AS p FROM live GROUP BY 1)
SELECT id, CASE WHEN n.p IS NOT NULL THEN n.p WHEN b.n = 1 THEN b.p WHEN s.n = 1 THEN s.p WHEN h.n = 1 THEN h.p WHEN s.n > 1 THEN s.p WHEN b.n > 1 THEN b.p END AS fix,
  CASE WHEN n.p IS NOT NULL THEN 'casefold' WHEN b.n = 1 THEN 'basename' WHEN s.n = 1 THEN 'copy-suffix' WHEN h.n = 1 THEN 'prefix20' WHEN s.n > 1 OR b.n > 1 THEN 'largest-twin' ELSE 'unresolved' END AS via
FROM broken LEFT JOIN n ON n.key = lower(path) LEFT JOIN b ON b.key = {_BASE} LEFT JOIN s ON s.key = {_BARE} LEFT JOIN h ON h.key = left(lower(path), 20)""")
def repair_paths(spark, sf):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    tail = F.when(k % 6 == 0, "same").otherwise(F.concat(F.lit("x"), text(F.floor(k / 5))))
    path = F.concat(F.lit("/v/Contents/"), "p_brand", F.lit("/"), "p_name", F.lit(" "), tail, F.when(k % 5 == 0, " - 1 2").otherwise(""), F.lit(".mp3"))
    files = table(spark, sf, "part").select(k.alias("k"), "p_size", path.alias("path"))
    n, base = F.col("k"), F.regexp_extract("path", "([^/]*)$", 1)
    live = files.filter(n % 7 != 0).groupBy("path").agg(F.max(F.col("p_size") * 1000 + n % 977).alias("bytes"))
    lost = F.when(n % 4 == 0, F.upper("path")).when(n % 4 == 1, F.concat(F.lit("/old/"), base)).when(n % 4 == 2, F.concat(F.lit("/old/"), F.replace(base, F.lit(".mp3"), F.lit(" 3.mp3")))).otherwise(F.concat(F.substring("path", 1, 23), F.lit("zz.mp3")))
    return mt.repair_paths(files.filter((n % 2 == 0) | (n % 3 == 0)).select(n.alias("id"), lost.alias("path")), live)
