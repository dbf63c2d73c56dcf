"""Queries of hit scoring, lookups, evidence and status ladders, over stand-ins.

An order is a search for its least part, its other parts are the results. Documents are files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import names as nm
from marlstone.functions.scalar import round_up
from marlstone.functions.text import clean_title, stem_key
from marlstone.operators import evidence as ev
from marlstone.operators import lifecycle as lc
from marlstone.operators import matching as mt
from marlstone.plans.catalog import register, table

R4 = "floor(({}) * 10000 + 0.5) / 10000"


def _tok(s):
    return f"list_filter(string_split_regex(regexp_replace(lower({s}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)"


_HITS = f"""h AS (SELECT DISTINCT l.l_orderkey AS q, p.p_partkey AS cid, s.p_name AS title, s.p_brand AS artist, s.p_size AS seconds, p.p_name AS name, CASE WHEN p.p_partkey % 3 = 0 THEN ['V/A', concat(p.p_brand, '7')] ELSE [p.p_brand] END AS credits, CASE WHEN p.p_partkey % 2 = 0 THEN concat(p.p_name, ' mix') END AS mix, p.p_size AS len
FROM lineitem l JOIN (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY 1) m USING (l_orderkey) JOIN part s ON s.p_partkey = m.k JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_partkey <> m.k),
t AS (SELECT *, lower(artist) AS a, {_tok('title')} AS tt, {_tok('name')} AS nt FROM h), g AS (SELECT *, list_filter(credits, lambda c: contains(lower(c), a)) AS c, len(list_intersect(tt, nt)) / greatest(len(list_distinct(tt)), len(list_distinct(nt))) AS overlap FROM t),
x AS (SELECT *, CASE WHEN len(c) = 0 THEN 0 WHEN lower(c[1]) = a THEN 6 ELSE 4 END AS points FROM g)"""


def _hits(spark, sf):
    lines, part = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "part")
    first = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("k"))
    query = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_size").alias("seconds"))
    odd = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("V/A"), F.concat("p_brand", F.lit("7")))).otherwise(F.array("p_brand"))
    found = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"), odd.alias("credits"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" mix"))).alias("mix"), F.col("p_size").alias("length"))
    return lines.distinct().join(first, "l_orderkey").filter("l_partkey <> k").join(query, "k").join(found, "l_partkey").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("cid"), "title", "artist", "seconds", "name", "credits", "mix", "length")


@register("title_overlap", f"WITH {_HITS} SELECT q, cid, {R4.format('overlap')} AS overlap, len(list_intersect(tt, nt)) > 0 AS shares, points::INT AS points, points = 0 AS fails FROM x")
def title_overlap(spark, sf):
    t, n, a, c = (F.col(x) for x in ("title", "name", "artist", "credits"))
    return _hits(spark, sf).select("q", "cid", round_up(nm.title_overlap(t, n), 4).alias("overlap"), nm.shares_token(t, n).alias("shares"), nm.artist_points(a, c).alias("points"), nm.artist_fails(a, c).alias("fails"))


_CATALOG = "CASE WHEN points = 0 THEN 0 ELSE points + 4 * overlap + CASE WHEN len(list_filter(tt, lambda w: contains(lower(coalesce(mix, '')), w))) > 0 THEN 2 ELSE 0 END + CASE WHEN abs(len - seconds) <= 2 THEN 3 WHEN abs(len - seconds) <= 10 THEN 2 ELSE 0 END END"


@register("catalog_best", f"WITH {_HITS}, s AS (SELECT q, cid, {_CATALOG} AS score FROM x) SELECT q, cid, {R4.format('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY floor(score * 1e6 + 0.5) DESC, cid) AS r FROM s) WHERE r = 1 AND score >= 6")
def catalog_best(spark, sf):
    points = mt.catalog_points(*[F.col(c) for c in ("title", "artist", "seconds", "name", "credits", "mix", "length")])
    best = mt.best_hit(_hits(spark, sf).select("q", "cid", points.alias("score")), "q", ["cid"], "score", 6)
    return best.withColumn("score", round_up(F.col("score"), 4))


@register("store_hits", f"WITH {_HITS} SELECT q, cid, points::INT AS score, row_number() OVER (PARTITION BY q ORDER BY points DESC, cid) AS place FROM x WHERE overlap >= 0.5 AND points > 0")
def store_hits(spark, sf):
    from pyspark.sql import Window

    score = mt.store_points(*[F.col(c) for c in ("title", "artist", "name", "credits")])
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    return _hits(spark, sf).select("q", "cid", score.alias("score")).filter("score is not null").withColumn("place", place)


@register("upload_hits", f"WITH {_HITS}, u AS (SELECT q, cid, len(list_filter(tt, lambda w: list_contains(nt, w))) AS n, contains(lower(credits[-1]), left(a, 8)) AS own FROM x) SELECT q, cid, (2 * n + 1)::INT AS score FROM u WHERE n > 0 AND own")
def upload_hits(spark, sf):
    score = mt.upload_points(F.col("title"), F.col("artist"), F.col("name"), F.element_at("credits", -1))
    return _hits(spark, sf).select("q", "cid", score.alias("score")).filter("score is not null")


_FAMILY = {"standard": "house", "promo": "techno", "economy": "trance"}
_CASE = "CASE lower({}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FAMILY.items()) + " END"


@register("release_family", f"""
WITH r AS (SELECT p_partkey, [split_part(p_name, ' ', 1), CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'None' END] AS styles, ['Rock', p_type] AS genres FROM part), m AS (SELECT p_partkey, list_filter(styles, lambda s: {_CASE.format('s')} IS NOT NULL) AS s, list_filter(genres, lambda s: {_CASE.format('s')} IS NOT NULL) AS g FROM r),
c AS (SELECT p_partkey, s, CASE WHEN len(s) > 0 THEN s ELSE g END AS c FROM m) SELECT p_partkey, {_CASE.format('c[1]')} AS family, lower(s[1]) AS style, list_transform(c, lambda s: {_CASE.format('s')}) AS families FROM c""")
def release_family(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select("p_partkey", F.array(F.split("p_name", " ")[0], F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("None")).alias("styles"), F.array(F.lit("Rock"), "p_type").alias("genres"))
    known = F.create_map(*[F.lit(x) for kv in _FAMILY.items() for x in kv])
    return mt.release_family(rows, "p_partkey", "styles", "genres", lambda s: F.try_element_at(known, F.lower(s)))


_LABEL = "CASE p_partkey % 7 WHEN 0 THEN concat(' ', p_brand, ' Records') WHEN 1 THEN p_brand WHEN 2 THEN 'Music' WHEN 3 THEN '123' WHEN 4 THEN 'Deep' WHEN 5 THEN 'Brand#1 ltd' ELSE 'Blue' END"
_IMPRINTS = {"brand#1": "a", "brand#2": "b", "brand#1 productions": "c", "deep recordings": "d", "blue one": "e", "blue two": "f"}
_KEYS = "[" + ", ".join(f"'{k}'" for k in sorted(_IMPRINTS)) + "]"


@register("imprint_lookup", f"""
WITH l AS (SELECT p_partkey, lower(trim({_LABEL})) AS base FROM part), b AS (SELECT *, trim(regexp_replace(base, '\\s+(recordings?|records?|music|ltd|productions?)$', '')) AS bare FROM l), k AS (SELECT *, list_filter({_KEYS}, lambda k: starts_with(k, concat(bare, ' '))) AS more FROM b)
SELECT p_partkey, CASE WHEN base = 'music' OR regexp_matches(base, '^\\d+$') THEN NULL WHEN list_contains({_KEYS}, base) THEN base WHEN list_contains({_KEYS}, bare) THEN bare WHEN len(more) = 1 THEN more[1] END AS imprint FROM k""")
def imprint_lookup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", nm.imprint(F.expr(_LABEL), _IMPRINTS).alias("imprint"))


@register("key_tokens", "SELECT p_partkey, CASE WHEN p_size % 14 BETWEEN 1 AND 12 THEN concat(lpad((p_size % 14)::VARCHAR, 2, '0'), CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END) END AS token FROM part")
def key_tokens(spark, sf):
    key = F.concat((F.col("p_size") % 14).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("B"))
    return table(spark, sf, "part").select("p_partkey", nm.key_token(key).alias("token"))


@register("resolve_terms", "SELECT p_partkey, CASE WHEN w = 'ring' THEN 'ring' WHEN contains(w, 'gadget') OR contains('gadget', w) THEN 'gadget' WHEN contains(w, 'ring') OR contains('ring', w) THEN 'ring' ELSE w END AS term FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 2)) AS w FROM part)")
def resolve_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", nm.resolve_term(F.split("p_name", " ")[1], ["gadget", "ring"]).alias("term"))


def _locate_sql(q):
    return f"""SELECT '{q}' AS q, drive, CASE WHEN (SELECT max(e) FROM n{{i}}) > 0 THEN e ELSE s END AS n FROM n{{i}} WHERE CASE WHEN (SELECT max(e) FROM n{{i}}) > 0 THEN e ELSE s END > 0"""


_INVENTORY = "i AS (SELECT p_type AS drive, concat('/music/', p_name) AS path, p_name AS title, p_brand AS artist FROM part)"
_LOCATED = ("/music/red widget", "brand#3 - small ring", "widg")


@register("track_locations", f"WITH {_INVENTORY}, " + ", ".join(f"n{i} AS (SELECT drive, count(*) FILTER (path = '{q}' OR concat(lower(artist), ' - ', title) = '{q}') AS e, count(*) FILTER (contains(lower(concat(path, ' ', title, ' ', artist)), '{q}')) AS s FROM i GROUP BY 1)" for i, q in enumerate(_LOCATED)) + " " + " UNION ALL ".join(_locate_sql(q).format(i=i) for i, q in enumerate(_LOCATED)))
def track_locations(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_type").alias("drive"), F.concat(F.lit("/music/"), "p_name").alias("path"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    found = [mt.locate(part, q).select(F.lit(q).alias("q"), "drive", "n") for q in _LOCATED]
    return found[0].unionByName(found[1]).unionByName(found[2])


_FINDINGS = "f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'open' ELSE 'decided' END AS status, o_orderpriority AS kind FROM orders)"


def _findings(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", F.when(s == "F", "archived").when(s == "O", "open").otherwise("decided").alias("status"), F.col("o_orderpriority").alias("kind"))


@register("findings_default", f"WITH {_FINDINGS} SELECT * FROM f WHERE status <> 'archived'")
def findings_default(spark, sf):
    return _findings(spark, sf).filter(lc.finding_filter())


@register("findings_asked", f"WITH {_FINDINGS} SELECT * FROM f WHERE status = 'archived' AND kind = '5-LOW'")
def findings_asked(spark, sf):
    return _findings(spark, sf).filter(lc.finding_filter("archived", "5-LOW"))


@register("label_population", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS label, CASE WHEN doc_id % 3 = 0 THEN 'disputed' WHEN doc_id % 4 = 0 THEN 'resolved:x' END AS flag, CASE doc_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE '["a"]' END AS votes FROM documents)
SELECT doc_id, label IS NOT NULL AND trim(label) <> '' AND flag IS DISTINCT FROM 'disputed' AS labelled, coalesce(trim(votes) NOT IN ('', '[]', '{}'), false) AS voted FROM d""")
def label_population(spark, sf):
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", F.when(i % 5 == 0, " ").when(i % 7 != 0, F.col("lang")).alias("label"), F.when(i % 3 == 0, "disputed").when(i % 4 == 0, "resolved:x").alias("flag"), F.when(i % 6 == 0, "[]").when(i % 6 == 1, "{}").when(i % 6 == 2, "").when(i % 6 > 3, '["a"]').alias("votes"))
    return rows.select("doc_id", lc.labelled(F.col("label"), F.col("flag")).alias("labelled"), lc.has_votes(F.col("votes")).alias("voted"))


@register("work_queue", "SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 OR n_chars > 900 THEN 'skipped' WHEN doc_id % 2 = 0 THEN 'analyzed' ELSE 'pending' END AS status, CASE WHEN doc_id % 9 = 0 THEN 'no beats' WHEN n_chars > 900 THEN 'over duration cap' END AS reason FROM documents")
def work_queue(spark, sf):
    docs = table(spark, sf, "documents")
    return lc.work_queue(docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 0, 10).alias("beats"), F.col("n_chars").alias("seconds"), (F.col("doc_id") % 2 == 0).alias("analyzed")), 900)


_RUNG = ("bp", "mb", "lastfm", "imprint", "none")
_RUNG_SQL = "CASE l_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RUNG)) + " END"
_VOTES = f"""v AS (SELECT l_partkey AS track, {_RUNG_SQL} AS rung, lower(l_returnflag) || CASE WHEN l_linenumber > 3 THEN 'x' ELSE '' END AS genre FROM lineitem),
e0 AS (SELECT track, rung, left(genre, 1) AS family, min(genre) AS genre FROM v WHERE left(genre, 1) <> 'n' AND rung <> 'none' GROUP BY 1, 2, 3),
e AS (SELECT track, 'vote:' || rung AS annotator, CASE rung WHEN 'bp' THEN 'exact_recording' WHEN 'mb' THEN 'same_song_other_version' WHEN 'lastfm' THEN 'user' ELSE 'label' END AS scope, family, CASE WHEN genre <> family THEN genre END AS subgenre, (CASE rung WHEN 'bp' THEN 0.9 WHEN 'mb' THEN 0.75 WHEN 'lastfm' THEN 0.6 ELSE 0.4 END)::DOUBLE AS confidence FROM e0)"""


def _evidence(spark, sf):
    rung = F.element_at(F.array(*[F.lit(r) for r in _RUNG]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    genre = F.concat(F.lower("l_returnflag"), F.when(F.col("l_linenumber") > 3, "x").otherwise(""))
    votes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("track"), rung.alias("rung"), genre.alias("genre"))
    family = F.substring("genre", 1, 1)
    return ev.votes_to_evidence(votes, F.when(family != "n", family))


@register("votes_to_evidence", f"WITH {_VOTES} SELECT * FROM e")
def votes_to_evidence(spark, sf):
    return _evidence(spark, sf)


@register("evidence_collapsed", f"""
WITH {_VOTES}, m AS (SELECT *, CASE WHEN track % 2 = 0 AND scope = 'user' THEN 'same_song_other_version' ELSE scope END AS s FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY track, family ORDER BY confidence DESC, annotator) AS r FROM m WHERE s = 'same_song_other_version')
SELECT track, annotator, s AS scope, family, subgenre, confidence FROM m WHERE s <> 'same_song_other_version' UNION ALL SELECT track, 'sibling:collapsed:' || annotator, s, family, subgenre, confidence FROM r WHERE r = 1""")
def evidence_collapsed(spark, sf):
    scope = F.when((F.col("track") % 2 == 0) & (F.col("scope") == "user"), "same_song_other_version").otherwise(F.col("scope"))
    return ev.with_collapsed(_evidence(spark, sf).withColumn("scope", scope))


@register("remixer_prior", """
SELECT l_orderkey * 10 + l_linenumber AS track, 'remixer:catalog:' || lower(s_name) AS annotator, 'remixer' AS scope, c.family, NULL::VARCHAR AS subgenre, c.confidence FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber IN (1, 2)) l JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN (SELECT s_name AS artist, 'n' || s_nationkey AS family, 0.5::DOUBLE AS confidence FROM supplier UNION ALL SELECT s_name, 'any', 0.25 FROM supplier WHERE s_suppkey % 2 = 0) c ON lower(c.artist) = lower(s.s_name)""")
def remixer_prior(spark, sf):
    sup = table(spark, sf, "supplier")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    n = F.col("l_linenumber")
    tracks = lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("l_orderkey") * 10 + n).alias("track"), F.when(n == 1, "remix").when(n == 2, "vip").otherwise("original").alias("version"), F.upper("s_name").alias("remixer"))
    catalog = sup.select(F.col("s_name").alias("artist"), F.concat(F.lit("n"), "s_nationkey").alias("family"), F.lit(0.5).alias("confidence")).unionByName(sup.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("artist"), F.lit("any").alias("family"), F.lit(0.25).alias("confidence")))
    return ev.remixer_prior(tracks, catalog)


_SHELF = "concat(source, '/D', doc_id // 2, CASE WHEN doc_id % 2 = 1 THEN ' [old]' ELSE '' END, '.aiff')"
_DRIVE = "concat(source, '/d', doc_id // 2, '.aiff')"


@register("archive_coverage", f"""
WITH s AS (SELECT {_SHELF} AS path, n_chars AS bytes FROM documents), f AS (SELECT {_DRIVE} AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS bytes FROM documents),
k AS (SELECT DISTINCT regexp_replace(lower(path), ' \\[old\\]', '') AS path, bytes FROM s WHERE path LIKE '% [old].aiff'), v AS (SELECT path, CASE WHEN (lower(path), bytes) IN (SELECT (lower(path), bytes) FROM s) THEN 'covered' WHEN (lower(path), bytes) IN (SELECT (path, bytes) FROM k) THEN 'preserved' ELSE 'copy' END AS verdict FROM f)
SELECT path, verdict, CASE WHEN verdict = 'copy' THEN CASE WHEN lower(path) IN (SELECT lower(path) FROM s) THEN replace(path, '.aiff', ' [usb].aiff') ELSE path END END AS dest FROM v""")
def archive_coverage(spark, sf):
    docs = table(spark, sf, "documents")
    half = F.floor(F.col("doc_id") / 2)
    shelf = docs.select(F.concat("source", F.lit("/D"), half, F.when(F.col("doc_id") % 2 == 1, " [old]").otherwise(""), F.lit(".aiff")).alias("path"), F.col("n_chars").alias("bytes"))
    files = docs.select(F.concat("source", F.lit("/d"), half, F.lit(".aiff")).alias("path"), (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int")).alias("bytes"))
    return lc.classify_files(files, shelf, "usb")


@register("intake_census", """
WITH f AS (SELECT CASE WHEN doc_id % 10 = 0 THEN '/M/D' ELSE '/m/d' END || doc_id AS path FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT CASE WHEN doc_id % 8 = 0 THEN '/x/d' || doc_id WHEN doc_id % 9 <> 0 THEN '/m/d' || doc_id END AS path FROM documents), r AS (SELECT path FROM b WHERE path IS NOT NULL),
c AS (SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM r WHERE lower(path) LIKE '/m/%' AND lower(path) NOT IN (SELECT lower(path) FROM f)) AS missing, (SELECT count(*) FROM r WHERE path LIKE '/x/%') AS outside, (SELECT count(*) FROM f WHERE lower(path) NOT IN (SELECT lower(path) FROM r)) AS orphans,
(SELECT count(*) FROM (SELECT lower(path) FROM (SELECT path FROM f UNION SELECT path FROM r) GROUP BY 1 HAVING count(*) > 1)) AS collisions) SELECT *, CASE WHEN missing + outside + orphans + collisions > 0 THEN 'drift' ELSE 'clean' END AS verdict FROM c""")
def intake_census(spark, sf):
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    files = docs.filter(i % 3 != 0).select(F.concat(F.when(i % 10 == 0, "/M/D").otherwise("/m/d"), i).alias("path"))
    rows = docs.select(F.when(i % 8 == 0, F.concat(F.lit("/x/d"), i)).when(i % 9 != 0, F.concat(F.lit("/m/d"), i)).alias("path"))
    return lc.reconcile(files, rows, "/m")


_NAMED = "concat(' ', p_name, CASE p_partkey % 5 WHEN 0 THEN ' [archive]' WHEN 1 THEN ' [archive 12]' WHEN 2 THEN ' [BACKUP2]' WHEN 3 THEN ' (3)' ELSE ' [live]' END)"
_CLEAN = "trim(lower(trim(regexp_replace(regexp_replace({}, '\\s*\\[(archive( \\d+)?|BACKUP2)\\]', '', 'g'), '\\(\\d+\\)$', ''))))"


@register("copy_groups", f"SELECT {_CLEAN.format(_NAMED)} AS title, count(*) AS n, min(p_partkey) AS first, min({_CLEAN.format(_NAMED)}) AS stem FROM part GROUP BY 1")
def copy_groups(spark, sf):
    name = F.expr(_NAMED)
    path = F.concat(F.lit("/a.b/"), name, F.lit(".aiff"))
    rows = table(spark, sf, "part").select("p_partkey", clean_title(name).alias("title"), stem_key(path).alias("stem"))
    return rows.groupBy("title").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.min("stem").alias("stem"))
