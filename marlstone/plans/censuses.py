"""Queries of the counts, coverage, audits, JSON access and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import scalar as sc
from marlstone.functions import text as tx
from marlstone.operators import census as ce
from marlstone.operators.joins import block_pairs, unpacked
from marlstone.plans.catalog import register, table

R4 = "floor(({}) * 10000 + 0.5) / 10000"


@register("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@register("global_measures", f"SELECT count(*) AS n, {R4.format('coalesce(avg(c_acctbal), 0)')} AS mean_balance, {R4.format('coalesce(avg(c_nationkey), 0)')} AS mean_nation FROM customer")
def global_measures(spark, sf):
    mean = lambda c: sc.round_up(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return table(spark, sf, "customer").agg(F.count("*").alias("n"), mean("c_acctbal").alias("mean_balance"), mean("c_nationkey").alias("mean_nation"))


@register("group_max_time", "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
def group_max_time(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@register("source_census", "SELECT coalesce(nullif(trim(p_brand), ''), 'unknown') AS source, count(*) AS n, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(sum(CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END) AS BIGINT) AS small FROM part GROUP BY 1 ORDER BY n DESC, source LIMIT 50")
def source_census(spark, sf):
    return ce.conditional_census(table(spark, sf, "part"), sc.bucket_label(F.col("p_brand")), "source", {"large": F.col("p_size") > 25, "small": F.col("p_type") == "SMALL"}, 50)


@register("skip_census", """
SELECT o_orderstatus, o_orderpriority, rows, total, rank FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS rows, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY 1, 2) WHERE rank <= 3""")
def skip_census(spark, sf):
    return ce.top_per_kind(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", 3)


@register("set_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus IN ('P', 'O')) AS open FROM orders GROUP BY 1")
def set_pivot(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.select("o_orderpriority", F.col("F").alias("done"), (F.col("O") + F.col("P")).alias("open"))


@register("library_overview", """
SELECT * FROM (SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 24)
UNION ALL SELECT 'bytes', 'sum', CAST(sum(n_chars) AS BIGINT) FROM documents UNION ALL SELECT 'bytes', 'max', max(n_chars) FROM documents""")
def library_overview(spark, sf):
    docs = table(spark, sf, "documents")
    facet = lambda c: docs.groupBy(F.lit(c).alias("facet"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    top = facet("lang").unionByName(facet("source")).orderBy(F.desc("n"), "value").limit(24)
    sums = docs.agg(F.sum("n_chars").alias("sum"), F.max("n_chars").alias("max"))
    return top.unionByName(sums.select(F.inline(F.array(*[F.struct(F.lit("bytes").alias("facet"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("sum", "max")]))))


@register("volume_census", """
SELECT source AS folder, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, max(n_chars) AS largest, count(*) FILTER (n_chars = 0) AS zero_bytes FROM documents GROUP BY 1 ORDER BY bytes DESC, folder LIMIT 100""")
def volume_census(spark, sf):
    out = table(spark, sf, "documents").groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"), F.count_if(F.col("n_chars") == 0).alias("zero_bytes"))
    return out.orderBy(F.desc("bytes"), "folder").limit(100)


@register("bpm_histogram", "SELECT floor(l_quantity / 10) * 10 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def bpm_histogram(spark, sf):
    return ce.histogram(table(spark, sf, "lineitem"), F.col("l_quantity"), 10)


@register("quantization_histogram", "SELECT floor(3000 / l_quantity * 100 + 0.5) / 100 AS q, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1 ORDER BY n DESC, q LIMIT 15")
def quantization_histogram(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_quantity > 0").groupBy(sc.round_up(3000 / F.col("l_quantity"), 2).alias("q")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "q").limit(15)


@register("value_stats", "SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, median(l_quantity) AS mid, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem")
def value_stats(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.min(q).alias("low"), F.max(q).alias("high"), F.median(q).alias("mid"), F.percentile(q, 0.9).alias("p90"))


@register("bitrate_tiers", "SELECT CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 25 THEN 'mid' WHEN p_size < 40 THEN 'high' ELSE 'lossless' END AS tier, count(*) AS n FROM part GROUP BY 1")
def bitrate_tiers(spark, sf):
    tier = sc.ladder(F.col("p_size"), [(10, "low"), (25, "mid"), (40, "high")], "lossless")
    return table(spark, sf, "part").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@register("coverage_count", """
SELECT l_partkey, copies, title, copies < 2 AS at_risk FROM (SELECT l_partkey, count(DISTINCT n_regionkey) AS copies, min(s_name) AS title FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)""")
def coverage_count(spark, sf):
    return ce.coverage(_places(spark, sf), "l_partkey", "n_regionkey", "s_name")


def _places(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


@register("redundancy", """
WITH c AS (SELECT l_partkey, count(DISTINCT n_regionkey) AS copies FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 2 GROUP BY 1),
e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT l_orderkey, entries, gaps, single, CASE WHEN gaps > 0 THEN 'fail' WHEN single > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM (
SELECT l_orderkey, count(*) AS entries, count(*) FILTER (copies IS NULL) AS gaps, count(*) FILTER (copies = 1) AS single FROM e LEFT JOIN c USING (l_partkey) GROUP BY 1)""")
def redundancy(spark, sf):
    covered = ce.coverage(_places(spark, sf).filter("n_regionkey < 2"), "l_partkey", "n_regionkey", "s_name")
    return ce.redundancy(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct(), covered, "l_orderkey", "l_partkey")


@register("collision_groups", """
WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN upper(left(text, 12)) ELSE left(text, 12) END AS path FROM documents WHERE lang = 'en')
SELECT lower(path) AS folded, count(*) AS n, list(path ORDER BY path) AS paths FROM p GROUP BY 1 HAVING count(*) > 1""")
def collision_groups(spark, sf):
    start = F.substring("text", 1, 12)
    docs = table(spark, sf, "documents").filter("lang = 'en'").select(F.when(F.col("doc_id") % 2 == 0, F.upper(start)).otherwise(start).alias("path"))
    return ce.collisions(docs, "path")


@register("tag_census", """
SELECT p_partkey, list_filter([CASE WHEN lower(p_name) <> 'red widget' THEN 'name' END, CASE WHEN lower(p_type) <> lower(m_type) THEN 'type' END, CASE WHEN p_size <> m_size THEN 'size' END], lambda x: x IS NOT NULL) AS fields
FROM (SELECT p_partkey, p_name, p_type, p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'OTHER' ELSE p_type END AS m_type, p_size + (p_partkey % 3 = 0)::INT AS m_size FROM part)""")
def tag_census(spark, sf):
    part = table(spark, sf, "part").withColumns({"m_type": F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'OTHER' ELSE p_type END"), "m_size": F.col("p_size") + (F.col("p_partkey") % 3 == 0).cast("int")})
    fields = ce.differing({"name": F.col("p_name"), "type": F.col("p_type"), "size": F.col("p_size")}, {"name": F.lit(" Red Widget"), "type": F.col("m_type"), "size": F.col("m_size")})
    return part.select("p_partkey", fields.alias("fields"))


@register("tag_compare", """
SELECT c_custkey, len(list_distinct(list_filter([lower(trim(c_mktsegment)), CASE WHEN c_custkey % 2 = 0 THEN 'machinery' END, CASE WHEN c_custkey % 3 = 0 THEN 'building' END], lambda x: x IS NOT NULL))) > 1 AS differ FROM customer""")
def tag_compare(spark, sf):
    present = F.filter(F.array(F.lower(F.trim("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, "machinery"), F.when(F.col("c_custkey") % 3 == 0, "building")), lambda x: x.isNotNull())
    return table(spark, sf, "customer").select("c_custkey", (F.size(F.array_distinct(present)) > 1).alias("differ"))


@register("json_extract_guarded", """
SELECT event_id, CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.k') AS INT) END AS k FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END AS j FROM events)""")
def json_extract_guarded(spark, sf):
    broken = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", sc.json_field(broken, "k").try_cast("int").alias("k"))


@register("json_array_count", """
SELECT user_id, count(*) FILTER (event_id % 3 <> 0) AS n FROM events GROUP BY 1""")
def json_array_count(spark, sf):
    item = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("genre"), F.col("event_id").alias("id")))
    docs = table(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("votes"))
    parsed = F.from_json("votes", "array<struct<genre:string,id:long>>")
    return docs.select("user_id", F.size(F.filter(parsed, lambda v: v["genre"].isNotNull())).cast("long").alias("n"))


@register("freshness_bands", """
WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, CASE WHEN h < 24 THEN 'fresh' WHEN h < 168 THEN 'aging' ELSE 'stale' END AS band FROM (
SELECT user_id, (epoch(any_value(now)) - epoch(max(ts))) / 3600 AS h FROM events, n GROUP BY 1)""")
def freshness_bands(spark, sf):
    events = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    now = events.agg(F.max("t").alias("now"))
    hours = events.groupBy("user_id").agg(F.max("t").alias("t")).join(F.broadcast(now)).withColumn("h", (F.col("now") - F.col("t")) / 3.6e9)
    return hours.select("user_id", sc.ladder(F.col("h"), [(24, "fresh"), (168, "aging")], "stale").alias("band"))


@register("age_buckets", """
WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT CASE WHEN d < 30 THEN '30d' WHEN d < 180 THEN '180d' WHEN d < 730 THEN '730d' ELSE 'older' END AS age, count(*) AS n FROM (SELECT date_diff('day', o_orderdate, now) AS d FROM orders, n) GROUP BY 1""")
def age_buckets(spark, sf):
    orders = table(spark, sf, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    aged = orders.join(F.broadcast(now)).select(sc.ladder(F.datediff("now", "o_orderdate"), [(30, "30d"), (180, "180d"), (730, "730d")], "older").alias("age"))
    return aged.groupBy("age").agg(F.count("*").alias("n"))


@register("data_contracts", """
SELECT * FROM (SELECT 'range' AS name, floor(avg((l_quantity BETWEEN 1 AND 50)::INT) * 10000 + 0.5) / 10000 AS measured, 0.99::DOUBLE AS threshold FROM lineitem
UNION ALL SELECT 'flags', count(DISTINCT l_returnflag)::DOUBLE, 3.0::DOUBLE FROM lineitem UNION ALL SELECT 'cheap', floor(avg((l_extendedprice < 1000)::INT) * 10000 + 0.5) / 10000, 0.5::DOUBLE FROM lineitem), LATERAL (SELECT measured >= threshold AS pass)""")
def data_contracts(spark, sf):
    share = lambda c: F.avg(c.cast("int"))
    return ce.contracts(table(spark, sf, "lineitem"), [("range", share(F.col("l_quantity").between(1, 50)), 0.99), ("flags", F.countDistinct("l_returnflag"), 3), ("cheap", share(F.col("l_extendedprice") < 1000), 0.5)])


@register("fast_gate", f"SELECT l_linestatus AS stage, count(*) AS n, {R4.format('avg((l_returnflag = CASE WHEN l_quantity > 25 THEN chr(65) ELSE chr(78) END)::INT)')} AS accuracy FROM lineitem GROUP BY 1")
def fast_gate(spark, sf):
    right = F.col("l_returnflag") == F.when(F.col("l_quantity") > 25, "A").otherwise("N")
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("stage")).agg(F.count("*").alias("n"), sc.round_up(F.avg(right.cast("int")), 4).alias("accuracy"))


@register("source_audit", f"""
SELECT l_returnflag AS source, count(*) AS n, {R4.format('avg(abs(q - l_quantity))')} AS mae, {R4.format('avg((abs(q - l_quantity) <= 0.01 * l_quantity)::INT)')} AS accurate, {R4.format('avg((abs(q / l_quantity - 2) < 0.02 OR abs(q / l_quantity - 0.5) < 0.02)::INT)')} AS octave
FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN 2 * l_quantity ELSE l_quantity + 1 END AS q FROM lineitem) GROUP BY 1""")
def source_audit(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("q", F.expr("CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN 2 * l_quantity ELSE l_quantity + 1 END"))
    off, ratio = F.abs(F.col("q") - F.col("l_quantity")), F.col("q") / F.col("l_quantity")
    share = lambda c: sc.round_up(F.avg(c.cast("int")), 4)
    return rows.groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"), sc.round_up(F.avg(off), 4).alias("mae"), share(off <= 0.01 * F.col("l_quantity")).alias("accurate"), share((F.abs(ratio - 2) < 0.02) | (F.abs(ratio - 0.5) < 0.02)).alias("octave"))


@register("playlist_majority", """
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag, votes, rows FROM (SELECT *, CAST(sum(votes) OVER (PARTITION BY l_orderkey) AS BIGINT) AS rows, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, l_returnflag) AS r FROM c) WHERE r = 1 AND rows >= 5 AND votes >= 0.7 * rows""")
def playlist_majority(spark, sf):
    return ce.majority(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", 5, 0.7)


@register("distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def distinct_counts(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@register("json_subcategory_counts", """
SELECT event_type, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 50 THEN 'low' ELSE 'high' END AS sub, count(*) AS n FROM events GROUP BY 1, 2""")
def json_subcategory_counts(spark, sf):
    sub = F.when(sc.json_field(F.col("props"), "k").cast("int") < 50, "low").otherwise("high")
    return table(spark, sf, "events").groupBy("event_type", sub.alias("sub")).agg(F.count("*").alias("n"))


@register("progress_counters", f"SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, {R4.format('100.0 * count(*) FILTER (o_orderstatus = chr(70)) / count(*)')} AS percent FROM orders GROUP BY 1")
def progress_counters(spark, sf):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), done.alias("done"), sc.round_up(100.0 * done / F.count("*"), 4).alias("percent"))


@register("ledger_coverage", """
SELECT 'labels' AS ledger, count(l.doc_id) AS covered, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) UNION ALL SELECT 'embeddings', count(e.vec_id), count(*) FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id""")
def ledger_coverage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    one = lambda name, ids: docs.join(ids.withColumn("__in", F.lit(1)), "doc_id", "left").agg(F.lit(name).alias("ledger"), F.count("__in").alias("covered"), F.count("*").alias("total"))
    return one("labels", table(spark, sf, "labels").select("doc_id").distinct()).unionByName(one("embeddings", table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct()))


@register("exclusion_groups", """
SELECT class, count(*) AS n, list(doc_id ORDER BY doc_id)[1:4] AS examples FROM (SELECT doc_id, CASE WHEN n_chars < 400 THEN 'short' WHEN n_chars > 8000 THEN 'long' ELSE 'ok' END AS class FROM documents) GROUP BY 1""")
def exclusion_groups(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", sc.ladder(F.col("n_chars"), [(400, "short"), (8001, "ok")], "long").alias("class"))
    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("doc_id"))).filter("r <= 4")
    return docs.groupBy("class").agg(F.count("*").alias("n")).join(first.groupBy("class").agg(F.array_sort(F.collect_list("doc_id")).alias("examples")), "class")


@register("walk_token", """
SELECT source, left(sha256('{"count":' || count(*) || ',"maxMtime":' || max(doc_id) || ',"totalBytes":' || sum(n_chars) || '}'), 24) AS token FROM documents GROUP BY 1""")
def walk_token(spark, sf):
    sums = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("c"), F.sum("n_chars").alias("b"), F.max("doc_id").alias("m"))
    return sums.select("source", F.substring(F.sha2(ce.canonical_json({"count": F.col("c"), "totalBytes": F.col("b"), "maxMtime": F.col("m")}), 256), 1, 24).alias("token"))


@register("name_similarity", f"""
SELECT a.p_partkey AS a, b.p_partkey AS b, {R4.format("CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 2.0 * (length(a.p_name) + length(b.p_name) - levenshtein(a.p_name, b.p_name)) / (length(a.p_name) + length(b.p_name)) END")} AS ratio,
{R4.format("CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END")} AS bounded
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def name_similarity(spark, sf):
    """The names of two classes of equal (artist, size, name) are compared once for all pairs of their rows."""
    part = table(spark, sf, "part").select("p_brand", "p_size", "p_name", "p_partkey")
    x, y, d = F.col("x.p_name"), F.col("y.p_name"), F.col("d")
    classes = block_pairs(part, ["p_brand", "p_size"], ["p_name"], "p_partkey").withColumn("d", F.levenshtein(x, y))
    scored = classes.withColumns({"ratio": sc.round_up(sc.name_ratio(x, y, d), 4), "bounded": sc.round_up(sc.name_similarity(x, y, d), 4)})
    return unpacked(scored, ["ratio", "bounded"]).select("a", "b", "ratio", "bounded")


@register("version_parse", """
SELECT p_partkey, CASE WHEN t LIKE '%(%remix)' THEN 'remix' WHEN t LIKE '%(extended mix)' THEN 'extended' WHEN t LIKE '%(live%' THEN 'live' ELSE 'original' END AS type, trim(regexp_replace(t, '\\s*\\([^)]*\\)\\s*$', '')) AS base
FROM (SELECT p_partkey, lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' (Ann remix)' WHEN 1 THEN ' (extended mix)' WHEN 2 THEN ' (live at home)' ELSE '' END AS t FROM part), LATERAL (SELECT 1)""".replace("(Ann remix)", "(ann remix)"))
def version_parse(spark, sf):
    title = F.concat("p_name", F.expr("CASE p_partkey % 4 WHEN 0 THEN ' (Ann Remix)' WHEN 1 THEN ' (Extended Mix)' WHEN 2 THEN ' (Live at Home)' ELSE '' END"))
    parsed = tx.version(title)
    return table(spark, sf, "part").select("p_partkey", parsed["type"].alias("type"), parsed["base"].alias("base"))


@register("taxonomy_map", """
SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'budget' WHEN p_type = 'STANDARD' THEN NULL ELSE 'premium' END AS family FROM part""")
def taxonomy_map(spark, sf):
    table_of = {"economy": "budget", "small": "budget", "medium": "premium", "large": "premium", "promo": "premium"}
    return table(spark, sf, "part").select("p_partkey", tx.canonical(F.col("p_type"), table_of, {"standard"}).alias("family"))


@register("comment_codec", """
SELECT p_partkey, p_brand || ' | e' || p_size || ' | ' || p_type AS comment, p_brand AS brand, p_size AS energy FROM part""")
def comment_codec(spark, sf):
    built = table(spark, sf, "part").select("p_partkey", tx.comment(F.col("p_brand"), F.col("p_size"), F.col("p_type")).alias("comment"))
    return built.select("*", tx.comment_part(F.col("comment"), 0).alias("brand"), tx.comment_energy(F.col("comment")).alias("energy"))


@register("tag_sanitize", """
SELECT event_id, CASE WHEN lower(event_type) IN ('error') THEN 'junk' WHEN lower(event_type) LIKE '%view%' THEN 'mood' WHEN lower(event_type) = 'signup' THEN 'scene' ELSE 'genre' END AS class FROM events""")
def tag_sanitize(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.tag_class(F.col("event_type"), [("junk", "^error$"), ("mood", "view"), ("scene", "^signup$")], "genre").alias("class"))


@register("text_compat", r"""
SELECT doc_id, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS control, regexp_matches(text, 'Ã.|Â.|â€') AS mojibake, regexp_matches(text, '[^\x00-\x{024F}\x{2000}-\x{206F}]') AS foreign FROM documents""")
def text_compat(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.has_control(t).alias("control"), tx.looks_mojibake(t).alias("mojibake"), tx.has_foreign(t).alias("foreign"))


@register("copy_suffix", r"""SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' - 2 3' ELSE ' 1' END, '((\s*-\s*|\s+)\d+)+$', '') AS name FROM part""")
def copy_suffix(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.strip_copy_suffix(F.concat("p_name", F.expr("CASE WHEN p_partkey % 2 = 0 THEN ' - 2 3' ELSE ' 1' END"))).alias("name"))


@register("token_signature", """
SELECT p_partkey, array_to_string(list_sort(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '' AND x <> 'x')), '+') AS signature FROM part""")
def token_signature(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.signature(F.col("p_name")).alias("signature"))


@register("meta_key", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE lower(p_brand) || ' - ' || lower(p_name) END AS key FROM part")
def meta_key(spark, sf):
    artist = F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", tx.meta_key(artist, F.col("p_name")).alias("key"))


@register("nearest_vocabulary", """
SELECT p_partkey, word FROM (SELECT p_partkey, word, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(t, word), word) AS r FROM (SELECT p_partkey, split_part(p_name, ' ', 2) || 'e' AS t FROM part), (VALUES ('widget'), ('bolt'), ('ring'), ('gear')) v(word) WHERE levenshtein(t, word) <= 3) WHERE r = 1""")
def nearest_vocabulary(spark, sf):
    word = F.concat(F.split("p_name", " ")[1], F.lit("e"))
    return table(spark, sf, "part").select("p_partkey", tx.nearest_word(word, ["widget", "bolt", "ring", "gear"], 3).alias("word")).filter("word is not null")


@register("finding_upsert", """
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'written' WHEN o.h = n.h THEN 'unchanged' ELSE 'reopened' END AS outcome FROM (SELECT doc_id, md5(text) AS h FROM documents) n LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE md5(text) END AS h FROM documents WHERE doc_id % 3 <> 0) o USING (doc_id)""")
def finding_upsert(spark, sf):
    new = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    old = new.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("h")).alias("old_h"))
    return new.join(old, "doc_id", "left").select("doc_id", F.when(F.col("old_h").isNull(), "written").when(F.col("old_h") == F.col("h"), "unchanged").otherwise("reopened").alias("outcome"))


@register("snapshot_dedup", """
SELECT user_id, count(*) AS kept FROM (SELECT user_id, event_type || floor(value / 50) AS c, lag(event_type || floor(value / 50)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM c GROUP BY 1""")
def snapshot_dedup(spark, sf):
    """A snapshot equal to the latest kept one, whatever the order of its keys, is not stored again."""
    canon = F.sha2(ce.canonical_json({"type": F.col("event_type"), "band": F.floor(F.col("value") / 50)}), 256)
    before = F.lag("c").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("c", canon).withColumn("p", before).filter("NOT (p <=> c)").groupBy("user_id").agg(F.count("*").alias("kept"))


@register("fill_rates", f"SELECT lang, {R4.format('avg((l.quality IS NOT NULL)::INT)')} AS labelled, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def fill_rates(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.groupBy("lang").agg(sc.round_up(F.avg(F.col("quality").isNotNull().cast("int")), 4).alias("labelled"), F.count("*").alias("n"))


@register("label_propagation", """
WITH k AS (SELECT c_mktsegment, c_nationkey, min_by(c_name, c_custkey) AS donor FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE k.donor END AS label FROM customer LEFT JOIN k USING (c_mktsegment, c_nationkey)""")
def label_propagation(spark, sf):
    rows = table(spark, sf, "customer").withColumn("label", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    donor = rows.filter("label is not null").groupBy("c_mktsegment", "c_nationkey").agg(F.min_by("label", "c_custkey").alias("donor"))
    return rows.join(donor, ["c_mktsegment", "c_nationkey"], "left").select("c_custkey", F.coalesce("label", "donor").alias("label"))


@register("year_precedence", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END, CASE WHEN o_orderkey % 2 = 0 THEN 1990 END, 1900)::INT AS year FROM orders")
def year_precedence(spark, sf):
    page, batch = F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate")), F.when(F.col("o_orderkey") % 2 == 0, 1990)
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(page, batch, F.lit(1900)).alias("year"))


@register("badge_ranking", """
SELECT user_id, list_transform(list_sort(list(DISTINCT CASE event_type WHEN 'purchase' THEN '0purchase' WHEN 'signup' THEN '1signup' ELSE '2' || event_type END))[1:3], lambda x: x[2:]) AS badges FROM events GROUP BY 1""")
def badge_ranking(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(tx.ranked_badges(F.collect_set("event_type"), ["purchase", "signup"], 3).alias("badges"))


@register("playlist_children", "SELECT DISTINCT n_regionkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")
def playlist_children(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region").filter("r_regionkey < 3")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_regionkey", "n_name").distinct()
