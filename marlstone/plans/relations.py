"""Queries of the keyed joins, diffs, filters and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scalar import fold
from marlstone.operators import filters, relational as rel
from marlstone.operators.ranks import number_rows
from marlstone.plans.catalog import register, table

STAMP = "yyyy-MM-dd HH:mm:ss"


@register("latest_per_key", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark, sf):
    events = table(spark, sf, "events")
    return rel.latest_by(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@register("latest_row_join", """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON o_custkey = c_custkey""")
def latest_row_join(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = rel.latest_row_join(table(spark, sf, "customer"), orders, "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return out.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@register("latest_row_join_inner", """
SELECT c_custkey, o_orderkey FROM customer JOIN
(SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def latest_row_join_inner(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return rel.latest_row_join(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], "inner").select("c_custkey", "o_orderkey")


@register("retention_top_n", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20""")
def retention_top_n(spark, sf):
    return rel.top_n_by(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@register("anti_unmatched", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unmatched(spark, sf):
    orders = table(spark, sf, "orders")
    left = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return left.agg(F.count("*").alias("n"))


@register("fk_check", """
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
FROM embeddings e LEFT JOIN (SELECT DISTINCT doc_id FROM labels) d ON e.vec_id = d.doc_id""")
def fk_check(spark, sf):
    return rel.fk_check(table(spark, sf, "embeddings"), table(spark, sf, "labels"), "vec_id", "doc_id")


@register("semi_shared", "SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_shared(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").agg(F.count("*").alias("n"))


@register("star_join", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F'""")
def star_join(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    out = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = out.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@register("coalesce_preference", """
SELECT d.doc_id, coalesce(l.quality, 1 - (d.doc_id % 2)::INT) AS quality, (l.quality IS NOT NULL)::INT AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coalesce_preference(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("quality", (1 - F.col("doc_id") % 2).cast("int")).alias("quality"), F.col("quality").isNotNull().cast("int").alias("labelled"))


@register("source_diff", """
WITH a AS (SELECT DISTINCT lower(trim(p_type)) AS key FROM part WHERE p_size <= 10), b AS (SELECT DISTINCT lower(trim(p_type)) AS key FROM part WHERE p_size > 45)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'only_b' WHEN b.key IS NULL THEN 'only_a' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.key = b.key""")
def source_diff(spark, sf):
    part = table(spark, sf, "part")
    return rel.source_diff(part.filter("p_size <= 10"), part.filter("p_size > 45"), fold(F.col("p_type")))


@register("radar", """
SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9500)
ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def radar(spark, sf):
    """Rows on neither of two keys elsewhere, best first; the top 50 is the feature."""
    rich = table(spark, sf, "supplier").filter("s_acctbal > 9500")
    out = table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    out = out.join(rich, F.col("c_nationkey") == F.col("s_nationkey"), "left_anti")
    return out.orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_name")


INVENTORY = """
a AS (SELECT doc_id AS path, md5(text) AS meta, n_chars AS bytes FROM documents WHERE doc_id % 5 <> 0),
b AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000 ELSE doc_id END AS path, md5(text) AS meta, CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS bytes FROM documents WHERE doc_id % 6 <> 0),
ex AS (SELECT 'first' AS matched_by, a.path ap, a.meta am, a.bytes ab, b.path bp, b.meta bm, b.bytes bb FROM a JOIN b ON a.path = b.path),
ra AS (SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)), rb AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM a)),
sa AS (SELECT * FROM ra WHERE meta IN (SELECT meta FROM ra GROUP BY 1 HAVING count(*) = 1)), sb AS (SELECT * FROM rb WHERE meta IN (SELECT meta FROM rb GROUP BY 1 HAVING count(*) = 1)),
se AS (SELECT 'second' AS matched_by, sa.path ap, sa.meta am, sa.bytes ab, sb.path bp, sb.meta bm, sb.bytes bb FROM sa JOIN sb USING (meta))
"""


@register("inventory_diff", f"""
WITH {INVENTORY}
SELECT CASE WHEN ab IS NOT DISTINCT FROM bb THEN 'same' ELSE 'changed' END AS change, matched_by, ap AS a_path, am AS a_meta, ab AS a_bytes, bp AS b_path, bm AS b_meta, bb AS b_bytes FROM (SELECT * FROM ex UNION ALL SELECT * FROM se)
UNION ALL SELECT 'removed', NULL, path, meta, bytes, NULL, NULL, NULL FROM ra WHERE path NOT IN (SELECT ap FROM se)
UNION ALL SELECT 'added', NULL, NULL, NULL, NULL, path, meta, bytes FROM rb WHERE path NOT IN (SELECT bp FROM se)""")
def inventory_diff(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("meta"), F.col("n_chars").alias("bytes"))
    a = docs.filter("path % 5 <> 0")
    b = docs.filter("path % 6 <> 0").select(F.expr("CASE WHEN path % 7 = 0 THEN path + 1000000 ELSE path END").alias("path"), "meta", F.expr("CASE WHEN path % 11 = 0 THEN bytes + 1 ELSE bytes END").alias("bytes"))
    return rel.two_key_diff(a, b, "path", "meta", "bytes")


@register("cascade_match", """
WITH l AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_partkey % 3 = 0), r AS (SELECT * FROM part WHERE p_partkey % 3 <> 0),
i1 AS (SELECT p_name k, min(p_partkey) m FROM r GROUP BY 1 HAVING count(*) = 1), i2 AS (SELECT p_brand || p_type || p_size k, min(p_partkey) m FROM r GROUP BY 1 HAVING count(*) = 1), i3 AS (SELECT left(p_name, 20) k, min(p_partkey) m FROM r GROUP BY 1 HAVING count(*) = 1)
SELECT p_partkey, CASE WHEN i1.m IS NOT NULL THEN 'name' WHEN i2.m IS NOT NULL THEN 'kind' WHEN i3.m IS NOT NULL THEN 'prefix' ELSE 'none' END AS tier, coalesce(i1.m, i2.m, i3.m) AS match
FROM part l LEFT JOIN i1 ON l.p_name = i1.k LEFT JOIN i2 ON l.p_brand || l.p_type || l.p_size = i2.k LEFT JOIN i3 ON left(l.p_name, 20) = i3.k WHERE p_partkey % 3 = 0""")
def cascade_match(spark, sf):
    part = table(spark, sf, "part")
    kind = F.concat("p_brand", "p_type", F.col("p_size").cast("string"))
    tiers = [("name", F.col("p_name"), F.col("p_name")), ("kind", kind, kind), ("prefix", F.substring("p_name", 1, 20), F.substring("p_name", 1, 20))]
    return rel.cascade_match(part.filter("p_partkey % 3 = 0"), part.filter("p_partkey % 3 <> 0"), "p_partkey", "p_partkey", tiers)


@register("classify_unmatched", """
SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN 'exact' WHEN t.h IS NOT NULL THEN 'twin' ELSE 'unknown' END AS class FROM documents d
LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 2 = 0) e ON d.doc_id = e.vec_id
LEFT JOIN (SELECT md5(text) h FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) t ON md5(d.text) = t.h AND d.doc_id % 2 = 1""")
def classify_unmatched(spark, sf):
    docs = table(spark, sf, "documents")
    exact = table(spark, sf, "embeddings").filter("vec_id % 2 = 0").select("vec_id").distinct()
    twin = docs.filter("doc_id % 2 = 0").select(F.md5("text").alias("h")).distinct()
    out = docs.select("doc_id", F.md5("text").alias("m")).join(exact, F.col("doc_id") == F.col("vec_id"), "left").join(twin, (F.col("m") == F.col("h")) & (F.col("doc_id") % 2 == 1), "left")
    return out.select("doc_id", F.when(F.col("vec_id").isNotNull(), "exact").when(F.col("h").isNotNull(), "twin").otherwise("unknown").alias("class"))


@register("duration_twins", """
SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang AND abs(a.n_chars - b.n_chars) <= 2 AND a.doc_id < b.doc_id""")
def duration_twins(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    right = docs.select(F.col("doc_id").alias("id_b"), "source", "lang", F.col("n_chars").alias("len_b"))
    left = docs.select(F.col("doc_id").alias("id_a"), "source", "lang", F.col("n_chars").alias("len_a"))
    return rel.band_join(left, right, "len_a", "len_b", 2, ["source", "lang"]).filter("id_a < id_b").select("id_a", "id_b")


@register("cross_key_pairs", """
SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM documents a JOIN documents b ON left(a.text, 24) = left(b.text, 24) AND a.source <> b.source AND a.doc_id < b.doc_id""")
def cross_key_pairs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 1, 24).alias("stem"))
    other = docs.select(F.col("doc_id").alias("id_b"), F.col("source").alias("source_b"), "stem")
    return docs.join(other, "stem").filter("source <> source_b AND doc_id < id_b").select(F.col("doc_id").alias("id_a"), "id_b")


@register("import_gate", """
WITH n AS (SELECT doc_id, text, n_chars, left(text, 24) stem FROM documents WHERE doc_id % 10 = 3), o AS (SELECT doc_id, text, n_chars, left(text, 24) stem FROM documents WHERE doc_id % 10 <> 3),
p AS (SELECT n.doc_id, 1 AS pr FROM n JOIN o USING (text) UNION ALL SELECT n.doc_id, 2 FROM n JOIN o USING (stem) UNION ALL SELECT n.doc_id, 3 FROM n JOIN o ON abs(n.n_chars - o.n_chars) <= 2)
SELECT n.doc_id, CASE min(pr) WHEN 1 THEN 'path' WHEN 2 THEN 'stem' WHEN 3 THEN 'length' ELSE 'new' END AS basis FROM n LEFT JOIN p USING (doc_id) GROUP BY 1""")
def import_gate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("h"), F.substring("text", 1, 24).alias("stem"))
    new, old = docs.filter("doc_id % 10 = 3"), docs.filter("doc_id % 10 <> 3").drop("doc_id")
    return filters.gate(new, "doc_id", [("path", new.join(old.select("h").distinct(), "h", "left_semi")), ("stem", new.join(old.select("stem").distinct(), "stem", "left_semi")), ("length", rel.band_join(new, old.select(F.col("n_chars").alias("old_len")).distinct(), "n_chars", "old_len", 2))], "new")


@register("nearest_cue", """
SELECT event_id, nearest_id FROM (SELECT c.event_id, p.event_id AS nearest_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch(p.ts) - epoch(c.ts)), p.ts, CASE WHEN p.ts <= c.ts THEN -p.event_id ELSE p.event_id END) AS r
FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'purchase' AND p.event_type = 'view') WHERE r = 1""")
def nearest_cue(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    cues = events.filter("event_type = 'view'").select("user_id", F.col("t").alias("cue_t"), F.col("event_id").alias("cue_id"))
    out = rel.nearest_match(events.filter("event_type = 'purchase'"), cues, "user_id", "t", "cue_t", "cue_id")
    return out.filter("nearest_id is not null").select("event_id", "nearest_id")


@register("interval_assign", """
WITH i AS (SELECT user_id, event_id AS begun_by, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events WHERE event_type = 'signup')
SELECT p.event_id, i.begun_by FROM events p JOIN i ON p.user_id = i.user_id AND p.ts >= i.s AND p.ts < i.e WHERE p.event_type <> 'signup'""")
def interval_assign(spark, sf):
    from pyspark.sql import Window

    events = table(spark, sf, "events")
    starts = events.filter("event_type = 'signup'")
    spans = starts.select("user_id", F.col("event_id").alias("begun_by"), F.col("ts").alias("s"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("e")).filter("e > s")
    return rel.interval_assign(events.filter("event_type <> 'signup'").select("event_id", "user_id", "ts"), spans, "user_id", "ts", "s", "e").select("event_id", "begun_by")


@register("tempo_neighbors", """
WITH c AS (SELECT p_retailprice AS v, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CAST((SELECT sum(n) FROM c WHERE v > p_retailprice * 0.94 AND v < p_retailprice / 0.94) AS BIGINT) AS neighbours FROM part""")
def tempo_neighbors(spark, sf):
    return rel.band_count(table(spark, sf, "part"), "p_retailprice").select("p_partkey", "neighbours")


@register("upsert_keyed", """
SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id + 5000000, quality, toxic FROM labels WHERE doc_id % 4 = 0""")
def upsert_keyed(spark, sf):
    labels = table(spark, sf, "labels")
    change = labels.filter("doc_id % 4 = 0")
    changed = change.withColumn("quality", (1 - F.col("quality")).cast(labels.schema["quality"].dataType)).unionByName(change.withColumn("doc_id", F.col("doc_id") + 5000000))
    return rel.upsert(labels, changed, ["doc_id"])


@register("insert_or_ignore", "SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_or_ignore(spark, sf):
    labels = table(spark, sf, "labels")
    rows = table(spark, sf, "documents").select("doc_id", *[F.lit(0).cast(labels.schema[c].dataType).alias(c) for c in ("quality", "toxic")])
    return rel.insert_or_ignore(labels, rows, ["doc_id"])


@register("fill_upsert", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, d.q) AS quality, d.q2 AS toxic FROM (SELECT doc_id, 0 AS q, CAST(doc_id % 2 AS INT) AS q2 FROM documents WHERE doc_id % 3 = 0) d FULL JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id""")
def fill_upsert(spark, sf):
    old = table(spark, sf, "documents").filter("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    new = table(spark, sf, "labels").select("doc_id", "quality", F.lit(None).cast("int").alias("toxic"))
    return rel.fill_upsert(old, new, "doc_id", ["quality", "toxic"])


@register("mirror_stale", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def mirror_stale(spark, sf):
    seen = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.mirror(table(spark, sf, "customer"), seen, ["c_custkey"])[1].select("c_custkey")


@register("search_substring", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(source), 'thing') OR contains(lower(lang), 'thing') ORDER BY doc_id LIMIT 200""")
def search_substring(spark, sf):
    return filters.search(table(spark, sf, "documents"), ["text", "source", "lang"], "Thing", "doc_id", 500).select("doc_id")


@register("search_like", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%d_r%' OR lower(p_type) LIKE '%d_r%' ORDER BY p_partkey LIMIT 50")
def search_like(spark, sf):
    return filters.search(table(spark, sf, "part"), ["p_name", "p_type"], "d_r", "p_partkey", 50, literal=False).select("p_partkey")


@register("fuzzy_filter", r"""
SELECT p_partkey, regexp_matches(lower(p_name), 'b.*r.*g') AS subsequence FROM part WHERE regexp_matches(lower(p_name), 'b.*r.*g') OR 1.0 - levenshtein(lower(p_name), 'red bolts') * 1.0 / greatest(length(p_name), 9) >= 1 - 0.38""")
def fuzzy_filter(spark, sf):
    part = table(spark, sf, "part")
    hit, near = filters.subsequence(F.col("p_name"), "brg"), filters.fuzzy(F.col("p_name"), "red bolts", 0.38)
    return part.filter(hit | near).select("p_partkey", hit.alias("subsequence"))


@register("lowq_predicate", """
SELECT p_partkey, concat_ws(' ', p_brand, p_type, p_size) AS reason FROM part WHERE p_size IS NOT NULL AND CASE WHEN p_type LIKE '%STEEL%' THEN p_size < 10 WHEN p_brand = 'Brand#11' THEN p_size < 25 ELSE p_size < 5 END""")
def lowq_predicate(spark, sf):
    part = table(spark, sf, "part")
    low = F.when(F.col("p_type").contains("STEEL"), F.col("p_size") < 10).when(F.col("p_brand") == "Brand#11", F.col("p_size") < 25).otherwise(F.col("p_size") < 5)
    return part.filter(F.col("p_size").isNotNull() & low).select("p_partkey", F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("reason"))


@register("pending_order", """
SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderstatus = 'P') DESC, (o_totalprice < 50000) ASC, o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 100""")
def pending_order(spark, sf):
    """Boolean expressions as sort keys; the first hundred are the queue's head."""
    head = table(spark, sf, "orders").orderBy((F.col("o_orderstatus") == "P").desc(), (F.col("o_totalprice") < 50000).asc(), "o_totalprice", "o_orderkey").limit(100)
    return filters.numbered(head, [(F.col("o_orderstatus") == "P").desc(), (F.col("o_totalprice") < 50000).asc(), F.asc("o_totalprice"), F.asc("o_orderkey")], "rank").select("o_orderkey", "rank")


@register("widening_filter", """
WITH s AS (SELECT count(*) n FROM documents WHERE lang = 'es') SELECT doc_id FROM documents, s WHERE lang = 'es' OR (s.n < 250 AND lang IN ('fr', 'de'))""")
def widening_filter(spark, sf):
    return filters.widening(table(spark, sf, "documents"), [F.col("lang") == "es"], [F.col("lang").isin("fr", "de")], 250).select("doc_id")


@register("prefix_folder", r"SELECT doc_id, regexp_extract(source || '/' || lang || '/x', '^(.*src[^/]+)', 1) AS folder FROM documents")
def prefix_folder(spark, sf):
    path = F.concat_ws("/", "source", "lang", F.lit("x"))
    return table(spark, sf, "documents").select("doc_id", filters.folder_of(path, "src").alias("folder"))


@register("duration_band", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 5000 THEN 'long' END AS excluded FROM documents")
def duration_band(spark, sf):
    return table(spark, sf, "documents").select("doc_id", filters.length_reason(F.col("n_chars"), 500, 5000).alias("excluded"))


@register("stable_id_order", """
SELECT id, row_number() OVER (ORDER BY (TRY_CAST(id AS BIGINT) IS NULL), TRY_CAST(id AS BIGINT), id) AS rank FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS id FROM part)""")
def stable_id_order(spark, sf):
    ids = table(spark, sf, "part").select(F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat('x', p_partkey) ELSE CAST(p_partkey AS STRING) END").alias("id"))
    number = F.col("id").try_cast("decimal(38,0)")
    return number_rows(ids, [number.isNull(), number, F.col("id")], "rank")


@register("extremes", """
SELECT axis, c_custkey, v FROM (
(SELECT 'balance high' AS axis, c_custkey, c_acctbal AS v FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL (SELECT 'balance low', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5) UNION ALL
(SELECT 'nation high', c_custkey, c_nationkey::DOUBLE FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 5) UNION ALL (SELECT 'nation low', c_custkey, c_nationkey::DOUBLE FROM customer ORDER BY c_nationkey, c_custkey LIMIT 5))""")
def extremes(spark, sf):
    return filters.extremes(table(spark, sf, "customer"), "c_custkey", {"balance": "c_acctbal", "nation": "c_nationkey"}, 5)


@register("case_rank_order", """
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'O' QUALIFY rank <= 50""")
def case_rank_order(spark, sf):
    order = [F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2).asc(), F.desc("o_totalprice"), F.asc("o_orderkey")]
    head = table(spark, sf, "orders").filter("o_orderstatus = 'O'").orderBy(*order).limit(50)
    return filters.numbered(head, order, "rank").select("o_orderkey", "rank")


@register("claim_exclusion", """
WITH a AS (SELECT doc_id AS path, 'short' AS kind FROM documents WHERE n_chars < 400), b AS (SELECT doc_id AS path, 'spanish' AS kind FROM documents WHERE lang = 'es'), c AS (SELECT doc_id AS path, 'labelled' AS kind FROM labels)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE path NOT IN (SELECT path FROM a) UNION ALL SELECT * FROM c WHERE path NOT IN (SELECT path FROM a) AND path NOT IN (SELECT path FROM b)""")
def claim_exclusion(spark, sf):
    docs = table(spark, sf, "documents")
    one = lambda df, kind: df.select(F.col("doc_id").alias("path"), F.lit(kind).alias("kind"))
    return rel.claims([one(docs.filter("n_chars < 400"), "short"), one(docs.filter("lang = 'es'"), "spanish"), one(table(spark, sf, "labels"), "labelled")], "path")
