"""Queries of label aggregation, energy, duplicates and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.functions.text import signature
from marlstone.operators import energy as en
from marlstone.operators import integrity as it
from marlstone.operators import labels as lb
from marlstone.operators.graph import connected_components as components
from marlstone.operators.joins import cell_join
from marlstone.plans.catalog import register, table
from marlstone.session import materialise

R4 = "floor(({}) * 10000 + 0.5) / 10000"


@register("vote_election", """
WITH s AS (SELECT l_partkey, l_returnflag AS l, sum(l_linenumber) AS w, max(l_linenumber) AS top FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, top DESC, l) AS r, row_number() OVER (PARTITION BY l_partkey ORDER BY (l = 'N'), w DESC, top DESC, l) AS q FROM s),
w AS (SELECT l_partkey, l AS winner, w AS weight FROM r WHERE q = 1) SELECT w.l_partkey, winner, CAST(weight AS BIGINT) AS weight, (SELECT min_by(l, r) FROM r WHERE r.l_partkey = w.l_partkey AND l <> winner) AS runner_up FROM w""")
def vote_election(spark, sf):
    return lb.elect(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag", "l_linenumber", ["N"])


@register("election_drift", """
WITH s AS (SELECT l_partkey, l_returnflag AS l, sum(l_linenumber) AS w, max(l_linenumber) AS top FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, top DESC, l) AS r FROM s),
f AS (SELECT l_partkey, min_by(l_returnflag, (l_orderkey, l_linenumber)) AS stored FROM lineitem GROUP BY 1) SELECT l_partkey, stored, l AS winner, stored <> l AS drift FROM r JOIN f USING (l_partkey) WHERE r = 1""")
def election_drift(spark, sf):
    lines = table(spark, sf, "lineitem")
    # Order and line may repeat: the first such row of the table is the one stored. Nulls come last, and a row without a flag stores none.
    last = lambda c: (F.col(c).isNull().alias(f"no_{c}"), F.col(c))
    at = F.struct(*last("l_orderkey"), *last("l_linenumber"), "_metadata.file_path", "_metadata.row_index")
    placed = lines.select("l_partkey", "l_returnflag", F.when(F.col("l_returnflag").isNotNull(), at).alias("at"))
    stored = placed.groupBy("l_partkey").agg(F.min_by("l_returnflag", "at").alias("stored"))
    now = lb.elect(lines, "l_partkey", "l_returnflag", "l_linenumber", [])
    return now.join(stored, "l_partkey").select("l_partkey", "stored", "winner", (F.col("stored") != F.col("winner")).alias("drift"))


@register("evidence_collapse", """
SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, lower(l_returnflag) ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def evidence_collapse(spark, sf):
    out = lb.collapse(table(spark, sf, "lineitem"), "l_partkey", F.col("l_returnflag"), "l_discount", [F.asc("l_orderkey"), F.asc("l_linenumber")])
    return out.select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")


@register("silver_labels", """
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS votes, count(DISTINCT l_suppkey % 5) AS sources FROM lineitem GROUP BY 1, 2), r AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY l_partkey) AS BIGINT) AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_returnflag) AS r FROM c)
SELECT l_partkey, l_returnflag, votes, total FROM r WHERE r = 1 AND total >= 2 AND sources >= 2 AND votes >= 0.6 * total""")
def silver_labels(spark, sf):
    return lb.silver(table(spark, sf, "lineitem").withColumn("src", F.col("l_suppkey") % 5), "l_partkey", "l_returnflag", "src")


@register("review_queue", f"""
WITH c AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS kinds, count(*) AS n, sum(round(l_discount * 100)::BIGINT) AS cents FROM lineitem GROUP BY 1) SELECT l_partkey, {R4.format('(100 * kinds + cents)::DOUBLE / (100 * n)')} AS suspicion FROM c ORDER BY suspicion DESC, l_partkey LIMIT 100""")
def review_queue(spark, sf):
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("long"))  # whole units: a sum of doubles depends on its order
    c = table(spark, sf, "lineitem").groupBy("l_partkey").agg(((100 * F.countDistinct("l_returnflag") + cents) / (100 * F.count("*"))).alias("s"))
    return c.select("l_partkey", round_up(F.col("s"), 4).alias("suspicion")).orderBy(F.desc("suspicion"), "l_partkey").limit(100)


@register("hard_cases", f"""
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT l_partkey, max(v) * 1.0 / sum(v) AS conf FROM c GROUP BY 1) SELECT l_partkey, {R4.format('conf')} AS conf FROM s WHERE conf < 0.6 ORDER BY conf, l_partkey LIMIT 300""")
def hard_cases(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("v")).groupBy("l_partkey").agg((F.max("v") / F.sum("v")).alias("conf"))
    return c.filter("conf < 0.6").orderBy("conf", "l_partkey").limit(300).select("l_partkey", round_up(F.col("conf"), 4).alias("conf"))


@register("l3_rank", f"""
WITH i AS (SELECT DISTINCT l_partkey FROM lineitem), g AS (SELECT i.l_partkey, s.sub FROM i, (VALUES ('AIR'), ('F'), ('O')) s(sub)), v AS (SELECT l_partkey, l_linestatus AS sub, count(*) AS v FROM lineitem GROUP BY 1, 2),
j AS (SELECT g.l_partkey, g.sub, coalesce(v, 0) AS v, sum(coalesce(v, 0)) OVER (PARTITION BY g.l_partkey) AS t FROM g LEFT JOIN v ON g.l_partkey = v.l_partkey AND g.sub = v.sub), k AS (SELECT l_partkey, sub, 0.8 * CASE WHEN t > 0 THEN v / t ELSE 1 / 3 END AS s FROM j)
SELECT l_partkey, sub, {R4.format('s')} AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, sub) AS rank FROM k""")
def l3_rank(spark, sf):
    lines = table(spark, sf, "lineitem")
    posts = lines.select("l_partkey").distinct().select("l_partkey", F.lit("x").alias("family"), F.lit(0.8).alias("posterior"), F.array(F.lit("AIR"), F.lit("F"), F.lit("O")).alias("subs"))
    out = lb.rank_within(posts, lines.select("l_partkey", F.col("l_linestatus").alias("sub")), "l_partkey", "family", "sub")
    return out.withColumn("score", round_up(F.col("score"), 4))


@register("dawid_skene")
def dawid_skene(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("annotator", F.col("l_suppkey") % 5)
    post, _ = lb.dawid_skene(lines, "l_partkey", "annotator", "l_returnflag", iterations=8)
    return post.withColumn("posterior", round_up(F.col("posterior"), 4))


@register("bradley_terry")
def bradley_terry(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf, "events").select("event_type", "value", F.lead("event_type").over(w).alias("b"), F.lead("value").over(w).alias("v")).filter("b is not null and b <> event_type and v <> value")
    won = F.col("value") > F.col("v")
    out = lb.bradley_terry(pairs.select(F.when(won, F.col("event_type")).otherwise(F.col("b")).alias("w"), F.when(won, F.col("b")).otherwise(F.col("event_type")).alias("l")), "w", "l")
    return out.withColumn("score", round_up(F.col("score"), 4))


def _confidence(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_quantity") / 51).alias("p"), (F.col("l_returnflag") == "A").alias("k"))


@register("temperature_grid", """
WITH c AS (SELECT l_quantity / 51 AS p, l_returnflag = 'A' AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT unnest(range(2, 101)) / 20.0 AS t),
l AS (SELECT t, sum(n * ln(1 + exp(CASE WHEN k THEN -ln(p / (1 - p)) ELSE ln(p / (1 - p)) END / t))) / sum(n) AS loss FROM c, g GROUP BY 1) SELECT t::DOUBLE AS t FROM l ORDER BY floor(loss * 1e9), t LIMIT 1""")
def temperature_grid(spark, sf):
    c = _confidence(spark, sf)
    return lb.temperature(c, F.col("p"), F.col("k")).select(F.col("t").cast("double").alias("t"))


@register("tau_search", f"""
WITH c AS (SELECT l_quantity / 51 AS p, (l_returnflag = 'A')::INT AS k FROM lineitem), g AS (SELECT unnest(range(10, 20)) / 20.0 AS tau) SELECT tau::DOUBLE AS tau, {R4.format('avg(k)')} AS precision, count(*) AS n FROM c, g WHERE p >= tau GROUP BY tau HAVING avg(k) >= 0.3 ORDER BY tau LIMIT 1""")
def tau_search(spark, sf):
    c = _confidence(spark, sf)
    return lb.threshold(c, F.col("p"), F.col("k"), 0.3, [i / 20.0 for i in range(10, 20)]).select("tau", round_up(F.col("precision"), 4).alias("precision"), "n")


@register("percentile_rank", f"SELECT p_partkey, {R4.format('cume_dist() OVER (ORDER BY p_size)')} AS p FROM part")
def percentile_rank(spark, sf):
    return en.percentile_rank(table(spark, sf, "part"), "p_size", "p").select("p_partkey", round_up(F.col("p"), 4).alias("p"))


@register("family_percentile", f"""
WITH q AS (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) >= 300 THEN cume_dist() OVER (PARTITION BY p_type ORDER BY p_size) ELSE cume_dist() OVER (ORDER BY p_size) END AS p FROM part) SELECT p_partkey, {R4.format('p')} AS percentile, greatest(1, least(9, ceil(p * 9)))::INT AS band FROM q""")
def family_percentile(spark, sf):
    return en.family_percentile(table(spark, sf, "part"), "p_type", "p_size").select("p_partkey", round_up(F.col("percentile"), 4).alias("percentile"), "band")


@register("decile_bands", """
WITH s AS (SELECT list(p_retailprice ORDER BY p_retailprice) AS v, count(*) AS n FROM part), c AS (SELECT [v[floor(n * i / 10.0)::INT + 1] for i in range(1, 9)] AS cuts FROM s) SELECT p_partkey, (len(list_filter(cuts, lambda c: c < p_retailprice)) + 1)::INT AS band FROM part, c""")
def decile_bands(spark, sf):
    part = table(spark, sf, "part")
    cuts = en.decile_cuts(part, "p_retailprice")
    return part.join(F.broadcast(cuts)).select("p_partkey", en.band_of(F.col("p_retailprice"), F.col("cuts")).alias("band"))


@register("iqr_dead", f"""
WITH l AS (SELECT 'l_quantity' AS signal, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'flat', CASE WHEN l_linenumber > 6 THEN 1.0 ELSE 0.0 END FROM lineitem),
s AS (SELECT signal, list(v ORDER BY v) AS v, count(*) AS n FROM l GROUP BY 1), q AS (SELECT signal, (v[floor(n * 0.75)::INT + 1] - v[floor(n * 0.25)::INT + 1]) / (v[-1] - v[1]) AS iqr FROM s) SELECT signal, {R4.format('iqr')} AS iqr, iqr < 0.02 AS dead FROM q""")
def iqr_dead(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("flat", F.when(F.col("l_linenumber") > 6, 1.0).otherwise(0.0))
    return en.dead_signals(rows, ["l_quantity", "l_discount", "flat"]).withColumn("iqr", round_up(F.col("iqr"), 4))


@register("energy_composite", f"""
WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS s, p_retailprice AS r FROM part), p AS (SELECT p_partkey, s, CASE WHEN s IS NOT NULL THEN cume_dist() OVER (PARTITION BY s IS NULL ORDER BY s) END AS ps, cume_dist() OVER (ORDER BY r) AS pr FROM q)
SELECT p_partkey, {R4.format('(coalesce(ps, 0) * 2 + pr) / (CASE WHEN s IS NULL THEN 1 ELSE 3 END)')} AS composite, {R4.format('CASE WHEN s IS NULL THEN 1 ELSE 3 END / 3')} AS confidence FROM p""")
def energy_composite(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("s"), F.col("p_retailprice").alias("r"))
    return en.composite(part, {"s": 2.0, "r": 1.0}).select("p_partkey", round_up(F.col("composite"), 4).alias("composite"), round_up(F.col("confidence"), 4).alias("confidence"))


@register("energy_gates", f"""
WITH b AS (SELECT greatest(1, least(9, ceil(cume_dist() OVER (ORDER BY p_size) * 9)))::INT AS band FROM part) SELECT band, {R4.format('count(*) / (SELECT count(*) FROM part)')} AS share, count(*) * 1.0 / (SELECT count(*) FROM part) BETWEEN 0.08 AND 0.14 AS pass FROM b GROUP BY 1""")
def energy_gates(spark, sf):
    part = table(spark, sf, "part")
    bands = en.percentile_rank(part, "p_size", "p").groupBy(en.band(F.col("p")).alias("band")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.lit(part.count())
    return bands.select("band", round_up(share, 4).alias("share"), share.between(0.08, 0.14).alias("pass"))


@register("byte_twins", """
WITH d AS (SELECT doc_id, n_chars, md5(text) AS digest FROM documents), c AS (SELECT digest, count(*) AS copies FROM d GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, digest, copies, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS place FROM d JOIN c USING (digest)""")
def byte_twins(spark, sf):
    return it.twins(table(spark, sf, "documents").select("doc_id", "n_chars", "text"), "n_chars", F.md5("text"), [F.asc("doc_id")]).select("doc_id", "digest", "copies", "place")


@register("redundant_bytes", "SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM (SELECT n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def redundant_bytes(spark, sf):
    lost = it.twins(table(spark, sf, "documents"), "n_chars", F.md5("text"), [F.asc("doc_id")]).filter("place > 1")
    return lost.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"))


@register("dup_keeper", "SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1 AS keep FROM part")
def dup_keeper(spark, sf):
    return it.keepers(table(spark, sf, "part"), ["p_name", "p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "keep")


@register("acoustic_severity", """
WITH g AS (SELECT doc_id, n_chars, max(n_chars) OVER (PARTITION BY left(text, 24)) AS top FROM documents) SELECT doc_id, CASE WHEN d < 0.005 THEN 'certain' WHEN d < 0.03 THEN 'likely' WHEN d < 0.15 THEN 'possible' ELSE 'unlikely' END AS severity FROM (SELECT doc_id, (top - n_chars) / top AS d FROM g)""")
def acoustic_severity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.substring("text", 1, 24).alias("fp"))
    top = docs.groupBy("fp").agg(F.max("n_chars").alias("top"))
    return docs.join(top, "fp").select("doc_id", it.severity((F.col("top") - F.col("n_chars")) / F.col("top")).alias("severity"))


@register("twin_verdict", """
SELECT a.doc_id AS original, b.doc_id AS twin, CASE WHEN md5(a.text) = md5(b.text) THEN 'identical' WHEN a.lang <> b.lang THEN 'different' WHEN a.n_chars > b.n_chars THEN 'keep-original' WHEN a.n_chars < b.n_chars THEN 'keep-twin' ELSE 'equal' END AS verdict FROM documents a JOIN documents b ON left(a.text, 24) = left(b.text, 24) AND a.doc_id < b.doc_id""")
def twin_verdict(spark, sf):
    """Documents of one stem meet in cells, so a common stem is spread over tasks."""
    half = lambda at: F.conv(F.substring("h", at, 16), 16, -10).cast("long")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("h"), F.substring("text", 1, 24).alias("stem"))
    docs = materialise(docs.filter("doc_id IS NOT NULL AND stem IS NOT NULL").select("doc_id", "lang", "n_chars", "stem", half(1).alias("h1"), half(17).alias("h2")))
    pairs = cell_join(docs, ["stem"], "doc_id", ["lang", "n_chars", "h1", "h2"], F.lit(1)).filter("doc_id <> other_doc_id")
    same = (F.col("h1") == F.col("other_h1")) & (F.col("h2") == F.col("other_h2"))
    # The pair may have met in either order: with the greater id first, its sizes are compared with the sign turned.
    sign = F.when(F.col("doc_id") < F.col("other_doc_id"), 1).otherwise(-1)
    verdict = it.judge(same, F.col("lang") == F.col("other_lang"), sign * F.col("n_chars"), sign * F.col("other_n_chars"))
    return pairs.select(F.least("doc_id", "other_doc_id").alias("original"), F.greatest("doc_id", "other_doc_id").alias("twin"), verdict.alias("verdict"))


@register("fuzzy_twins", """
SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 1 AND a.p_partkey < b.p_partkey""")
def fuzzy_twins(spark, sf):
    return it.near_names(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type"], "p_size", 1)


@register("prefix_twins", """
SELECT a.doc_id AS id, min(b.doc_id) AS twin FROM documents a JOIN documents b ON left(a.text, 20) = left(b.text, 20) AND length(b.text) > length(a.text) AND a.source = b.source GROUP BY 1""")
def prefix_twins(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 1, 20).alias("stem"), F.char_length("text").alias("n"))
    pairs = docs.alias("a").join(docs.alias("b"), ["source", "stem"]).filter("b.n > a.n")
    return pairs.groupBy(F.col("a.doc_id").alias("id")).agg(F.min("b.doc_id").alias("twin"))


@register("folder_variants", """
SELECT s AS signature, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, array_to_string(list_sort(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '' AND x <> 'x')), '+') AS s FROM part) GROUP BY 1 HAVING count(*) > 1""")
def folder_variants(spark, sf):
    return table(spark, sf, "part").groupBy(signature(F.col("p_name")).alias("signature")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


@register("connected_components", """
WITH RECURSIVE e AS (SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name = b.p_name AND abs(a.p_size - b.p_size) <= 3 AND a.p_partkey <> b.p_partkey),
r AS (SELECT DISTINCT x AS node, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON r.node = e.x) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def connected_components(spark, sf):
    return components(it.near_names(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type", "p_name"], "p_size", 3)).withColumnRenamed("root", "component")


@register("integrity_sweep", """
WITH c AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 10 = 1 THEN -1 WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 10 IN (1, 2, 3) THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 <> 0), l AS (SELECT doc_id, n_chars AS size, md5(text) AS h, doc_id % 10 = 4 AS flagged FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN l.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'missing' WHEN c.h = l.h AND flagged THEN 'restored' WHEN c.h = l.h THEN 'unchanged' WHEN c.size < l.size THEN 'truncated' WHEN c.size > l.size THEN 'grown' ELSE 'changed' END AS state FROM c FULL JOIN l USING (doc_id)""")
def integrity_sweep(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("size"), F.md5("text").alias("h"))
    r = F.col("doc_id") % 10
    now = docs.filter("doc_id % 7 <> 0").select("doc_id", (F.col("size") + F.when(r == 1, -1).when(r == 2, 1).otherwise(0)).alias("size"), F.when(r.isin(1, 2, 3), "x").otherwise(F.col("h")).alias("h"))
    return it.sweep(now, docs.filter("doc_id % 5 <> 0").withColumn("flagged", r == 4), "doc_id", "size", "h")


@register("checksum_ledger", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0")
def checksum_ledger(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    ledger = docs.filter("doc_id % 4 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 5).otherwise(F.col("n_chars")))
    return it.due_for_hash(docs, ledger, "doc_id", ["n_chars", "lang"]).select("doc_id")


@register("finding_states", """
SELECT o_orderkey, (b = 'open' AND a IN ('confirmed', 'dismissed')) OR (b = 'confirmed' AND a IN ('applied', 'failed', 'dismissed')) OR (b = 'failed' AND a = 'confirmed') OR (b = 'applied' AND a = 'archived') OR (b = 'dismissed' AND a IN ('archived', 'open')) AS ok
FROM (SELECT o_orderkey, ['open', 'confirmed', 'applied', 'dismissed', 'failed', 'archived'][o_orderkey % 6 + 1] AS b, ['confirmed', 'applied', 'archived', 'open'][o_orderkey % 4 + 1] AS a FROM orders)""")
def finding_states(spark, sf):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", it.allowed(pick(["open", "confirmed", "applied", "dismissed", "failed", "archived"]), pick(["confirmed", "applied", "archived", "open"])).alias("ok"))


@register("natural_key_repair", """
SELECT l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END DESC, l_shipdate, l_linenumber) AS rank FROM lineitem) WHERE rank > 1""")
def natural_key_repair(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(F.when(F.col("l_linestatus") == "F", 1).otherwise(0).desc(), "l_shipdate", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank > 1").select("l_orderkey", "l_linenumber", "rank")
