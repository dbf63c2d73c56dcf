"""The registered queries of the training-data operators: thin forms that follow their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontam, divergence, filter_audit, langid, licenses, lines, media, mixing, neardup, quality, secrets, substrings
from marlstone.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "mirrored", F.md5(F.col("text").cast("binary")).alias("text_md5"))


LINE_SQL = """
WITH l AS (SELECT doc_id, source, trim(u.x, ' ') AS line, u.x AS raw, u.i FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i) u),
b AS (SELECT line FROM l WHERE length(line) >= 8 GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS hit, coalesce(bool_or(b.line IS NULL AND regexp_matches(raw, '\\S')), false) AS own, string_agg(raw, chr(10) ORDER BY i) FILTER (b.line IS NULL) AS rest FROM l LEFT JOIN b USING (line) GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN own THEN coalesce(hit, 0) ELSE 0 END AS n_removed,
  coalesce(hit > 0 AND NOT own, false) AS mirrored, md5(CASE WHEN hit > 0 AND own THEN coalesce(rest, '') ELSE text END) AS text_md5
FROM documents LEFT JOIN m USING (doc_id)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return quality.score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_table(spark, sf_dir, "documents")).drop("k")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), params=neardup.Params(words=4))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


DECONTAM_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(list_slice(ws, s, s + least(13, len(ws)) - 1), ' ') AS win FROM i, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS s) u WHERE len(ws) > 0),
p AS (SELECT doc_id, ws, k.k, unnest(range(1, len(ws) - k.k + 2)) AS s FROM d, (SELECT DISTINCT k FROM w) k WHERE len(ws) >= k.k),
h AS (SELECT doc_id, s, p.k, item_id FROM p JOIN w ON p.k = w.k AND array_to_string(list_slice(ws, s, s + p.k - 1), ' ') = win),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(_table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan_spans(docs)
    kinds = F.array(*map(F.lit, secrets.KINDS))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: F.array_position(kinds, x["kind"]) <= 3)
    joined = lambda xs: F.concat_ws(",", F.transform(xs, label))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


#: The vocabulary of op11: a file that the driver reads.
VOCABULARY = "byte_bpe_50k.json"


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = bpe.load_tokenizer(public_tokenizers.path(VOCABULARY))
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, p.bit AS b1, q.bit AS b2, r.bit AS b3, s.bit AS b4, t.bit AS b5 FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
k AS (SELECT filter_order, 1 AS step, b1 AS own, 0 AS early FROM o UNION ALL SELECT filter_order, 2, b2, b1 FROM o UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM o UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM o UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM o),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER ((failed & (own | early)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER ((failed & own) > 0 AND (failed & early) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((failed & own) > 0 AND (failed & early) > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER ((failed & own) > 0 AND (failed & early) = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER ((failed & own) > 0 AND (failed & early) = 0), 0)::BIGINT AS toxic_lost
  FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM (SELECT row, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM w GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(w.n, 0) AS n, k.n AS lang_n FROM g JOIN kept k USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term),
s AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
  1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM c),
v AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_quality, op4_langid, op5_licenses, op6_substrings, op7_neardup, op8_decontam, op9_media, op10_secrets, op11_bpe, op12_filter_audit, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_SQL, "op8_decontam": DECONTAM_SQL, "op12_filter_audit": AUDIT_SQL, "op13_divergence": DIVERGENCE_SQL}
