"""Queries of the file checks, over stand-ins: every document is a file and a row of the collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import hygiene as hy
from marlstone.plans.catalog import register, table

_FILE = "concat('/vol/', source, '/', CASE WHEN doc_id % 50 = 0 THEN concat('._', doc_id) WHEN doc_id % 53 = 0 THEN concat(doc_id, '.tmp') ELSE concat('D', doc_id) END)"
_FP = "md5(coalesce(text, ''))"
_FOLDER = f"CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 3 = 0 THEN concat('/vol/old/', doc_id) WHEN doc_id % 7 = 0 THEN concat('/other/', doc_id) ELSE lower({_FILE}) END"
_FILES = f"{_FILE} AS path, CASE WHEN doc_id % 41 = 0 THEN 0 ELSE n_chars END AS bytes, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {_FP} END AS fp"
_ROWS = f"doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('t', doc_id) END AS title, {_FOLDER} AS folder, CASE WHEN doc_id % 5 = 0 THEN md5(concat('gone', doc_id)) WHEN doc_id % 4 <> 1 THEN {_FP} END AS fp"


def _both(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.selectExpr(*_split(_FILES)), docs.selectExpr(*_split(_ROWS))


def _split(columns: str) -> list[str]:
    """The columns of a SELECT list; commas inside brackets do not part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_WITH = f"""
WITH f AS (SELECT {_FILES} FROM documents), r AS (SELECT {_ROWS} FROM documents),
j AS (SELECT path FROM f WHERE regexp_matches(path, '/(\\._[^/]*|\\.DS_Store|\\.hygiene-[^/]*|[^/]*\\.tmp)$')), w AS (SELECT * FROM f WHERE path NOT IN (SELECT path FROM j)),
g AS (SELECT bytes, fp, min(path) AS keeper FROM w WHERE bytes > 0 AND fp IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1), tw AS (SELECT path, keeper FROM w JOIN g USING (bytes, fp)),
d AS (SELECT * FROM r WHERE folder LIKE '/vol/%' AND lower(folder) NOT IN (SELECT lower(path) FROM w)),
m AS (SELECT fp, min(path) AS path FROM w WHERE fp IS NOT NULL GROUP BY 1),
st AS (SELECT path, id, folder FROM (SELECT m.path, d.id, d.folder, row_number() OVER (PARTITION BY m.path ORDER BY d.id) AS n FROM d JOIN m USING (fp)) WHERE n = 1),
o AS (SELECT w.path, CASE WHEN fp IS NULL THEN 'path-only' ELSE 'path+fp' END AS detail FROM w WHERE path NOT IN (SELECT path FROM st) AND lower(path) NOT IN (SELECT lower(folder) FROM r WHERE folder <> '') AND (fp IS NULL OR fp NOT IN (SELECT fp FROM r WHERE fp IS NOT NULL))),
rd AS (SELECT folder, id, title FROM d WHERE title <> '' AND (fp IS NULL OR fp NOT IN (SELECT fp FROM w WHERE fp IS NOT NULL)))
"""


@register("check_junk", _WITH + "SELECT 'junk' AS kind, path, NULL::VARCHAR AS row_id, NULL::VARCHAR AS detail FROM j")
def check_junk(spark, sf):
    return hy.junk(_both(spark, sf)[0])


@register("check_zero_byte", _WITH + "SELECT 'zero-byte' AS kind, path, NULL::VARCHAR AS row_id, NULL::VARCHAR AS detail FROM f WHERE bytes = 0")
def check_zero_byte(spark, sf):
    return hy.zero_byte(_both(spark, sf)[0])


@register("check_stale_pointer", _WITH + "SELECT 'stale-pointer' AS kind, path, id::VARCHAR AS row_id, folder AS detail FROM st")
def check_stale_pointer(spark, sf):
    files, rows = _both(spark, sf)
    return hy.stale_pointers(files.filter(~hy.is_junk(F.col("path"))), rows, "/vol")


@register("check_orphan_audio", _WITH + "SELECT 'orphan-audio' AS kind, path, NULL::VARCHAR AS row_id, detail FROM (SELECT w.path, CASE WHEN fp IS NULL THEN 'path-only' ELSE 'path+fp' END AS detail FROM w WHERE lower(path) NOT IN (SELECT lower(folder) FROM r WHERE folder <> '') AND (fp IS NULL OR fp NOT IN (SELECT fp FROM r WHERE fp IS NOT NULL)))")
def check_orphan_audio(spark, sf):
    files, rows = _both(spark, sf)
    return hy.orphans(files.filter(~hy.is_junk(F.col("path"))), rows)


@register("check_re_download", _WITH + "SELECT 're-download' AS kind, folder AS path, id::VARCHAR AS row_id, title AS detail FROM rd")
def check_re_download(spark, sf):
    files, rows = _both(spark, sf)
    return hy.re_downloads(files.filter(~hy.is_junk(F.col("path"))), rows, "/vol")


@register("checks_in_order", _WITH + """
SELECT * FROM (SELECT 'junk' AS kind, path, NULL::VARCHAR AS row_id, NULL::VARCHAR AS detail, 'safe' AS severity FROM j UNION ALL SELECT 'byte-twin', path, NULL, keeper, 'certain' FROM tw
UNION ALL SELECT 'zero-byte', path, NULL, NULL, 'likely' FROM w WHERE bytes = 0 AND path NOT IN (SELECT path FROM tw) UNION ALL SELECT 'stale-pointer', path, id::VARCHAR, folder, 'review' FROM st
UNION ALL SELECT 'orphan-audio', path, NULL, detail, 'info' FROM o UNION ALL SELECT 're-download', folder, id::VARCHAR, title, 'review' FROM rd)""")
def checks_in_order(spark, sf):
    return hy.run_checks(*_both(spark, sf), "/vol")
