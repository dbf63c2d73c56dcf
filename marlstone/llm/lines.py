"""Operator 2: line dedup by distinct-site spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import row_key
from marlstone.operators.joins import join_by_size
from marlstone.session import materialise


def _line_key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(17), line).alias("h2"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), F.trim)


def spread_lines(df: DataFrame, text_col: str, site_col: str, min_sites: int, min_chars: int, log_buckets: int = 12) -> DataFrame:
    """``(h1, h2, n)`` of the lines that stand on at least ``min_sites`` distinct sites, ``n`` times in all.

    A HyperLogLog sketch of the sites is kept per line and merged by partial aggregation, so a
    line on every page reaches its reducer as one sketch per task. Estimates more than three
    standard errors from the threshold decide; lines between get an exact distinct count.
    """
    line = F.explode(_lines(F.col(text_col))).alias("line")
    seen = df.select(F.col(site_col).cast("string").alias("site"), line).filter(F.char_length("line") >= min_chars).select(_line_key(F.col("line")).alias("k"), "site").select("k.h1", "k.h2", "site")
    error = 3 * 1.04 / 2 ** (log_buckets / 2)
    low, high = min_sites * (1 - error), min_sites * (1 + error)
    sketched = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.count("site").alias("known"), F.hll_sketch_agg("site", F.lit(log_buckets)).alias("s")).filter(F.col("known") >= min_sites)
    judged = materialise(sketched.select("h1", "h2", "n", F.hll_sketch_estimate("s").alias("sites")).filter(F.col("sites") >= low))
    close = judged.filter(F.col("sites") <= high).select("h1", "h2", "n")
    sites = join_by_size(seen, close, ["h1", "h2"], least=5000)
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return materialise(judged.filter(F.col("sites") > high).select("h1", "h2", "n").unionByName(exact.select("h1", "h2", "n")))


def remove_boilerplate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_chars: int = 8) -> DataFrame:
    """``df`` with the lines taken out that stand on ``min_sites`` sites or more.

    Adds ``n_lines, n_removed, mirrored`` (any columns of these names in ``df`` give way). Lines
    are compared trimmed of spaces; those under ``min_chars`` never count. A document that holds
    nothing but such lines and blank ones is a copy of a page rather than a page with boilerplate:
    it is ``mirrored``, stays as it is, and is left to near-dedup.

    A null text stays null with 0 lines. A null site counts for no line. Repeated rows are
    treated alike; null ids are allowed; an empty table gives an empty one. A very long text is one
    array of lines in its task.
    """
    df = df.drop("n_lines", "n_removed", "mirrored")
    boilerplate = spread_lines(df, text_col, site_col, min_sites, min_chars)
    key = row_key(id_col, text_col)
    placed = df.select(*key, F.posexplode(_lines(F.col(text_col))).alias("at", "line")).filter(F.char_length("line") >= min_chars)
    occurring = placed.select("__k1", "__k2", "at", _line_key(F.col("line")).alias("k")).select("__k1", "__k2", "at", "k.h1", "k.h2")
    hits = join_by_size(occurring, boilerplate, ["h1", "h2"], least=5000).groupBy("__k1", "__k2").agg(F.collect_set("at").alias("__gone"))
    joined = df.select("*", *key).join(hits, ["__k1", "__k2"], "left")
    lines = F.split(F.col(text_col), "\n")
    # Kept by place, the places found by hashing: no line is compared with all lines that go.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    # Exploded, so that the split is not written into the lambda below and done anew for every line.
    joined = joined.select("*", F.explode(F.array(F.when(F.col("__gone").isNotNull(), lines))).alias("__lines"))
    kept = F.transform(left, lambda i: F.get("__lines", i))
    out = joined.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    whole = ~F.exists("__kept", lambda x: F.regexp_like(x, F.lit("\\S")))
    mirrored = F.coalesce(F.col("__kept").isNotNull() & whole, F.lit(False))
    out = out.withColumn("mirrored", mirrored)
    change = F.col("__kept").isNotNull() & ~F.col("mirrored")
    text = F.when(change, F.array_join("__kept", "\n")).otherwise(F.col(text_col))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    out = out.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines), "n_removed": F.when(change, n_lines - F.size("__kept")).otherwise(0), "__text": text})
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(c) for c in df.columns], "n_lines", "n_removed", "mirrored")
