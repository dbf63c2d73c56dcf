"""Counts, histograms, coverage and audits. All aggregate on the map side before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up


def conditional_census(df: DataFrame, key: Column, name: str, measures: dict[str, Column], limit: int | None = None) -> DataFrame:
    """Rows per key with a sum for each condition; the ``limit`` largest keys where one is given."""
    out = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in measures.items()])
    return out.orderBy(F.desc("n"), name).limit(limit) if limit else out


def top_per_kind(df: DataFrame, kind: str, reason: str, n: int) -> DataFrame:
    """The total of each kind and its ``n`` most frequent reasons."""
    counts = df.groupBy(kind, reason).agg(F.count("*").alias("rows"))
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("rows"), reason))
    total = F.sum("rows").over(Window.partitionBy(kind))
    return counts.withColumns({"total": total, "rank": rank.cast("long")}).filter(F.col("rank") <= n)


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    """Rows per fixed-width bucket, named by its lower edge."""
    return df.groupBy((F.floor(value / width) * width).cast("double").alias("bucket")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, path: str, place: str, title: str, least: int = 2) -> DataFrame:
    """Distinct places per path, and whether they are fewer than ``least``. The title is the least non-null one."""
    out = df.groupBy(path).agg(F.countDistinct(place).alias("copies"), F.min(title).alias("title"))
    return out.withColumn("at_risk", F.col("copies") < least)


def redundancy(entries: DataFrame, covered: DataFrame, lists: str, path: str, least: int = 2) -> DataFrame:
    """A verdict per list: fail if an entry has no copy, warn if one has too few, unknown if it is empty."""
    joined = entries.join(covered.select(path, "copies"), path, "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    out = joined.groupBy(lists).agg(F.count("*").alias("entries"), F.count_if(F.col("copies") == 0).alias("gaps"), F.count_if((F.col("copies") > 0) & (F.col("copies") < least)).alias("single"))
    verdict = F.when(F.col("entries") == 0, "unknown").when(F.col("gaps") > 0, "fail").when(F.col("single") > 0, "warn").otherwise("pass")
    return out.withColumn("verdict", verdict)


def collisions(df: DataFrame, path: str) -> DataFrame:
    """Distinct paths that differ only by case."""
    groups = df.select(path).distinct().groupBy(F.lower(path).alias("folded")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(path)).alias("paths"))
    return groups.filter("n > 1")


def differing(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields that differ, compared trimmed and in lower case; one missing side is no difference."""
    clean = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return F.filter(F.array(*[F.when(clean(a[k]) != clean(b[k]), F.lit(k)) for k in a]), lambda x: x.isNotNull())


def majority(df: DataFrame, group: str, label: str, least_rows: int, share: float) -> DataFrame:
    """The label of each group that at least ``share`` of its ``least_rows`` or more labelled rows carry."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(group)
    ranked = counts.withColumns({"rows": F.sum("votes").over(w), "__r": F.row_number().over(w.orderBy(F.desc("votes"), label))})
    return ranked.filter((F.col("__r") == 1) & (F.col("rows") >= least_rows) & (F.col("votes") >= share * F.col("rows"))).select(group, label, "votes", "rows")


def contracts(df: DataFrame, checks: list[tuple[str, Column, float]]) -> DataFrame:
    """``name, measured, threshold, pass`` of aggregate checks; a check passes at its threshold or above."""
    row = df.agg(*[round_up(c.cast("double"), 4).alias(f"m{i}") for i, (_, c, _) in enumerate(checks)])
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m{i}").alias("measured"), F.lit(float(t)).alias("threshold")) for i, (n, _, t) in enumerate(checks)])
    return row.select(F.inline(cells)).withColumn("pass", F.col("measured") >= F.col("threshold"))


def canonical_json(columns: dict[str, Column]) -> Column:
    """A JSON text that does not depend on the order of its keys."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))
