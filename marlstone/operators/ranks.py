"""Running sums over a whole column without one task that holds it: ranges of the value, then offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import materialise


def cumulative(counts: DataFrame, value: str, n: str, name: str, total: str, keys: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """``name``: the sum of ``n`` over the rows of the key up to this value, itself included; ``total``: over all its rows.

    ``counts`` has one row per key and distinct value; nulls come first. Approximate quantiles, at
    most ``ranges`` numbers on the driver, cut the values into ranges; each range is summed on its
    own and the sums of the ranges below are added, so the result is exact wherever the cuts lie.
    """
    keys = keys or []
    cuts = counts.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first().c
    place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    rows = counts.withColumn("__range", place)
    inner = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__within", F.sum(n).over(inner))
    whole = Window.partitionBy(*keys)
    below = F.sum("__s").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*keys, "__range").agg(F.sum(n).alias("__s")).select(*keys, "__range", F.coalesce(below, F.lit(0)).alias("__off"), F.sum("__s").over(whole).alias(total))
    return rows.join(offsets, [*keys, "__range"]).withColumn(name, F.col("__within") + F.col("__off")).drop("__range", "__within", "__off")


def _sorted_ranges(df: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """``df`` sorted by key and order over range partitions, written: ``__part`` and the place ``__at`` in it."""
    cols = {f"__o{i}": o for i, o in enumerate(order)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc() for k in keys], *[F.col(c).asc() for c in cols]]
    laid = df.withColumns(cols).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(laid.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")).drop(*cols))


def number_rows(df: DataFrame, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 in an ascending order, anew for every key; equal rows in any order.

    A sort over ranges gives each row its place in its partition; one small table of how many rows of
    a key the partitions before hold does the rest. No task has more than its range, and a key that
    holds most rows spreads over many.
    """
    keys = keys or []
    rows = _sorted_ranges(df, order, keys)
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__off"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(offsets, same).withColumn(name, (F.col("__at") + F.col("__off")).cast("long")).select(*df.columns, name)


def running_max(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the largest value up to each row in an order, over ranges like :func:`number_rows`."""
    rows = _sorted_ranges(df, order, [])
    tops = rows.groupBy("__part").agg(F.max(value).alias("__top"))
    below = F.max("__top").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    within = F.max(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("__in", within).join(tops.select("__part", below.alias("__below")), "__part")
    return found.withColumn(name, F.greatest("__in", "__below")).select(*df.columns, name)
