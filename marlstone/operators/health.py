"""Health checks as rows, their rollup and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ("pass", "warn", "fail")


def status(value: Column, warn: Column, fail: Column) -> Column:
    return F.when(fail, "fail").when(warn, "warn").when(value.isNull(), "warn").otherwise("pass")


def rollup(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The worst status of each group: fail over warn over pass."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col(column)).cast("int")
    return df.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, RANKS)), F.max(rank)).alias("overall"), *[F.count_if(F.col(column) == s).alias(s) for s in RANKS])


def deltas(now: DataFrame, before: DataFrame, key: str, column: str) -> DataFrame:
    """Checks that changed, appeared or went since the previous report."""
    both = now.select(key, F.col(column).alias("now")).join(before.select(key, F.col(column).alias("before")), key, "full_outer")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("before"), "changed").otherwise("same")
    return both.select(key, kind.alias("delta"))


def regressions(df: DataFrame, key: str, order: list[str], value: str, drop: float = 0.4) -> DataFrame:
    """Measurements that fell by more than ``drop`` against the row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("before", before).filter((F.col("before") > 0) & (F.col(value) < (1 - drop) * F.col("before")))


def phantoms(jobs: DataFrame, now: Column, quiet: float = 120, grace: float = 60) -> DataFrame:
    """``id, error`` of active jobs ``(id, status, started, touched, held)`` that nobody holds or has touched for ``quiet`` seconds and that began ``grace`` before that."""
    cutoff = now - quiet
    lost = F.col("status").isin("queued", "running") & (F.col("started") < cutoff - grace) & (F.coalesce("touched", F.lit(0)) < cutoff) & ~F.coalesce("held", F.lit(False))
    return jobs.filter(lost).select("id", F.lit("completion never delivered").alias("error"))


def stalled(jobs: DataFrame, now: Column, minutes: float) -> DataFrame:
    """``id, idle`` (seconds) of running jobs whose last progress, or start, lies longer back than that."""
    last = F.greatest(F.coalesce("moved", F.lit(0)), F.coalesce("started", F.lit(0)))
    return jobs.filter((F.col("status") == "running") & (last > 0) & (last < now - 60 * minutes)).select("id", (now - last).alias("idle"))


def feed(events: DataFrame, key: str, order: list[str], since: int, cap: int = 2000) -> DataFrame:
    """The last ``cap`` events of each key behind the cursor ``since``, with ``place`` from 1 and ``next``, the cursor to come back with; a cursor beyond the end starts over."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    kept = events.withColumn("__back", back).filter(F.col("__back") <= cap)
    kept = kept.withColumn("next", F.max("__back").over(Window.partitionBy(key))).withColumn("place", F.col("next") - F.col("__back") + 1)
    return kept.filter((F.col("place") > since) | (F.col("next") < since)).drop("__back")


def mount_events(before: DataFrame, now: DataFrame, key: str, label: str) -> DataFrame:
    """``key, kind``: what two snapshots of mounted volumes differ by: mounted, unmounted, or relabelled under the same key."""
    both = before.select(key, F.col(label).alias("__b"), F.lit(1).alias("__x")).join(now.select(key, F.col(label).alias("__n"), F.lit(1).alias("__y")), key, "full")
    kind = F.when(F.col("__x").isNull(), "mounted").when(F.col("__y").isNull(), "unmounted").when(~F.col("__b").eqNullSafe(F.col("__n")), "relabelled")
    return both.select(key, kind.alias("kind")).filter("kind is not null")
