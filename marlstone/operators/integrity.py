"""Duplicates, keepers, sweeps against a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.relational import band_join


def twins(df: DataFrame, size: str, digest: Column, order: list[Column]) -> DataFrame:
    """Rows of equal content with their place in the group: 1 keeps, the rest lose.

    Two stages: only rows whose size occurs twice are hashed.
    """
    repeated = df.groupBy(size).agg(F.count("*").alias("__n")).filter("__n > 1").select(size)
    hashed = df.join(repeated, size, "left_semi").withColumn("digest", digest)
    many = hashed.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1")
    place = F.row_number().over(Window.partitionBy("digest").orderBy(*order))
    return hashed.join(many, "digest").withColumn("place", place.cast("long"))


def keepers(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``keep`` marks the best row of each group by an order of criteria that ends with a unique one."""
    return df.withColumn("keep", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)


def severity(delta: Column) -> Column:
    """How far two copies' sizes differ, relative to the larger."""
    return F.when(delta < 0.005, "certain").when(delta < 0.03, "likely").when(delta < 0.15, "possible").otherwise("unlikely")


def judge(md5_equal: Column, fingerprint_equal: Column, quality_a: Column, quality_b: Column) -> Column:
    """The verdict on a pair: equal bytes, equal sound, or the better quality."""
    return F.when(md5_equal, "identical").when(~fingerprint_equal, "different").when(quality_a > quality_b, "keep-original").when(quality_a < quality_b, "keep-twin").otherwise("equal")


def sweep(current: DataFrame, ledger: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """The state of every file against its last known good: unchanged, changed, truncated, grown, missing, new, restored.

    ``ledger`` has also ``flagged`` (its last state was bad).
    """
    c = current.select(F.col(key), F.col(size).alias("__s"), F.col(digest).alias("__d"))
    old = ledger.select(F.col(key), F.col(size).alias("__os"), F.col(digest).alias("__od"), F.col("flagged").alias("__f"))
    both = c.join(old, key, "full_outer")
    same = F.col("__d") == F.col("__od")
    state = F.when(F.col("__od").isNull(), "new").when(F.col("__d").isNull(), "missing").when(same & F.col("__f"), "restored").when(same, "unchanged").when(F.col("__s") < F.col("__os"), "truncated").when(F.col("__s") > F.col("__os"), "grown").otherwise("changed")
    return both.select(key, state.alias("state"))


def due_for_hash(current: DataFrame, ledger: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that are new or differ from the ledger in any of the cheap columns; only these are hashed again."""
    old = ledger.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__known"))
    differ = F.col("__known").isNull()
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return current.join(old, key, "left").filter(differ).select(*current.columns)


def near_names(df: DataFrame, key: str, block: list[str], value: str, width: float) -> DataFrame:
    """Pairs of a block whose values lie within ``width``: ``a, b`` with a < b."""
    left = df.select(*block, F.col(key).alias("a"), F.col(value).alias("__va"))
    right = df.select(*block, F.col(key).alias("b"), F.col(value).alias("__vb"))
    return band_join(left, right, "__va", "__vb", width, block, spread=True).filter("a < b").select("a", "b")


TRANSITIONS = {"open": ("confirmed", "dismissed"), "confirmed": ("applied", "failed", "dismissed"), "failed": ("confirmed",), "applied": ("archived",), "dismissed": ("archived", "open")}


def allowed(before: Column, after: Column) -> Column:
    """True if a finding may go from one status to the other."""
    out = F.lit(False)
    for status, nexts in TRANSITIONS.items():
        out = out | ((before == status) & after.isin(*nexts))
    return out
