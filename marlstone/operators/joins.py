"""Joins whose plan follows a counted size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import materialise


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``most_rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_by_size(left: DataFrame, right: DataFrame, key: list[str], n: str = "n", how: str = "inner", least: int = 1000, most: int = 100_000) -> DataFrame:
    """Join with a side that has one row per key and, in ``n``, how many rows of ``left`` have it.

    Rows of heavy keys would all be shuffled to one task. Keys with more than ``least`` rows, and
    more than a ``most``-th of all rows, number at most ``most``: they are broadcast, and their rows
    stay where they are. All other keys are joined as usual. ``how`` is inner or left; ``left`` is
    read twice if any key is heavy. Null keys match nothing; with a left join, keep them out.
    """
    seen = right.agg(F.sum(n).alias("total"), F.max(n).alias("top")).first()
    heavy = max(least, (seen["total"] or 0) // most)
    if (seen["top"] or 0) <= heavy:
        return left.join(right.drop(n), key, how)
    hot = F.broadcast(right.filter(F.col(n) > heavy).drop(n))
    rest = left.join(hot.select(*key), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.filter(F.col(n) <= heavy).drop(n), key, how))


def spread_join(left: DataFrame, right: DataFrame, key: list[str], pairs: int = 20_000_000) -> DataFrame:
    """Inner join whose groups meet as pairs: tasks are as many as the counted pairs ask for, ``pairs`` each, whatever the size of the input.

    A group with more pairs than that is cut: its left rows are dealt in turn to salts, its right rows
    go to every salt.
    """
    sizes = left.groupBy(*key).agg(F.count("*").alias("__l")).join(right.groupBy(*key).agg(F.count("*").alias("__r")), key)
    cuts = sizes.select(*key, F.ceil(F.col("__l") * F.col("__r") / pairs).cast("int").alias("__cuts"))
    seen = sizes.agg(F.sum(F.col("__l") * F.col("__r")).alias("total"), F.max(F.col("__l") * F.col("__r")).alias("top")).first()
    tasks, on = -(-(seen["total"] or 1) // pairs), key
    if (seen["top"] or 0) > pairs:
        cuts = cuts.filter("__cuts > 1")
        wide = lambda df: df.join(cuts, key, "left").withColumn("__cuts", F.coalesce("__cuts", F.lit(1)))
        left = wide(left).withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.col("__cuts")).cast("int")).drop("__cuts")
        right = wide(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1))).drop("__cuts")
        on = [*key, "__salt"]
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).drop("__salt")


def cell_join(rows: DataFrame, group: list[str], key: str, columns: list[str], size: Column, side: int = 3_000) -> DataFrame:
    """Every two rows of a group once, in either order, and each with itself: ``columns`` and ``key`` of one, of the other as ``other_...``.

    Groups are cut into stripes of rows whose ``size`` adds up to about ``side``, and each two stripes
    meet in a cell of their own, so a row is sent once a stripe; tasks are as many as the pairs, counted
    by ``size``, ask for. Two rows of one key meet in one order or both. Nulls in ``group`` match
    nothing. ``rows`` is read three times.
    """
    sizes = rows.groupBy(*group).agg(F.sum(size).alias("n"))
    total = sizes.agg(F.sum(F.col("n") * F.col("n")).alias("t")).first()["t"] or 1
    large = small_side(sizes.filter(F.col("n") > side).select(*group, F.ceil(F.col("n") / side).alias("of")), 100_000)
    placed = rows.join(large, group, "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("at", F.pmod(F.xxhash64(key), "of"))
    tasks, on = -(-total // (2 * side * side)), [*group, "i", "j"]
    left = placed.select(*group, key, *columns, F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("of") - 1)).alias("j"))
    right = placed.select(*group, *[F.col(c).alias(f"other_{c}") for c in (key, *columns)], F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"))
    # Merged, as a hash table is slow where a key has thousands of rows.
    met = left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on)
    return met.filter((F.col("i") < F.col("j")) | (F.col(key) <= F.col(f"other_{key}"))).drop("i", "j")


def block_pairs(df: DataFrame, group: list[str], alike: list[str], row: str, most: int = 256, side: int = 3_000) -> DataFrame:
    """Every two rows of a group once, as pairs of blocks: ``x, y`` (structs of ``alike``), ``p, q`` (arrays of ``row``, whose nulls go), ``same``.

    A block holds about ``most`` rows that agree in ``alike``, so what follows from ``x`` and ``y`` is
    worked out once for all pairs of two blocks; :func:`unpacked` gives the rows. A block meets itself
    with ``same``. Blocks meet by :func:`cell_join`.
    """
    rows = df.dropna(subset=group).select(*group, F.struct(*alike).alias("x"), F.col(row).alias("r"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    full = rows.groupBy(*group, "x").agg(F.count("*").alias("n")).filter(F.col("n") > most).withColumn("of", F.ceil(F.col("n") / most)).drop("n")
    dealt = rows.join(small_side(full, 100_000), [*group, "x"], "left").withColumn("part", F.pmod("deal", F.coalesce("of", F.lit(1))))
    packed = dealt.groupBy(*group, "x", "part").agg(F.collect_list("r").alias("p")).withColumn("id", F.monotonically_increasing_id())
    met = cell_join(materialise(packed.select(*group, "x", "p", "id")), group, "id", ["x", "p"], F.size("p"), side)
    return met.select(*group, "x", F.col("other_x").alias("y"), "p", F.col("other_p").alias("q"), (F.col("id") == F.col("other_id")).alias("same"))


def unpacked(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """The pairs of rows of :func:`block_pairs` as ``a < b``, with ``keep`` of their blocks."""
    both = blocks.select(*keep, "q", "same", F.explode("p").alias("p")).select(*keep, "same", "p", F.explode("q").alias("q"))
    pairs = both.filter((F.col("p") < F.col("q")) | (~F.col("same") & (F.col("p") > F.col("q"))))
    return pairs.select(*keep, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
