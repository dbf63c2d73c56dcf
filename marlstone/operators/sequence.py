"""Ordered rows of a key: moving means, islands, transitions, fits, folds over state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_mean(df: DataFrame, key: str, order: list[str], value: str, width: int, name: str = "mean") -> DataFrame:
    """The mean of each full frame of ``width`` rows from this one on; nulls in it are left out."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(0, width - 1)
    return df.withColumns({name: F.avg(value).over(w), "__n": F.count(F.lit(1)).over(w)}).filter(F.col("__n") == width).drop("__n")


def islands(df: DataFrame, key: str, order: list[str], code: str) -> DataFrame:
    """Runs of equal codes: ``key, island, code, start, length`` with positions from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumns({"__pos": F.row_number().over(w) - 1, "__new": (~F.lag(code).over(w).eqNullSafe(F.col(code)) | (F.row_number().over(w) == 1)).cast("int")})
    marked = numbered.withColumn("island", F.sum("__new").over(w))
    return marked.groupBy(key, "island").agg(F.first(code).alias(code), F.min("__pos").cast("long").alias("start"), F.count("*").alias("length"))


def transitions(df: DataFrame, key: str, order: list[str], item: str, time: Column, most: float) -> DataFrame:
    """Counts of (item, next item) with a gap above 0 and at most ``most``, for differing items."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = df.select(F.col(item).alias("a"), F.lead(item).over(w).alias("b"), (F.lead(time).over(w) - time).alias("gap"))
    return pairs.filter((F.col("gap") > 0) & (F.col("gap") <= most) & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def sessions(df: DataFrame, key: str, order: list[str], time: Column, gap: float) -> DataFrame:
    """Rows with the number of their session: a gap over ``gap`` begins a new one."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((time - F.lag(time).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def tempo_fit(df: DataFrame, key: str, order: list[str], time: str) -> DataFrame:
    """Least squares of time on its index for keys with 4 rows or more and a span: step, start, residual (n divisor).

    One pass: the residual follows from the sums of squares.
    """
    w = Window.partitionBy(key).orderBy(*order)
    indexed = df.select(key, F.col(time).alias("__t"), (F.row_number().over(w) - 1).cast("double").alias("__i"))
    out = indexed.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("__t", "__i").alias("step"), F.regr_intercept("__t", "__i").alias("start"), F.regr_syy("__t", "__i").alias("__yy"), F.regr_r2("__t", "__i").alias("__r2"), (F.max("__t") - F.min("__t")).alias("__span"))
    return out.filter((F.col("n") >= 4) & (F.col("__span") > 0)).withColumn("residual", F.sqrt(F.greatest(F.col("__yy") * (1 - F.col("__r2")) / F.col("n"), F.lit(0.0)))).select(key, "n", "step", "start", "residual")


def full_frame_peak(df: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """The frame with the highest mean (the earliest on ties), its mean, and its contrast to the rest."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.select(key, *order, F.col(value).alias("__v"), (F.row_number().over(w) - 1).cast("long").alias("__pos"))
    means = moving_mean(numbered, key, ["__pos"], "__v", width, "__m")
    best = means.groupBy(key).agg(F.max(F.struct("__m", (-F.col("__pos")).alias("p"))).alias("b")).select(key, F.col("b.__m").alias("peak"), (-F.col("b.p")).alias("start"))
    inside = F.col("__pos").between(F.col("start"), F.col("start") + width - 1)
    out = numbered.join(best, key).groupBy(key, "peak", "start").agg(F.avg(F.when(~inside, F.col("__v"))).alias("rest"))
    return out.select(key, "start", "peak", (F.col("peak") - F.coalesce("rest", F.lit(0.0))).alias("contrast"))


def arc(df: DataFrame, key: str, order: list[str], value: str, dead: float = 0.05) -> DataFrame:
    """Inflections and the shape of a series, by the means of its quarters.

    A step within ``dead`` has no direction; each change against the last direction is an
    inflection. Shapes in order: rollercoaster (4 or more inflections), buildup, drop, valley, plateau.
    """
    w = Window.partitionBy(key).orderBy(*order)
    step = F.col(value) - F.lag(value).over(w)
    rows = df.withColumns({"__dir": F.when(step > dead, 1).when(step < -dead, -1), "__quarter": F.ntile(4).over(w)})
    rows = rows.withColumn("__prev", F.last("__dir", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    quarter = lambda q: F.avg(F.when(F.col("__quarter") == q, F.col(value)))
    out = rows.groupBy(key).agg(F.count_if(F.col("__dir").isNotNull() & F.col("__prev").isNotNull() & (F.col("__dir") != F.col("__prev"))).alias("inflections"), *[quarter(q).alias(f"q{q}") for q in range(1, 5)])
    mid = (F.col("q2") + F.col("q3")) / 2
    shape = F.when(F.col("inflections") >= 4, "rollercoaster").when(F.col("q4") - F.col("q1") > 0.2, "buildup").when(F.col("q4") - F.col("q1") < -0.2, "drop").when((mid < F.col("q1") - 0.1) & (mid < F.col("q4") - 0.1), "valley").otherwise("plateau")
    return out.select(key, "inflections", shape.alias("shape"))


def novelty_phrases(df: DataFrame, key: str, order: list[str], drop: Column, threshold: float, least: int) -> DataFrame:
    """Phrase starts: position 0, and each row whose ``drop`` is over the threshold at ``least`` rows or more since the last.

    The state (last start) is folded over the key's ordered rows.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, (F.row_number().over(w) - 1).alias("__pos"), drop.alias("__d"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__pos", F.coalesce("__d", F.lit(0.0)).alias("d")))).alias("__rows"))

    def add(starts: Column, r: Column) -> Column:
        far = r["__pos"] - F.element_at(starts, -1) >= least
        return F.when((r["d"] > threshold) & far, F.concat(starts, F.array(r["__pos"]))).otherwise(starts)

    return listed.select(key, F.aggregate("__rows", F.array(F.lit(0)), add).alias("starts"))


def spaced_peaks(df: DataFrame, key: str, order: list[str], score: str, n: int, gap: int) -> DataFrame:
    """The ``n`` best positions of a key that lie ``gap`` or more apart, best first, ties to the earlier."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, (F.row_number().over(w) - 1).alias("pos"), F.col(score).alias("s"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "pos"))).alias("rows"))

    def add(taken: Column, r: Column) -> Column:
        free = (F.size(taken) < n) & ~F.exists(taken, lambda t: F.abs(t - r["pos"]) < gap)
        return F.when(free, F.concat(taken, F.array(r["pos"]))).otherwise(taken)

    return listed.select(key, F.aggregate("rows", F.array().cast("array<int>"), add).alias("peaks"))


def every_nth(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Every ``n``-th row of a key from the first, if ``n`` rows follow; every fourth of them is marked."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "__n": F.count("*").over(Window.partitionBy(key))})
    return rows.filter((F.col("pos") % n == 0) & (F.col("pos") + n <= F.col("__n"))).withColumn("major", F.col("pos") % (4 * n) == 0).drop("__n")
