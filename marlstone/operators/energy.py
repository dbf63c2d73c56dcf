"""Percentiles against frozen references, bands, composites and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.operators.evalstats import cohen_d, spearman
from marlstone.operators.ranks import cumulative


def nearest_rank(value: Column, run: Column, n: Column, p: float) -> Column:
    """Aggregate: the value at place floor(n * p) from 0, given the running count of each distinct value."""
    return F.min(F.when(run > F.floor(n * p), value))


def percentile_rank(df: DataFrame, value: str, name: str, keys: list[str] | None = None, inverted: bool = False) -> DataFrame:
    """Share of rows at or below the value, counted over distinct values (one row each), per key."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    below = F.col("__run") / F.col("__all")
    ranked = cumulative(counts, value, "__n", "__run", "__all", keys).select(*keys, value, (1 - below if inverted else below).alias(name))
    return df.join(ranked, [*keys, value])


def family_percentile(df: DataFrame, family: str, value: str, least: int = 300) -> DataFrame:
    """Percentile within the family where it has ``least`` rows, else among all; and its band 1 to 9."""
    both = percentile_rank(percentile_rank(df, value, "__g"), value, "__f", [family])
    sizes = df.groupBy(family).agg(F.count("*").alias("__size"))
    p = F.when(F.col("__size") >= least, F.col("__f")).otherwise(F.col("__g"))
    return both.join(sizes, family).withColumn("percentile", p).withColumn("band", band(p)).drop("__g", "__f", "__size")


def band(p: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(9), F.ceil(p * 9))).cast("int")


def decile_cuts(df: DataFrame, value: str) -> DataFrame:
    """Cut points at the deciles by nearest rank: one row, ``cuts``. Nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    runs = cumulative(counts, value, "__n", "__run", "__all")
    return runs.agg(F.array(*[nearest_rank(F.col(value), F.col("__run"), F.col("__all"), i / 10) for i in range(1, 9)]).alias("cuts"))


def band_of(value: Column, cuts: Column) -> Column:
    """The first band whose cut reaches the value; the ninth takes the rest."""
    return (F.size(F.filter(cuts, lambda c: c < value)) + 1).cast("int")


def dead_signals(df: DataFrame, signals: list[str], least: float = 0.02) -> DataFrame:
    """``signal, iqr, dead``: quartiles by nearest rank of the min-max scaled signal."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals]))).filter("v is not null")
    runs = cumulative(long.groupBy("signal", "v").agg(F.count("*").alias("n")), "v", "n", "__run", "__all", ["signal"])
    at = lambda p: nearest_rank(F.col("v"), F.col("__run"), F.col("__all"), p)
    rows = runs.groupBy("signal").agg((F.max("v") - F.min("v")).alias("span"), (at(0.75) - at(0.25)).alias("middle"))
    iqr = F.when(F.col("span") > 0, F.col("middle") / F.col("span")).otherwise(0.0)
    return rows.select("signal", iqr.alias("iqr")).withColumn("dead", F.col("iqr") < least)


def composite(df: DataFrame, signals: dict[str, float]) -> DataFrame:
    """Weighted mean of the signals' percentiles, over those a row has; ``confidence`` is their share of the weight."""
    out = df
    for s in signals:
        out = percentile_rank(out.filter(F.col(s).isNotNull()), s, f"__p_{s}").unionByName(out.filter(F.col(s).isNull()), allowMissingColumns=True)
    total = sum(signals.values())
    have = sum((F.when(F.col(f"__p_{s}").isNotNull(), F.lit(w)).otherwise(0.0) for s, w in signals.items()), F.lit(0.0))
    score = sum((F.coalesce(F.col(f"__p_{s}"), F.lit(0.0)) * w for s, w in signals.items()), F.lit(0.0))
    return out.withColumns({"composite": F.when(have > 0, score / have), "confidence": have / total}).drop(*[f"__p_{s}" for s in signals])


def _gate(row: DataFrame, name: str, value: Column, passed: Column) -> DataFrame:
    return row.select(F.lit(name).alias("name"), passed.alias("pass"), round_up(value, 3).alias("value"))


def gate_dominance(df: DataFrame, blocs: list[str], most: float = 0.4, least_rows: int = 10) -> DataFrame:
    """No bloc has more than ``most`` of the summed variances. Too few rows fail, blocs that never vary pass."""
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.var_samp(b), F.lit(0.0)).alias(b) for b in blocs])
    total = sum((F.col(b) for b in blocs), F.lit(0.0))
    share = F.when(F.col("n") >= least_rows, F.when(total < 1e-10, 0.0).otherwise(F.greatest(*[F.col(b) for b in blocs]) / total))
    return _gate(row, "bloc-dominance", share, F.coalesce(share <= most, F.lit(False)))


def gate_not_tempo(df: DataFrame, composite: str, tempo: str, most: float = 0.5) -> DataFrame:
    """The composite is not just the tempo: rank correlation under ``most`` either way."""
    rho = round_up(F.abs("rho"), 3)
    return _gate(spearman(df, composite, tempo), "not-bpm", rho, F.coalesce(rho < most, F.lit(False)))


def gate_tiers(df: DataFrame, measured: list[str], perceived: str, least: float = 0.4) -> DataFrame:
    """The mean of the measured blocs ranks rows like the perceived one."""
    rows = df.withColumn("__mean", sum((F.col(c) for c in measured), F.lit(0.0)) / len(measured))
    rho = round_up(F.col("rho"), 3)
    return _gate(spearman(rows, "__mean", perceived), "tier-agreement", rho, F.coalesce(rho >= least, F.lit(False)))


def gate_direction(df: DataFrame, high: Column, value: str, least: float = 0.5) -> DataFrame:
    """Families meant to be high score higher, by Cohen's d; a check, never a target. ``high`` is null for rows of neither side."""
    d = round_up(F.col("d"), 3)
    return _gate(cohen_d(df.filter(high.isNotNull()), high, value), "genre-direction", d, F.coalesce(d > least, F.lit(False)))


def gate_bands(df: DataFrame, name: str, a: str, b: str, most: int = 1, least: float = 0.95, empty: bool = False) -> DataFrame:
    """Two bands of a row (before and after a gain, two copies) lie within ``most`` in ``least`` of the rows; without rows the gate is ``empty``."""
    row = df.agg(F.avg((F.abs(F.col(a) - F.col(b)) <= most).cast("int")).alias("share"))
    share = round_up(F.col("share"), 3)
    return _gate(row, name, share, F.coalesce(share >= least, F.lit(empty)))


def collect_gates(gates: list[DataFrame]) -> DataFrame:
    """All gates, one row each, with ``passed, total, all_pass``. A row a gate, so one window holds them."""
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    w = Window.partitionBy()
    out = out.withColumns({"passed": F.count_if("pass").over(w), "total": F.count("*").over(w)})
    return out.withColumn("all_pass", F.col("passed") == F.col("total"))
