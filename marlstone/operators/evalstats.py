"""Evaluation statistics over long prediction tables: truth, pred, conf."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalar import erfc_positive
from marlstone.operators.ranks import cumulative, number_rows, running_max
from marlstone.session import materialise


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def accuracy_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy and macro F1 over the classes that occur as truth, from one confusion table."""
    cells = confusion(df, truth, pred)
    sides = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "n", (F.col("truth") == F.col("pred")).alias("ok"))
    per = sides.groupBy("x.c").agg(F.sum(F.col("x.t") * F.col("n")).alias("t"), F.sum(F.col("x.p") * F.col("n")).alias("p"), F.sum(F.when(F.col("ok"), F.col("x.t") * F.col("n")).otherwise(0)).alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("t") + F.col("p"))
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(F.when(F.col("t") > 0, f1)).alias("macro_f1"), F.count_if(F.col("t") > 0).alias("classes"))


def calibration_error(df: DataFrame, conf: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    cells = df.select(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("b"), conf.alias("c"), correct.cast("double").alias("k"))
    per = cells.groupBy("b").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("k").alias("k"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("k"))) / F.sum("n")).alias("ece"))


def risk_coverage(df: DataFrame, conf: Column, correct: Column, steps: int = 20) -> DataFrame:
    """Coverage and accuracy at ``steps + 1`` thresholds from 0 to 1; a null confidence counts as 0.

    Rows are counted once by the last threshold they pass; sums from above give every threshold.
    """
    last = F.least(F.floor(F.coalesce(conf, F.lit(0.0)) * steps + 1e-9), F.lit(steps))
    counts = df.groupBy(last.alias("step")).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("k"))
    table = counts.agg(F.collect_list(F.struct("step", "n", "k")).alias("c"), F.sum("n").alias("all"))
    lines = table.select("c", "all", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    total = lambda f: F.aggregate(F.filter("c", lambda x: x["step"] >= F.col("step")), F.lit(0).cast("long"), lambda s, x: s + x[f])
    out = lines.select((F.col("step") / steps).alias("threshold"), total("n").alias("n"), total("k").alias("k"), "all")
    return out.select("threshold", (F.col("n") / F.col("all")).alias("coverage"), F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias("accuracy"))


def mcnemar(a: DataFrame, b: DataFrame, key: str, correct: str) -> DataFrame:
    """Discordant counts, the continuity-corrected statistic and its p-value (chi-square, 1 degree)."""
    both = a.select(key, F.col(correct).alias("x")).join(b.select(key, F.col(correct).alias("y")), key)
    counts = both.agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"))
    n = F.col("b") + F.col("c")
    chi = F.when(n > 0, F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), 2) / n).otherwise(0.0)
    return counts.withColumn("chi2", chi).withColumn("p", F.when(n > 0, erfc_positive(F.sqrt(F.col("chi2") / 2))).otherwise(1.0))


RANGE_ROWS = 1 << 20  # values that a task of the bootstrap holds
CHUNK_DRAWS = 1 << 23  # draws that it makes
SPAN = 1 << 20  # of which so many at once


def uniform_array(index: np.ndarray, seed: int) -> np.ndarray:
    """The draws of :func:`~marlstone.functions.scalar.uniform` for an array of indices."""
    state = ((index.astype(np.uint64) + np.uint64(1)) * np.uint64(0x6D2B79F5) + np.uint64(seed % 2**32)).astype(np.uint32)
    t = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def bootstrap_ci(df: DataFrame, order: str, value: Column, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval (2.5, 97.5, floor index) of the mean of ``value`` over resamples.

    Draw i * n + j of the counter generator picks a row for place j of resample i, so every
    resample is independent of the others and reruns agree. Rows are numbered by ``order``.
    """
    kept = materialise(df.select(F.col(order).alias("o"), value.cast("double").alias("v")))  # counted, sorted and written: three reads
    n = kept.count()
    rows = number_rows(kept, [F.col("o")], "at").select((F.col("at") - 1).alias("at"), "v")
    ranges = rows.groupBy(F.floor(F.col("at") / RANGE_ROWS).cast("long").alias("range")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("r"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-draws * n // CHUNK_DRAWS)) - 1).cast("long")))
    cells = ranges.select("range", F.transform("r", lambda x: x["v"]).alias("values"), chunks.alias("chunk"))

    def add(cell: pa.Table) -> pa.Table:
        values = cell.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        known = ~np.isnan(values)
        values = np.where(known, values, 0.0)
        first, chunk = cell.column("range")[0].as_py() * RANGE_ROWS, cell.column("chunk")[0].as_py()
        end, found = min(draws * n, (chunk + 1) * CHUNK_DRAWS), []
        for start in range(chunk * CHUNK_DRAWS, end, SPAN):
            index = np.arange(start, min(end, start + SPAN))
            at = (uniform_array(index, seed) * n).astype(np.int64) - first
            mine = (at >= 0) & (at < len(values))
            least = start // n
            i, at = index[mine] // n - least, at[mine]
            sums, counts = (np.bincount(i, x[at]).astype(np.float64) for x in (values, known))
            found.append((np.arange(least, least + len(sums)), sums, counts))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], ["i", "s", "c"])

    parts = cells.groupBy("range", "chunk").applyInArrow(add, "i long, s double, c double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    means = parts.select(F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("m"))
    sorted_ = means.agg(F.array_sort(F.collect_list("m")).alias("m"))
    at = lambda q: F.element_at("m", int(draws * q) + 1)
    return sorted_.select(at(0.025).alias("low"), at(0.975).alias("high"))


def fractional_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean. Distinct values are numbered, not rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    runs = cumulative(counts, value, "__n", "__run", "__all")
    return df.join(runs.select(value, (F.col("__run") - (F.col("__n") - 1) / 2).alias(name)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = fractional_rank(fractional_rank(df.select(a, b), a, "__ra"), b, "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("rho"))


def cohen_d(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Difference of means over the pooled sample deviation of two groups."""
    x = df.select(group.cast("int").alias("g"), F.col(value).alias("v")).groupBy().agg(*[f(F.when(F.col("g") == g, F.col("v"))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("s0") + (F.col("n1") - 1) * F.col("s1")) / (F.col("n0") + F.col("n1") - 2))
    return x.select(((F.col("m1") - F.col("m0")) / pooled).alias("d"))


def cohen_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def holm(df: DataFrame, p: str) -> DataFrame:
    """Holm-Bonferroni: adjusted p-values, which never fall along the order of p."""
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    runs = cumulative(counts, "__p", "__n", "__upto", "__m")
    # Of equal p-values the first has the largest product, which the others take over.
    raw = runs.select("__p", F.least(F.lit(1.0), F.col("__p") * (F.col("__m") - F.col("__upto") + F.col("__n"))).alias("__raw"))
    steps = running_max(raw, [F.col("__p")], "__raw", "adjusted").drop("__raw")
    return df.join(steps, F.col(p) == F.col("__p"), "left").drop("__p")


def run_compare(a: DataFrame, b: DataFrame, key: str, conf: str, correct: str, steps: int = 20) -> DataFrame:
    """Two runs over the same keys: per threshold the difference in accuracy (0 where a run covers nothing), beside the difference over all rows and McNemar's test."""
    share = lambda df, name: df.agg(F.avg(F.col(correct).cast("int")).alias(name))
    curve = lambda df, name: risk_coverage(df, F.col(conf), F.col(correct), steps).select("threshold", F.coalesce("accuracy", F.lit(0.0)).alias(name))
    whole = share(a, "__a").join(share(b, "__b")).join(mcnemar(a, b, key, correct))  # one row each
    lines = curve(a, "__x").join(curve(b, "__y"), "threshold").join(F.broadcast(whole))
    return lines.select("threshold", (F.col("__y") - F.col("__x")).alias("delta"), (F.col("__b") - F.col("__a")).alias("accuracy_delta"), "b", "c", "chi2", "p")


# Section labels that mean the same.
SECTIONS = {"chorus": "drop", "peak": "drop", "up": "buildup", "down": "breakdown"}


def section_match(predicted: DataFrame, truth: DataFrame, key: str, tolerance: int = 1) -> DataFrame:
    """``key, f1, label_accuracy, over, under`` of sections ``(key, start, label)`` against the true ones.

    Predicted starts in order each take the first free true start within the tolerance; labels are
    compared with the first true section within it, free or not. A key without sections on one side
    gets 0, and 1 for the side that has them. An item's sections are few, so they are arrays.
    """
    side = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "label"))).alias(name))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    rows = side(predicted.withColumn("start", F.col("start").cast("long")), "__p").join(side(truth.withColumn("start", F.col("start").cast("long")), "__t"), key, "full")
    rows = rows.withColumns({"__p": F.coalesce("__p", none), "__t": F.coalesce("__t", none)})
    near = lambda p, t: F.abs(p["start"] - t["start"]) <= tolerance
    # State: places of the true sections taken so far; one more per predicted section that finds a free one.
    places = F.when(F.size("__t") > 0, F.sequence(F.lit(0), F.size("__t") - 1)).otherwise(F.array().cast("array<int>"))
    free = lambda taken, p: F.filter(places, lambda i: near(p, F.col("__t")[i]) & ~F.array_contains(taken, i))
    hits = F.size(F.aggregate("__p", F.array().cast("array<int>"), lambda taken, p: F.concat(taken, F.slice(free(taken, p), 1, 1))))
    aliases = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    plain = lambda c: F.coalesce(F.try_element_at(aliases, F.lower(F.trim(c))), F.lower(F.trim(c)))
    seen = F.filter(F.transform("__p", lambda p: F.struct(p["label"].alias("p"), F.get(F.filter("__t", lambda t: near(p, t)), 0).alias("t"))), lambda x: x["t"].isNotNull())
    same = F.size(F.filter(seen, lambda x: plain(x["p"]) == plain(x["t"]["label"])))
    np_, nt, ok = F.size("__p"), F.size("__t"), F.size("__p") * F.size("__t") > 0
    return rows.select(
        key,
        F.when(ok, 2 * hits / (np_ + nt)).otherwise(0.0).alias("f1"),
        F.when(ok & (F.size(seen) > 0), same / F.size(seen)).otherwise(0.0).alias("label_accuracy"),
        F.when(ok, F.greatest(F.lit(0), np_ - nt) / nt).otherwise((np_ > 0).cast("double")).alias("over"),
        F.when(ok, F.greatest(F.lit(0), nt - np_) / nt).otherwise((nt > 0).cast("double")).alias("under"),
    )
