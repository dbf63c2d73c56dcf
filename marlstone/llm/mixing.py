"""Operator 1: mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import SPACES
from marlstone.operators.joins import small_side
from marlstone.session import materialise, release

_KEY = ["__s", "__null"]


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _keyed(df: DataFrame, col: str) -> DataFrame:
    """The source as a join key that treats null as a value of its own."""
    return df.withColumns({"__s": F.coalesce(F.col(col).cast("string"), F.lit("")), "__null": F.col(col).isNull()})


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights repeating over the sources by code point, null last. ``sizes`` has a row per source."""
    rank = F.row_number().over(Window.orderBy("__null", "__s"))
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank - 1) % len(cycle) + 1)
    return sizes.withColumn("weight", picked)


def filled_targets(weighted: DataFrame, cap: float = 3.0) -> DataFrame:
    """Shares of the total size by weight; none over ``cap`` times its size, the excess reshared by weight.

    Sources are taken by the level at which they reach their cap; each is capped if what is left
    by then would put it above. One row per source goes through one window: a table as long as
    there are sources, never documents.
    """
    by_level = Window.orderBy(cap * F.col("source_size") / F.col("weight"), *_KEY)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    room = cap * F.col("source_size")
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    capped = weighted.withColumn("capped", room * weight_left <= F.col("weight") * left)
    sums = F.struct((F.sum("source_size").over(whole) - F.sum(F.when(F.col("capped"), room).otherwise(0.0)).over(whole)).alias("size"), F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole).alias("weight"))
    return capped.withColumn("rest", sums).withColumn("target", F.when(F.col("capped"), room).otherwise(F.col("weight") * F.col("rest.size") / F.col("rest.weight"))).drop("rest", "capped", "weight")


def dual_multipliers(histogram: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-7, max_steps: int = 100) -> DataFrame:
    """``sources`` with ``m``: the multiplier of each source's token constraint, by Newton steps on the dual.

    Documents' rates minimise the relative entropy to rate 1, damped by the square root of their
    size, subject to ``sum(size * rate) = target`` and ``rate <= cap``. The optimum is
    ``rate = min(cap, exp(m * sqrt(size / mean)))``; the dual's gradient is the constraint's error
    and its curvature ``sum(size * x * rate)`` over the rates below the cap. Documents of one size
    have one rate, so ``histogram`` (a row per source and size, with ``n``) holds all that is summed.

    Every step is one grouped aggregation for all sources at once, pre-aggregated in each task; the
    multipliers are written between steps. A step that leaves a source's bracket is replaced by the
    bracket's middle. It ends when the largest error, as a share of its target, is under
    ``tolerance``, or no bracket can shrink. Sources to be filled to their cap, or not at all, have a null ``m``.
    """
    open_ = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    least = histogram.groupBy(*_KEY).agg(F.min("size").alias("least"))
    reach = F.sqrt(F.col("least") / F.col("mean"))
    low = F.when(F.col("target") < F.col("source_size"), F.log(F.col("target") / F.col("source_size")) / reach).otherwise(0.0)
    high = F.when(F.col("target") > F.col("source_size"), F.log(F.lit(cap)) / reach).otherwise(0.0)
    keep = [*_KEY, "source_size", "docs", "target", "mean"]
    state = materialise(sources.join(least, _KEY, "left").select(*keep, F.when(open_, 0.0).alias("m"), low.alias("lo"), high.alias("hi")))
    few = state.count() <= 100_000
    for _ in range(max_steps):
        narrow = state.filter("m is not null").select(*_KEY, "m", "mean")
        tilt = F.sqrt(F.col("size") / F.col("mean"))
        raw, tokens = F.exp(F.col("m") * tilt), F.col("size") * F.col("n")
        sums = histogram.join(F.broadcast(narrow) if few else narrow, _KEY).groupBy(*_KEY).agg(F.sum(tokens * F.least(F.lit(cap), raw)).alias("taken"), F.sum(F.when(raw < cap, tokens * raw * tilt).otherwise(0.0)).alias("g"))
        error = F.col("taken") - F.col("target")
        tight = state.join(sums, _KEY, "left").withColumns({"lo": F.when(error <= 0, F.col("m")).otherwise(F.col("lo")), "hi": F.when(error >= 0, F.col("m")).otherwise(F.col("hi"))})
        newton = F.col("m") - error / F.when(F.col("g") > 0, F.col("g"))
        step = F.when((newton >= F.col("lo")) & (newton <= F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs(error) <= tolerance * F.col("target")
        moved = materialise(tight.select(*keep, F.when(near, F.col("m")).otherwise(step).alias("m"), "lo", "hi", (~near & (step != F.col("m"))).alias("moved")))
        release(state)
        state = moved
        if state.filter("moved").isEmpty():
            break
    return state.select(*keep, "m")


def rounded_copies(docs: Column) -> Column:
    """Whole copies for an array of documents (largest first): ``floor(rate)`` each, and how many of ``c`` equal ones get one more.

    The running sum of what the rates ask for decides: further copies are given as long as each
    brings the words taken nearer to it. Later, smaller documents make up for earlier errors.
    """

    def add(s: Column, d: Column) -> Column:
        base = F.floor(d["rate"])
        asked = s["asked"] + d["rate"] * d["size"] * d["c"]
        floor = s["taken"] + base * d["size"] * d["c"]
        more = F.when(d["rate"] > base, F.greatest(F.lit(0), F.least(d["c"], F.floor((asked - floor) / d["size"] + 0.5)))).otherwise(0).cast("long")
        return F.struct(asked.alias("asked"), (floor + more * d["size"]).cast("double").alias("taken"), F.concat(s["more"], F.array(more)).alias("more"))

    empty = F.array().cast("array<bigint>")
    return F.aggregate(docs, F.struct(F.lit(0.0).alias("asked"), F.lit(0.0).alias("taken"), empty.alias("more")), add, lambda s: s["more"])


def mix(df: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, chunk: int = 1024, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``doc_id, size, source_size, target, rate, copies, taken`` for every row of ``df``.

    ``targets(source, target)`` gives words per source; without it, sources share all words by
    cyclic weights, capped at ``cap`` times what they have. Sources missing in it take nothing.
    Rates become whole copies largest document first, each error carried on to the next. A source
    is dealt into chunks of about ``chunk`` documents by a hash of the id, each rounded on its own,
    so a source with a third of all rows is no single group. Rows of one id and size count as one
    entry there, however many they are.

    Null and empty texts have size 0 and take 0 words. A null source is a source. Ties and
    repeated rows are distinct documents; null ids too. Reruns agree. An empty table gives no rows.
    Other columns are not read, whatever their names. Texts of any length are only counted.
    """
    base = materialise(_keyed(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size")), "__source").drop("__source"))
    by_source = base.groupBy(*_KEY).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    if targets is None:
        by_source = filled_targets(cyclic_weights(by_source, cycle), cap)
    else:
        wanted = _keyed(targets, "source").select(*_KEY, F.col("target").cast("double"))
        by_source = by_source.join(wanted, _KEY, "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    histogram = materialise(base.filter("size > 0").groupBy(*_KEY, "size").agg(F.count("*").alias("n")))
    solved = dual_multipliers(histogram, by_source.withColumn("mean", F.col("source_size") / F.col("docs")), cap)
    release(histogram)

    rate = F.when((F.col("target") <= 0) | (F.col("size") == 0), 0.0).when(F.col("m").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.col("m") * F.sqrt(F.col("size") / F.col("mean")))))
    equal = base.groupBy(*_KEY, "doc_id", "size").agg(F.count("*").alias("c"))
    docs = equal.join(small_side(solved, 100_000), _KEY).withColumn("rate", rate)
    docs = docs.withColumn("__chunk", F.pmod(F.xxhash64(F.lit(3), "doc_id", "size"), F.ceil(F.col("docs") / chunk)))
    one = F.struct((-F.col("size")).alias("key"), F.xxhash64("doc_id", "size").alias("u"), "doc_id", "size", "rate", "c")
    grouped = docs.groupBy(*_KEY, "__chunk").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.array_sort(F.collect_list(one)).alias("entries"))
    chosen = grouped.withColumn("more", rounded_copies(F.col("entries"))).select("source_size", "target", F.explode(F.arrays_zip("entries", "more")).alias("x"))
    each = chosen.select("source_size", "target", "x.entries.doc_id", "x.entries.size", "x.entries.rate", "x.more", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.entries.c"))).alias("i"))
    copies = (F.floor("rate") + (F.col("i") <= F.col("more")).cast("int")).cast("int")
    return each.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
