"""Operator 13: how far the sources of a language diverge in their use of terms, from joint count histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import ascii_lower
from marlstone.session import materialise, release

#: What is no part of a term once A-Z are in lower case: ASCII but a-z.
BREAKS = "[\\x00-\\x60\\x7B-\\x7F]+"
#: Blocks over which the sources of one language are dealt when they are paired.
BLOCKS = 32


def term_counts(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """``lang, source, term, n, lang_n``: occurrences of the terms that ``min_docs`` documents of a language hold.

    A text gives all its terms, and behind them its distinct ones, which count its documents. Both
    are summed in each task before (lang, source, term) is dealt out. ``lang_n`` is the term's
    occurrences in the whole language.
    """
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source")], F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), empty)), BREAKS), "").alias("terms"))
    each = read.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    here = each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("size")).alias("n"), F.count_if(F.col("at") >= F.col("size")).alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = here.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("docs"))
    return known.filter(F.col("docs") >= min_docs).drop("docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 * (count + 5) / (total + 5 * terms))``, exact for counts of any size; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = F.nullif((wide(total) + 5 * wide(terms)).cast("decimal(24,0)"), F.lit(0).cast("decimal(24,0)"))
    return 1 + F.call_function("div", (F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + 5).cast("decimal(20,0)")), over)


def group_sizes(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, source, total, lang_total, terms``: a row for every (lang, source) of ``docs``, with or without terms."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = counts.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return groups.join(own, ["lang", "source"], "left").join(F.broadcast(whole), "lang", "left").select("lang", "source", zero("total"), zero("lang_total"), zero("terms"))


def source_pairs(groups: DataFrame) -> DataFrame:
    """``lang, a, b, total_a, total_b, terms``: every two sources of a language, a before b.

    Both sides are dealt by language and a block of b, so that one language with many sources does
    not meet in one task.
    """
    block = F.pmod(F.xxhash64("source"), F.lit(BLOCKS)).cast("int")
    a = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), "terms", block.alias("block"))
    return a.join(b, ["lang", "block"]).filter("a < b").drop("block")


def joint_histogram(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lang, a, b, x, y, n``: how many kept terms a pair of sources has x and y times.

    Terms that both have meet by a join on the term. The zero cells are not formed from terms: from
    each source's own histogram go the terms that the other has too, and what neither has is the
    rest of the language's terms.
    """
    key = ["lang", "a", "b"]
    left = counts.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x"))
    right = counts.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    both = materialise(left.join(right, ["lang", "term"]).filter("a < b").groupBy(*key, "x", "y").agg(F.count("*").alias("n")))
    own = counts.groupBy("lang", F.col("source").alias("s"), F.col("n").alias("v")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    named = pairs.select(*key)
    x_alone = named.join(own.withColumnsRenamed({"s": "a"}), ["lang", "a"]).select(*key, F.col("v").alias("x"), zero.alias("y"), "n")
    y_alone = named.join(own.withColumnsRenamed({"s": "b"}), ["lang", "b"]).select(*key, zero.alias("x"), F.col("v").alias("y"), "n")
    shared = both.select(*key, F.inline(F.array(F.struct("x", zero.alias("y"), (-F.col("n")).alias("n")), F.struct(zero.alias("x"), "y", (-F.col("n")).alias("n")))))
    cells = both.unionByName(x_alone.unionByName(y_alone).unionByName(shared).groupBy(*key, "x", "y").agg(F.sum("n").alias("n")).filter("n > 0"))
    neither = pairs.join(cells.groupBy(*key).agg(F.sum("n").alias("n")), key, "left").select(*key, zero.alias("x"), zero.alias("y"), (F.col("terms") - F.coalesce("n", zero)).alias("n"))
    return cells.unionByName(neither.filter("n > 0"))


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    Part ``pair``: ``item`` is another source of the language, ``value`` the sum of ``abs(p - q)``
    over all kept terms, p and q the smoothed shares (:func:`share`) of a term in the two sources;
    the difference is taken once per cell of the pair's joint histogram. Part ``term``: the ``top``
    kept terms that the source uses more than the whole language, by how much.

    Null text, lang and source are empty ones. A source without kept terms has its pairs, a language
    without kept terms values of 0. Repeated rows count each; ties go by the item's bytes; other
    columns are not read; an empty table gives no rows. A very long text is one array in its task.
    """
    counts = materialise(term_counts(docs, min_docs))
    groups = materialise(group_sizes(docs, counts))
    pairs = materialise(source_pairs(groups))
    cells = joint_histogram(counts, pairs).join(pairs, ["lang", "a", "b"])
    gap = F.abs(share(F.col("x"), F.col("total_a"), F.col("terms")) - share(F.col("y"), F.col("total_b"), F.col("terms")))
    summed = cells.groupBy("lang", "a", "b").agg(F.sum(gap * F.col("n")).alias("value"))
    valued = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    by_pair = valued.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    more = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    by_term = counts.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.cast("long").alias("value")).filter("value > 0")
    return _ranked(by_pair).unionByName(_ranked(by_term).filter(F.col("rank") <= top))
