"""Operator 12: interaction audit of a chain of filters, from words to counts per order of the chain."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import SPACES, row_key
from marlstone.operators.joins import join_by_size
from marlstone.session import materialise

#: A too few words, B too few distinct ones, C too many capitals, D odd symbols, E an earlier copy.
FILTERS = "ABCDE"
_KEY = ["__k1", "__k2"]


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)


def word_totals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``__k1, __k2, words, distinct_words`` for every row's key (columns of ``df``) whose text has a word.

    Texts are dealt out by their key, once; the counts of (key, word) and then of the key are taken
    where they are dealt. Repeated rows are dealt by the task that read them too, so no task gets all
    of them: each tells its own words and copies, and the copies' totals are equal.
    """
    dealt = df.select(*_KEY, F.spark_partition_id().alias("task"), F.col(text_col).alias("text")).repartition(*_KEY, "task")
    words = F.array_remove(F.split("text", f"[{SPACES}]+"), "")
    each = dealt.select(*_KEY, "task", F.posexplode(words).alias("at", "word"))
    by_word = each.groupBy(*_KEY, "task", "word").agg(F.count("*").alias("n"), F.count_if(F.col("at") == 0).alias("copies"))
    by_task = by_word.groupBy(*_KEY, "task").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.count("*").alias("distinct_words"))
    return by_task.groupBy(*_KEY).agg(F.max((F.col("n") / F.col("copies")).cast("long")).alias("words"), F.max("distinct_words").alias("distinct_words"))


def failing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, failed, n``: how many rows of an id and part fail which filters.

    ``failed`` has a bit per filter, A's is 1. Words are runs without ASCII white space, case-sensitive.
    A: under 50 words; B: distinct words under 65 % of them; C: A-Z over 5 % of the code points; D:
    any of ``#$%&*|``; E: a smaller id has the same text, whatever filters that row fails.

    Null texts and parts are empty ones; rows with a null id never fail E nor make others fail it;
    repeated rows count each and are no copies of one another; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.col(id_col).alias("__id"))
    rows = rows.select("doc_id", "part", "text", *row_key("__id", "text"))
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    seen = rows.select(*_KEY, "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), (100 * capitals > 5 * F.char_length("text")).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"))
    flags = materialise(seen.groupBy(*seen.columns).agg(F.count("*").alias("n")).join(word_totals(rows), _KEY, "left").drop(*_KEY))
    copies = flags.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    found = join_by_size(flags, materialise(copies.filter("first <> last").select("same", "first", "rows")), ["same"], "rows", "left", least=5000)
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < 50, 100 * distinct < 65 * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    failed = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return found.select("doc_id", "part", failed.alias("failed"), "n").groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n"))


def pattern_counts(failed: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """``part`` with ``n_0`` to ``n_31``, ``good_0`` ..., ``toxic_0`` ...: rows per part and set of failed filters.

    A document is good if any of its labels has quality 1, toxic if any has toxic 1; a null id has no label.
    """
    known = labels.groupBy(F.col(label_id).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("doc_id IS NOT NULL AND (good OR toxic)")
    judged = failed.join(known, "doc_id", "left")
    sets = range(1 << len(FILTERS))
    picked = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.coalesce(F.sum(F.when((F.col("failed") == m) & test, F.col("n"))), F.lit(0)).alias(f"{kind}_{m}") for kind, test in picked.items() for m in sets]
    return judged.groupBy("part").agg(*counts)


def interactions(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step with what the step does, from :func:`pattern_counts`.

    ``shapley`` sums what the step's filter removes over all orders, at any step: a row that fails k
    filters is removed by each of them in 120 / k orders.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    sets = range(1 << len(FILTERS))
    tallies = [F.array(*[F.struct(F.lit(m).alias("m"), F.lit(len(orders) // max(1, m.bit_count())).cast("long").alias("share"), *[F.col(f"{k}_{m}").alias(k) for k in ("n", "good", "toxic")]) for m in sets]).alias("tally")]
    letter = lambda i: _bit(F.substring(F.col("filter_order"), i, F.lit(1)))
    before = lambda step: F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, i: a + F.when(i < step, letter(i)).otherwise(0))
    chain = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.struct(i.alias("step"), letter(i).alias("own"), before(i).alias("before")))
    steps = counts.select("part", *tallies).select("part", "tally", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", F.inline(chain))

    def total(test, value) -> Column:
        return F.aggregate("tally", F.lit(0).cast("long"), lambda a, t: a + F.when(test(t["m"]), value(t)).otherwise(0))

    hit = lambda m: m.bitwiseAND(F.col("own")) != 0
    early = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: hit(m) & ~early(m)
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~hit(m) & ~early(m), lambda t: t["n"]).alias("kept"),
        total(removed, lambda t: t["n"]).alias("removed"),
        total(lambda m: hit(m) & early(m), lambda t: t["n"]).alias("redundant"),
        total(lambda m: m == F.col("own"), lambda t: t["n"]).alias("unique_fails"),
        total(removed, lambda t: t["good"]).alias("good_lost"),
        total(removed, lambda t: t["toxic"]).alias("toxic_lost"),
        total(hit, lambda t: t["n"] * t["share"]).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters in ``docs`` (doc_id, text, source), judged by ``labels``.

    Odd input as in :func:`failing`; repeated labels of a document count once; documents without a
    label, or with null ones, are neither good nor toxic; no documents give no rows.
    """
    return interactions(pattern_counts(failing(docs), labels))
