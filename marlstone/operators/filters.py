"""Searches, predicates with reasons, gates and orderings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, columns: list[str], query: str, order: str, limit: int = 50, literal: bool = True) -> DataFrame:
    """Rows with ``query`` in any of the columns, in either case; at most 1 to 200 of them.

    Queries under two characters find nothing. Unless ``literal``, % and _ are wildcards.
    """
    if len(query) < 2:
        return df.limit(0)
    q = query.lower()
    hit = F.lit(False)
    for c in columns:
        low = F.lower(F.col(c))
        hit = hit | (low.contains(q) if literal else low.like(f"%{q}%"))
    return df.filter(hit).orderBy(order).limit(min(max(limit, 1), 200))


def subsequence(s: Column, query: str) -> Column:
    """The query's characters occur in this order."""
    return F.lower(s).rlike(".*".join(re.escape(c) for c in query.lower()))


def fuzzy(s: Column, query: str, threshold: float = 0.38) -> Column:
    """Edit distance over the longer length is at most ``threshold``."""
    distance = F.levenshtein(F.lower(s), F.lit(query.lower()))
    return 1.0 - distance / F.greatest(F.char_length(s), F.lit(len(query))) >= 1 - threshold


def widening(df: DataFrame, strict: list[Column], fallback: list[Column], least: int) -> DataFrame:
    """Rows that meet any strict term; if those are fewer than ``least``, fallback terms count too."""
    any_of = lambda terms: F.expr("false") if not terms else _or(terms)
    found = df.filter(any_of(strict))
    if found.limit(least).count() >= least:
        return found
    return df.filter(any_of([*strict, *fallback]))


def _or(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def gate(new: DataFrame, key: str, hits: list[tuple[str, DataFrame]], other: str) -> DataFrame:
    """Each new row with the first basis, in order, on which it is known; an OR of joins without a nested loop."""
    found = None
    for i, (_, df) in enumerate(hits):
        one = df.select(key).distinct().withColumn("__p", F.lit(i))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(key).agg(F.min("__p").alias("__p"))
    names = F.array(*[F.lit(name) for name, _ in hits])
    return new.select(key).join(best, key, "left").select(key, F.coalesce(F.get(names, F.col("__p")), F.lit(other)).alias("basis"))


def folder_of(path: Column, marker: str) -> Column:
    """The path up to the folder that holds ``marker``; the whole path if no slash follows."""
    return F.regexp_extract(path, f"^(.*{re.escape(marker)}[^/]+)", 1)


def length_reason(length: Column, least: float, most: float) -> Column:
    """Why a row is left out for its length; null if it isn't, or if the length is unknown."""
    return F.when(length < least, "short").when(length > most, "long")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order. For heads of a table: the numbering is one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def stable_id(s: Column) -> list[Column]:
    """Order of ids: numbers by value, then the rest as text."""
    number = s.try_cast("decimal(38,0)")
    return [number.isNull().asc(), number.asc(), s.asc()]


def extremes(df: DataFrame, key: str, axes: dict[str, str], n: int) -> DataFrame:
    """The ``n`` highest and lowest rows on each axis, ties by key."""
    parts = [df.orderBy(order, key).limit(n).select(F.lit(f"{axis} {end}").alias("axis"), key, F.col(c).cast("double").alias("v")) for axis, c in axes.items() for end, order in (("high", F.desc(c)), ("low", F.asc(c)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """The names of all checks that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())
