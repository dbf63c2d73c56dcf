"""Status ladders and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding_filter(status: str | None = None, kind: str | None = None, severity: str | None = None) -> Column:
    """What is asked for; without a status all but archived findings."""
    out = (F.col("status") == status) if status else (F.col("status") != "archived")
    for column, value in (("kind", kind), ("severity", severity)):
        if value:
            out = out & (F.col(column) == value)
    return out


def labelled(label: Column, flag: Column) -> Column:
    """Has a label, and nobody disputes it."""
    return F.coalesce(F.trim(label) != "", F.lit(False)) & ~flag.eqNullSafe("disputed")


def has_votes(votes: Column) -> Column:
    return F.coalesce(~F.trim(votes).isin("", "[]", "{}"), F.lit(False))


def work_queue(tracks: DataFrame, most_seconds: float, force: bool = False) -> DataFrame:
    """``tracks(id, beats, seconds, analyzed)`` with ``status`` and ``reason``: without beats or too long skipped, done analyzed, else pending. ``force`` takes the done up again."""
    none, long = F.coalesce(F.col("beats"), F.lit(0)) == 0, F.col("seconds") > most_seconds
    done = F.coalesce(F.col("analyzed"), F.lit(False)) & F.lit(not force)
    return tracks.select("id", F.when(none | long, "skipped").when(done, "analyzed").otherwise("pending").alias("status"), F.when(none, "no beats").when(long, "over duration cap").alias("reason"))


def classify_files(files: DataFrame, shelf: DataFrame, suffix: str) -> DataFrame:
    """``path, verdict, dest``: what becomes of ``files(path, bytes)`` beside ``shelf(path, bytes)``.

    covered: the path is there in that size. preserved: ``stem [any tag].ext`` in its folder is, in
    that size. copy: neither; to its path, or where that is taken to ``stem [suffix].ext``. Paths are
    compared in lower case.
    """
    split = lambda i: F.regexp_extract("path", r"^(.*/|)(.+?)(\.[^./]*|)$", i)
    low = files.withColumns({"__key": F.lower("path"), "__dir": split(1), "__stem": split(2), "__ext": split(3)})
    there = shelf.groupBy(F.lower("path").alias("__key")).agg(F.collect_set("bytes").alias("__sizes"))
    original = F.regexp_replace(F.lower("path"), r" \[[^\]/]*\](\.[^./]*|)$", "$1")
    kept = shelf.select(original.alias("__key"), "bytes", F.lit(True).alias("__kept"), F.lower("path").alias("__path")).filter("__key <> __path").select("__key", "bytes", "__kept").distinct()
    rows = low.join(there, "__key", "left").join(kept, ["__key", "bytes"], "left")
    covered = F.coalesce(F.array_contains("__sizes", F.col("bytes")), F.lit(False))
    verdict = F.when(covered, "covered").when(F.col("__kept"), "preserved").otherwise("copy")
    twin = F.concat("__dir", "__stem", F.lit(f" [{suffix}]"), "__ext")
    return rows.select("path", verdict.alias("verdict"), F.when(verdict == "copy", F.when(F.col("__sizes").isNotNull(), twin).otherwise(F.col("path"))).alias("dest"))


def reconcile(files: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """One row of counts: files, rows with a path, rows missing on disk, rows outside the folder, files without a row, paths that differ only by case, and the verdict."""
    disk = files.select("path", F.lower("path").alias("__key"))
    book = rows.filter("path is not null").select("path", F.lower("path").alias("__key"))
    both = disk.groupBy("__key").agg(F.count("*").alias("__f"), F.collect_set("path").alias("__fp"))
    both = both.join(book.groupBy("__key").agg(F.count("*").alias("__r"), F.collect_set("path").alias("__rp")), "__key", "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    inside = F.col("__key").startswith(folder.lower().rstrip("/") + "/")
    spelt = F.size(F.array_union(F.coalesce("__fp", F.array().cast("array<string>")), F.coalesce("__rp", F.array().cast("array<string>"))))
    out = both.agg(
        n("__f").alias("files"), n("__r").alias("rows"), n(F.when(F.col("__f").isNull() & inside, F.col("__r"))).alias("missing"), n(F.when(F.col("__f").isNull() & ~inside, F.col("__r"))).alias("outside"),
        n(F.when(F.col("__r").isNull(), F.col("__f"))).alias("orphans"), n((spelt > 1).cast("int")).alias("collisions"))
    bad = (F.col("missing") > 0) | (F.col("outside") > 0) | (F.col("orphans") > 0) | (F.col("collisions") > 0)
    return out.withColumn("verdict", F.when(bad, "drift").otherwise("clean"))


def chain_repeats(chains: DataFrame, group: str, artist: str) -> DataFrame:
    """Per chain the number of neighbours by one artist; a null artist repeats nobody."""
    before = F.lag(artist).over(Window.partitionBy(group).orderBy("step"))
    return chains.withColumn("__same", (before == F.col(artist)).cast("int")).groupBy(group).agg(F.coalesce(F.sum("__same"), F.lit(0)).cast("long").alias("repeats"))
