"""Checks of a walked file tree against itself and against the rows of a collection.

``files(path, bytes, fp)`` is the walk, ``rows(id, title, folder, fp)`` the collection; ``fp`` is a
content fingerprint or null. Paths are compared in NFC and lower case. Findings are
``kind, path, row_id, detail``; no check guesses by name where a fingerprint is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import name_key

SEVERITY = {"junk": "safe", "byte-twin": "certain", "zero-byte": "likely", "stale-pointer": "review", "orphan-audio": "info", "re-download": "review"}


def is_junk(path: Column) -> Column:
    """Resource forks, folder settings, own scratch files and unfinished downloads."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.startswith("._") | (name == ".DS_Store") | name.startswith(".hygiene-") | name.endswith(".tmp")


def _found(df: DataFrame, kind: str, path: str, row_id: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), F.col(path).alias("path"), (row_id if row_id is not None else none).cast("string").alias("row_id"), (detail if detail is not None else none).alias("detail"))


def junk(files: DataFrame) -> DataFrame:
    return _found(files.filter(is_junk(F.col("path"))), "junk", "path")


def zero_byte(files: DataFrame) -> DataFrame:
    return _found(files.filter("bytes = 0"), "zero-byte", "path")


def byte_twins(files: DataFrame) -> DataFrame:
    """All files of one size and fingerprint, non-empty, of which there are several; the detail names the least path, which stays."""
    known = files.filter("bytes > 0 and fp is not null")
    groups = known.groupBy("bytes", "fp").agg(F.count("*").alias("n"), F.min("path").alias("keeper")).filter("n > 1").drop("n")
    return _found(known.join(groups, ["bytes", "fp"]), "byte-twin", "path", detail=F.col("keeper"))


def _dead(files: DataFrame, rows: DataFrame, volume: str) -> DataFrame:
    """Rows under the walked volume whose path is not in the walk."""
    alive = files.select(name_key(F.col("path")).alias("__key")).distinct()
    here = rows.filter(F.col("folder").startswith(f"{volume}/")).withColumn("__key", name_key(F.col("folder")))
    return here.join(alive, "__key", "left_anti").drop("__key")


def stale_pointers(files: DataFrame, rows: DataFrame, volume: str) -> DataFrame:
    """Dead rows whose content lies elsewhere: the least path of that fingerprint. The first row by id claims a file."""
    at = files.filter("fp is not null").groupBy("fp").agg(F.min("path").alias("path"))
    moved = _dead(files, rows, volume).join(at, "fp").groupBy("path").agg(F.min(F.struct("id", "folder")).alias("r"))
    return _found(moved, "stale-pointer", "path", F.col("r.id"), F.col("r.folder"))


def orphans(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files that no row names by path or by fingerprint; ``path-only`` where the file has no fingerprint. Without rows there are none."""
    if rows.isEmpty():
        return _found(files.limit(0), "orphan-audio", "path")
    named = rows.filter("folder <> ''").select(name_key(F.col("folder")).alias("__key")).distinct()
    known = rows.filter("fp is not null").select("fp").distinct()
    alone = files.withColumn("__key", name_key(F.col("path"))).join(named, "__key", "left_anti").join(known, "fp", "left_anti")
    return _found(alone, "orphan-audio", "path", detail=F.when(F.col("fp").isNull(), "path-only").otherwise("path+fp"))


def re_downloads(files: DataFrame, rows: DataFrame, volume: str) -> DataFrame:
    """Dead rows with a title whose content is nowhere in the walk; the detail is what to search for."""
    known = files.filter("fp is not null").select("fp").distinct()
    gone = _dead(files, rows, volume).filter("title <> ''").join(known, "fp", "left_anti")
    return _found(gone, "re-download", "folder", F.col("id"), F.col("title"))


def run_checks(files: DataFrame, rows: DataFrame, volume: str) -> DataFrame:
    """All checks in order of priority, with ``severity``.

    What junk claims nobody else sees; a byte twin is not reported as empty; a file that a stale
    row points to is no orphan. The other checks read all files that are not junk.
    """
    real = files.filter(~is_junk(F.col("path")))
    twins = byte_twins(real)
    stale = stale_pointers(real, rows, volume)
    empty = zero_byte(real.join(twins.select("path").distinct(), "path", "left_anti"))
    orphan = orphans(real.join(stale.select("path"), "path", "left_anti"), rows)
    found = junk(files)
    for more in (twins, empty, stale, orphan, re_downloads(real, rows, volume)):
        found = found.unionByName(more)
    level = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return found.withColumn("severity", level[F.col("kind")])
