"""Search results against what was searched for: gates, points, the best hit; locations of an item.

``hits`` has one row per query and result: ``title, artist, seconds`` of the query and ``name,
credits, mix, length`` of the result, ``credits`` being an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import names as nm
from marlstone.functions.text import name_key


def catalog_points(title: Column, artist: Column, seconds: Column, name: Column, credits: Column, mix: Column, length: Column) -> Column:
    """Artist 6 or 4, 4 times the title overlap, 2 for a word of the mix, 3 or 2 for a length within 2 or 10 seconds; 0 in all if a known artist has no credit."""
    gap = F.abs(length - seconds)
    word = F.exists(nm.name_tokens(title), lambda w: F.coalesce(F.lower(mix), F.lit("")).contains(w))
    points = nm.artist_points(artist, credits) + 4 * nm.title_overlap(title, name) + F.when(word, 2).otherwise(0)
    points = points + F.when(gap <= 2, 3).when(gap <= 10, 2).otherwise(0)
    return F.when(nm.artist_fails(artist, credits), 0.0).otherwise(points)


def store_points(title: Column, artist: Column, name: Column, credits: Column, least: float = 0.5) -> Column:
    """The artist's points where the titles overlap enough and some credit holds the artist, else null."""
    points = nm.artist_points(artist, credits)
    return F.when((nm.title_overlap(title, name) >= least) & (points > 0), points)


def upload_points(title: Column, artist: Column, name: Column, uploader: Column) -> Column:
    """Two for each word of the title that the result has, one for the uploader; null without a word or if a known artist did not upload it."""
    have = nm.name_tokens(name)
    shared = F.size(F.filter(nm.name_tokens(title), lambda w: F.array_contains(have, w)))
    a = nm.primary_artist(artist)
    own = (a != "") & F.lower(F.coalesce(uploader, F.lit(""))).contains(F.substring(a, 1, 8))
    return F.when((shared > 0) & ((F.length(a) < nm.SHORTEST) | own), 2 * shared + own.cast("int"))


def best_hit(scored: DataFrame, query: str, order: list[str], score: str, floor: float) -> DataFrame:
    """The highest score of each query, the first in ``order`` among equals, if it reaches the floor."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.floor(F.col(score) * 1e6 + 0.5).desc(), *order))
    return scored.withColumn("__place", place).filter((F.col("__place") == 1) & (F.col(score) >= floor)).drop("__place")


def locate(inventory: DataFrame, query: str) -> DataFrame:
    """``drive, n`` of the drives that hold an item: by path or "artist - title"; only if none has it so, by any part of path, title and artist. An empty query is nowhere.

    One pass counts both kinds of hit for each drive, and a window over the drives picks the kind.
    """
    q = query.strip().lower()
    text = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("path", "title", "artist")}
    exact = (text["path"] == q) | (F.concat_ws(" - ", text["artist"], text["title"]) == q)
    part = F.concat_ws(" ", text["path"], text["title"], text["artist"]).contains(q)
    drives = inventory.filter(F.lit(bool(q)) & part | exact & F.lit(bool(q))).groupBy("drive").agg(F.count_if(exact).alias("__exact"), F.count_if(part).alias("__part"))
    known = F.max("__exact").over(Window.partitionBy()) > 0
    return drives.select("drive", F.when(known, F.col("__exact")).otherwise(F.col("__part")).alias("n")).filter("n > 0")


def release_family(releases: DataFrame, key: str, styles: str, genres: str, family) -> DataFrame:
    """``key, family, style, families``: the first style with a family, else the first such genre, which names no style."""
    mapped = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda s: F.struct(family(s).alias("f"), F.lower(s).alias("s"))), lambda x: x["f"].isNotNull())
    rows = releases.withColumns({"__s": mapped(styles), "__g": mapped(genres)})
    by_style = F.size("__s") > 0
    chosen = F.when(by_style, F.col("__s")).otherwise(F.col("__g"))
    return rows.select(key, F.get(chosen, 0)["f"].alias("family"), F.when(by_style, F.get("__s", 0)["s"]).alias("style"), F.array_distinct(F.transform(chosen, lambda x: x["f"])).alias("families"))


def without_copy_suffix(name: Column) -> Column:
    """A file name without copy numbers at the end of its stem ("track - 1 2.mp3" is "track.mp3")."""
    stem, suffix = (F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", i) for i in (1, 2))
    bare = F.regexp_replace(stem, r"(?:(?:\s*-\s*|\s+)\d+\s*)+$", "")
    return F.concat(F.rtrim(bare), suffix)


def repair_paths(broken: DataFrame, live: DataFrame) -> DataFrame:
    """``id, fix, via``: the live file that a path that leads nowhere must mean, by the first rung that names one.

    ``broken``: id, path. ``live``: path, bytes. Rungs: the same path in composed lower case
    (``casefold``); the only live file of that name (``basename``), of that name without copy numbers
    (``copy-suffix``), of the first 20 characters of the composed path (``prefix20``); of several
    files of the name without copy numbers, or else of the name, the largest (``largest-twin``).
    Nothing else is ``unresolved``. Among equals the first by path counts. Null paths resolve to nothing.

    Each index has one row per key, grouped in the tasks first, so common names multiply no rows.
    """
    keys = {
        "norm": name_key,
        "base": lambda p: F.lower(F.regexp_extract(p, "([^/]*)$", 1)),
        "bare": lambda p: F.lower(without_copy_suffix(F.regexp_extract(p, "([^/]*)$", 1))),
        "head": lambda p: F.substring(name_key(p), 1, 20),
    }
    files = live.filter(F.col("path").isNotNull()).select("path", F.coalesce("bytes", F.lit(-1)).alias("bytes")).distinct()
    rows = broken.select("id", *[f(F.col("path")).alias(k) for k, f in keys.items()])
    for k, f in keys.items():
        index = files.groupBy(f(F.col("path")).alias(k)).agg(F.count("*").alias(f"{k}_n"), F.min(F.struct((-F.col("bytes")).alias("b"), "path"))["path"].alias(f"{k}_path"))
        rows = rows.join(index, k, "left")
    only = lambda k, rung: F.when(F.col(f"{k}_n") == 1, F.struct(F.col(f"{k}_path").alias("fix"), F.lit(rung).alias("via")))
    most = lambda k: F.when(F.col(f"{k}_n") > 1, F.struct(F.col(f"{k}_path").alias("fix"), F.lit("largest-twin").alias("via")))
    same = F.when(F.col("norm_n") > 0, F.struct(F.col("norm_path").alias("fix"), F.lit("casefold").alias("via")))
    none = F.struct(F.lit(None).cast("string").alias("fix"), F.lit("unresolved").alias("via"))
    found = F.coalesce(same, only("base", "basename"), only("bare", "copy-suffix"), only("head", "prefix20"), most("bare"), most("base"), none)
    return rows.select("id", found.alias("f")).select("id", "f.fix", "f.via")
