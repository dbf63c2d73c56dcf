"""The candidate pool of a set: joined measurements, live paths, two ways to be a duplicate, and a census of what stays out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import nfc

# Forms of a release that do not tell two items apart, and channels that stand in the artist's place.
FORMS = "original|extended|club|radio|album|single|vocal"
BARE_FORMS = "extended|club|radio|vocal"
UPLOADERS = ("trap city", "trap nation", "chill nation", "mrrevillz", "selected", "cloudx", "house city", "future classic", "magic club")
AUDIO = "mp3|wav|aiff|m4a|flac"


def plain_name(s: Column) -> Column:
    """A name without release forms in brackets and without square brackets, closed or not; runs of other than a-z and 0-9 are one blank."""
    low = F.regexp_replace(F.lower(nfc(s)), rf"\((?:{FORMS})\s+(?:mix|edit|version)\)", " ")
    low = F.regexp_replace(F.regexp_replace(low, r"\[[^\]]*\]", " "), r"\[[^\]]*$", " ")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def plain_title(s: Column) -> Column:
    """:func:`plain_name` without release forms anywhere."""
    return F.trim(F.regexp_replace(plain_name(s), rf"\b(?:{FORMS})\s+(?:mix|edit|version)\b|\b(?:{BARE_FORMS})\b", " "))


def title_key(artist: Column, title: Column) -> Column:
    """``artist|title`` by which two items are one: the first credit, and the title without an audio suffix.

    Where the artist is unknown, or a channel, a title like "artist - title" names both itself.
    """
    raw = F.regexp_replace(F.coalesce(title, F.lit("")), rf"(?i)\.(?:{AUDIO})$", "")
    head = F.trim(F.split_part(F.coalesce(artist, F.lit("")), F.lit(","), F.lit(1)))
    who = plain_name(head)
    named = F.regexp_extract(raw, r"^(.+?)\s+-\s+(.+)$", 1)
    inner = F.regexp_extract(raw, r"^(.+?)\s+-\s+(.+)$", 2)
    unknown = who.isin("unknown", "unknownartist")
    itself = (named != "") & (unknown | F.lower(head).isin(*UPLOADERS))
    return F.when(itself, F.concat_ws("|", plain_name(named), plain_title(inner))).otherwise(F.concat_ws("|", who, plain_title(raw)))


def rebased(path: Column, root: str) -> Column:
    """A path below ``music/dj-imports`` (in either case) put under ``root``; null for any other."""
    rest = F.regexp_extract(path, r"(?i)^(?:.*/)?music/dj-imports/(.+)$", 1)
    return F.when(rest != "", F.concat(F.lit(root.rstrip("/") + "/"), rest))


def _mirror(mirror: DataFrame) -> DataFrame:
    """The latest mirrored row of each id: key and tempo out of guarded JSON."""
    last = mirror.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("updated_at", "content_id", "metadata")).alias("m"))
    bpm = F.get_json_object("m.metadata", "$.BPM").try_cast("double") / 100
    key = F.nullif(F.trim(F.get_json_object("m.metadata", "$.KeyName")), F.lit(""))
    return last.select("id", F.when((bpm > 0) & (bpm < float("inf")), bpm).alias("mirror_bpm"), key.alias("mirror_key"))


def judge(tracks: DataFrame, beats: DataFrame, mood: DataFrame, mirror: DataFrame, keys: DataFrame, files: DataFrame, root: str = "/") -> DataFrame:
    """Every downloaded track with its measurements and an ``outcome``: kept, same path, same title or no file.

    ``tracks``: id (unique), title, artist, genre, duration_s, path, status, updated_at. ``beats``: id,
    bpm. ``mood``: id, valence, arousal, dance. ``mirror``: id, content_id, updated_at, metadata (JSON
    with BPM in hundredths and KeyName). ``keys``: id, path, key. ``files``: path of what is there.

    A track's path is its own, or else its place under ``root``, if such a file exists; one without a
    file but with a tempo stays as ``metadata_only``. Of tracks with one path the first stays, in the
    order: with a file, the latest update, the least id; of those the first with one title key,
    unless the title is blank. ``bpm`` is the beats' (``bpm_from`` says so) or the mirror's. ``key``
    comes from ``keys`` for just this path (an empty one is known to be none), else from the mirror;
    ``key_from`` says ledger, mirror, unread (a file not read yet) or none.

    All joins are on unique keys, and both duplicate passes are grouped minima, so that no path or
    title, however common, gathers in a task. Null ids, paths and measurements match nothing.
    """
    there = files.filter(F.col("path").isNotNull()).select(F.col("path").alias("__at")).distinct()
    base = tracks.filter(F.col("status") == "downloaded").select("id", "title", "artist", "genre", "duration_s", "path", "updated_at", rebased(F.col("path"), root).alias("__moved"))
    own = there.select(F.col("__at").alias("path"), F.lit(True).alias("__own"))
    moved = there.select(F.col("__at").alias("__moved"), F.lit(True).alias("__there"))
    base = base.join(own, "path", "left").join(moved, "__moved", "left")
    base = base.withColumn("file", F.when(F.col("__own"), F.col("path")).when(F.col("__there"), F.col("__moved")))
    base = base.withColumn("relocated", F.col("__own").isNull() & F.col("file").isNotNull())
    measured = base.join(beats.select("id", F.col("bpm").alias("__bpm")), "id", "left").join(_mirror(mirror), "id", "left").join(mood.select("id", "valence", "arousal", "dance"), "id", "left")
    known = keys.select("id", F.col("path").alias("file"), F.col("key").alias("__key"), F.lit(True).alias("__known"))
    measured = measured.join(known, ["id", "file"], "left")
    finite = F.col("__bpm").isNotNull() & (F.abs(F.col("__bpm")) < float("inf"))
    tempo = finite | F.col("mirror_bpm").isNotNull()
    key = F.when(F.col("__known"), F.nullif("__key", F.lit(""))).otherwise(F.col("mirror_key"))
    rows = measured.select(
        "id", "title", "artist", "genre", "duration_s", "path", "file", "relocated", "updated_at", "valence", "arousal", "dance",
        F.col("file").isNull().alias("metadata_only"),
        F.coalesce("__bpm", "mirror_bpm").alias("bpm"),
        F.when(F.col("__bpm").isNotNull(), "beats").when(F.col("mirror_bpm").isNotNull(), "mirror").otherwise("none").alias("bpm_from"),
        key.alias("key"),
        F.when(F.col("__known"), "ledger").when(F.col("mirror_key").isNotNull(), "mirror").when(F.col("file").isNotNull(), "unread").otherwise("none").alias("key_from"),
        (F.col("file").isNotNull() | tempo).alias("usable"),
        F.lower(nfc(F.col("file"))).alias("__place"),
        F.when(F.trim(F.col("title")) != "", title_key(F.col("artist"), F.col("title"))).alias("__name"),
    )
    # Ascending structs: with a file, then the latest update (nulls last), then the least id.
    order = F.struct("metadata_only", F.col("updated_at").isNull().alias("n"), (-F.unix_micros("updated_at")).alias("u"), "id")
    first = lambda df, by, flag: df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min(order).alias("o")).select(F.col("o.id").alias("id"), F.lit(True).alias(flag))
    usable = rows.filter("usable")
    placed = rows.join(first(usable, "__place", "__first_place"), "id", "left").withColumn("__single", F.col("usable") & (F.col("__place").isNull() | F.col("__first_place").isNotNull()))
    named = placed.join(first(placed.filter("__single"), "__name", "__first_name"), "id", "left")
    outcome = F.when(~F.col("usable"), "no file").when(~F.col("__single"), "same path").when(F.col("__name").isNotNull() & F.col("__first_name").isNull(), "same title").otherwise("kept")
    return named.withColumn("outcome", outcome).drop("usable", "__place", "__name", "__first_place", "__single", "__first_name")


def candidates(judged: DataFrame) -> DataFrame:
    """The tracks that stay, as columns for :func:`scoring.mixable` but key hours and vectors."""
    return judged.filter(F.col("outcome") == "kept").select("id", "title", "artist", F.lower("genre").alias("family"), "duration_s", "file", "metadata_only", "relocated", "bpm", "bpm_from", "key", "key_from", "valence", "arousal", "dance")


def census(judged: DataFrame) -> DataFrame:
    """One row of counts; ``total``, ``duplicates`` and ``unusable`` add up to ``source_total``."""
    kept, n = F.col("outcome") == "kept", F.count_if
    return judged.agg(
        F.count("*").alias("source_total"),
        n(kept).alias("total"),
        n(F.col("outcome").isin("same path", "same title")).alias("duplicates"),
        n(F.col("outcome") == "no file").alias("unusable"),
        n(F.col("metadata_only")).alias("missing_files"),
        n(F.col("metadata_only") & (F.col("outcome") != "no file")).alias("metadata_only"),
        n(kept & F.col("relocated")).alias("relocated_files"),
        n(kept & (F.col("key_from") == "mirror")).alias("mirror_keys"),
        n(kept & (F.col("bpm_from") == "mirror")).alias("mirror_bpms"),
        n(kept & (F.col("key_from") == "unread")).alias("keys_to_read"),
    )
