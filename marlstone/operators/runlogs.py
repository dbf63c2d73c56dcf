"""Metrics out of the logs of verification runs: a structured line where there is a sound one, else the lines meant for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mark of the structured line, the lines for people, and the names of the counts.
MARK = "VERIFY_JSON: "
COUNTS = {
    "tracks": (r"(?m)^  tracks: (\d+)", "tracks"), "pdb": (r"export\.pdb=(\d+) tracks", "pdb_tracks"), "odb": (r"OneLibrary DB=(\d+) tracks", "onelibrary_tracks"), "playlists": (r"playlists: (\d+)", "playlists"), "entries": (r"entries: (\d+)", "playlist_entries"),
    "dangling": (r"dangling: (\d+)", "dangling_entries"), "artist_fk": (r"artist FK bad: (\d+)", "artist_fk_bad"),
}
OFFENDERS = {
    "missing_audio": (("missing audio: (\\d+)",), ("missing_files",)), "missing_analysis": (("missing analysis: (\\d+)",), ("missing_anlz",)), "no_bpm": (("no BPM: (\\d+)",), ("no_bpm",)), "bad_length": (("bad length: (\\d+)",), ("bad_length",)),
    "bad_grids": ((r"ANLZ consistency failures \(generated\): (\d+)", r"bad grids \(generated\): (\d+)"), ("anlz_consistency", "bad_grids")), "hash_missing": ((r"ANLZ missing at hash path AND at DB path: (\d+)",), ("anlz_hash_missing",)),
}
VARIANCE = r"pioneer-native variance \(informational\): (\d+)"
CROSS, IDENTICAL = "=== cross-drive ===", "DB byte-identical: true"
PARITY = r"ANLZ full hash parity: (\d+)/(\d+) mismatches"
SPOT = r"audio hash spot-check \(40\): (\d+) mismatches"

_LISTS = sorted({f for _, fields in OFFENDERS.values() for f in fields})
_DRIVE = ", ".join([f"{field}: bigint" for _, field in COUNTS.values()] + [f"{f}: array<string>" for f in _LISTS])
_SCHEMA = f"struct<drives: map<string, struct<{_DRIVE}>>, db_identical: boolean, anlz_total: bigint, anlz_mismatches: array<string>, audio_mismatches: array<string>>"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    """The digits of the first match; null without one."""
    return F.regexp_extract(text, pattern, group).try_cast("bigint")


def _field(*names: str):
    """The first of a record's fields that is there; lambdas take no defaults in Spark's higher-order functions."""
    return lambda record: F.coalesce(*[record[n] for n in names])


def verify_metrics(logs: DataFrame, id_col: str = "run_id", text_col: str = "log") -> DataFrame:
    """One row per log: counts, offenders, and the comparison of two drives.

    The first line that begins with the mark holds an object with a record per drive; counts are summed
    over drives, offenders' lists joined. If the line is missing, cut off or names no drive, the first
    match of each line for people counts instead: runs over two drives print both, and the first
    stands. Offenders whose list is missing for a drive are counted from the lines too. ``structured``
    tells which it was. Without a number, ``dangling``, ``artist_fk`` and offenders are 0, other counts
    null. A null log gives a row without numbers. A log is one value: its lines are never parted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.get(F.filter(F.split(text, "\n"), lambda x: x.startswith(MARK)), 0)
    parsed = F.from_json(F.substring(line, len(MARK) + 1, 1 << 30), _SCHEMA)
    rows = logs.select(F.col(id_col).alias("run_id"), text.alias("t"), parsed.alias("j"))
    drives = F.filter(F.map_values(F.coalesce("j.drives", F.expr(f"CAST(map() AS map<string, struct<{_DRIVE}>>)"))), lambda d: d.isNotNull())
    rows = rows.withColumn("d", drives)
    # Written out by an explode of one element, so that no expression below parses the line anew.
    rows = rows.select("run_id", "t", F.explode(F.array(F.struct("j", "d"))).alias("x")).select("run_id", "t", "x.j", "x.d").withColumn("structured", F.size("d") > 0)
    use = F.col("structured")
    out: dict[str, Column] = {"structured": use}
    for name, (pattern, field) in COUNTS.items():
        told = F.filter(F.transform("d", _field(field)), lambda v: v.isNotNull())
        summed = F.when(F.size(told) > 0, F.aggregate(told, F.lit(0).cast("bigint"), lambda a, v: a + v))
        read = _number(F.col("t"), pattern)
        out[name] = F.when(use, summed).otherwise(F.coalesce(read, F.lit(0)) if name in ("dangling", "artist_fk") else read)
    out["variance"] = _number(F.col("t"), VARIANCE)
    none = F.array().cast("array<string>")
    for name, (patterns, fields) in OFFENDERS.items():
        lists = F.transform("d", _field(*fields))
        whole = use & F.forall(lists, lambda x: x.isNotNull())
        listed = F.flatten(F.transform(lists, lambda x: F.coalesce(x, none)))
        counted = F.coalesce(*[_number(F.col("t"), p) for p in patterns], F.lit(0))
        out[f"{name}_list"] = listed
        out[name] = F.when(whole, F.size(listed)).otherwise(counted).cast("bigint")
    mismatches, wrong = F.coalesce("j.anlz_mismatches", none), F.coalesce("j.audio_mismatches", none)
    compared = F.col("j.db_identical").isNotNull() | F.col("j.anlz_mismatches").isNotNull() | F.col("j.audio_mismatches").isNotNull()
    out["cross_drive"] = F.when(use, compared).otherwise(F.col("t").contains(CROSS))
    out["identical"] = F.when(use, F.coalesce("j.db_identical", F.lit(False))).otherwise(F.col("t").contains(IDENTICAL))
    known = F.col("j.anlz_total").isNotNull() | (F.size(mismatches) > 0)
    bad, total = _number(F.col("t"), PARITY, 1), _number(F.col("t"), PARITY, 2)
    out["parity_bad"] = F.when(use, F.when(known, F.size(mismatches).cast("bigint"))).otherwise(bad)
    out["parity_total"] = F.when(use, F.when(known, F.coalesce("j.anlz_total", F.lit(0)))).otherwise(total)
    out["audio_bad"] = F.when(use, F.size(wrong).cast("bigint")).otherwise(_number(F.col("t"), SPOT))
    return rows.select("run_id", *[c.alias(n) for n, c in out.items()])


def search_snapshots(drives: DataFrame, needle: str, most: int = 10) -> DataFrame:
    """``drive_id, drive_name, mounted, matches``: drives whose name, playlists or folders hold a text, in either case.

    ``drives``: id, name, nickname, mounted, snapshot (JSON with playlists of name and entries, folders
    of name and files, track_count). Up to ``most`` matches a drive: the drive itself first, then its
    playlists and folders in their order, each with a type, a name and how much it holds. A broken or
    missing snapshot has no playlists and folders; its drive can still be found by name.
    """
    low = needle.lower()
    schema = "struct<track_count: bigint, playlists: array<struct<name: string, entries: bigint>>, folders: array<struct<name: string, files: bigint>>>"
    rows = drives.select("id", "name", "nickname", "mounted", F.from_json("snapshot", schema).alias("s"))
    kind = "array<struct<type: string, name: string, entries: bigint>>"
    holds = lambda c: F.lower(c).contains(low)
    label = F.coalesce("nickname", "name")
    itself = F.when(F.coalesce(holds(F.col("name")), F.lit(False)) | F.coalesce(holds(F.col("nickname")), F.lit(False)), F.array(F.struct(F.lit("drive").alias("type"), label.alias("name"), F.coalesce("s.track_count", F.lit(0)).alias("entries"))).cast(kind))
    part = lambda field, name, size: F.transform(F.filter(F.coalesce(F.col(f"s.{field}"), F.array().cast(f"array<struct<name: string, {size}: bigint>>")), lambda x: holds(x["name"])), lambda x: F.struct(F.lit(name).alias("type"), x["name"].alias("name"), x[size].alias("entries"))).cast(kind)
    matches = F.slice(F.concat(F.coalesce(itself, F.array().cast(kind)), part("playlists", "playlist", "entries"), part("folders", "folder", "files")), 1, most)
    return rows.select(F.col("id").alias("drive_id"), label.alias("drive_name"), F.coalesce("mounted", F.lit(False)).alias("mounted"), matches.alias("matches")).filter(F.size("matches") > 0)
