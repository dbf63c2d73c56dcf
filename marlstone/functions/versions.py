"""What version of a work a title names: its base, kind, makers and guests, by an ordered list of patterns. Built-in functions but for NFC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import nfc

# How titles write their versions, in the order in which they are tried. Each with the
# kind and whether its first group names who made it.
_OPEN, _CLOSE = r"(?:\(|\[)", r"(?:\)|\])"


def _in_brackets(inner: str) -> str:
    return rf"{_OPEN}\s*{inner}\s*{_CLOSE}"


def _by_someone(inner: str) -> str:
    return _in_brackets(rf"(.+?)\s+{inner}")


PATTERNS = (
    (_by_someone("(?:re-?mix|rmx)"), "remix", True),
    (r"\s+-\s+(.+?)\s+(?:re-?mix|rmx)\s*$", "remix", True),
    (_in_brackets(r"radio\s+edit"), "radio", False),
    (_by_someone("edit"), "edit", True),
    (_by_someone("bootleg"), "bootleg", True),
    (_by_someone("flip"), "flip", True),
    (_by_someone("vip"), "vip", True),
    (_in_brackets("vip"), "vip", False),
    (_by_someone("rework"), "rework", True),
    (_by_someone(r"dub(?:\s+mix)?"), "dub", True),
    (_by_someone("refix"), "refix", True),
    (_in_brackets(r"extended\s+mix"), "extended", False),
    (_in_brackets(r"original\s+mix"), "original", False),
    (_in_brackets(r"club\s+mix"), "extended", False),
    (_in_brackets("acoustic"), "acoustic", False),
    (rf"{_OPEN}\s*live\b[^)\]]*{_CLOSE}", "live", False),
    (_in_brackets("instrumental"), "instrumental", False),
    (_in_brackets("acapella"), "acapella", False),
    (_in_brackets(r"a\s*cappella"), "acapella", False),
)
GUESTS = r"\s*(?:feat\.?|ft\.?|featuring)\s+(.+?)(?:\s*[(\[]|$)"
BETWEEN = r"(?i)\s*(?:,\s*|\s+&\s+|\s+x\s+|\s+vs\.?\s+)"
_DASH = r"\s*[-–—]\s*$"


def split_artists(s: Column) -> Column:
    """Names between commas, &, x and vs; none for null or blank."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), BETWEEN), F.trim), lambda a: a != "")


def _guests(s: Column) -> Column:
    return split_artists(F.regexp_extract(s, f"(?i){GUESTS}", 1))


def with_version(df: DataFrame, title: str, artist: str, name: str = "version") -> DataFrame:
    """``df`` with a struct ``base_title, artists, featured, type, version_artists, raw_version, confidence``.

    Guests ("feat. X") are taken out of the title, with all behind them, and out of the artist. The
    first pattern found in what is left gives the kind, who made it, and its text as written; what
    stands before it, in lower case and without a dash at its end, is the base. Who made the version
    is no artist of the original. Without a pattern the title is an original, less surely (0.9). Null
    titles and artists are empty ones; blanks at the ends do not count.
    """
    whole = F.trim(nfc(F.coalesce(F.col(title), F.lit(""))))
    by = F.coalesce(F.col(artist), F.lit(""))
    cut = rf"(?is)^(.*?){GUESTS}"
    # In steps, so that each text is worked out once and not again in every pattern.
    rows = df.withColumns({"__t": whole, "__by": by})
    rows = rows.withColumns({"__clean": F.when(F.col("__t").rlike(f"(?i){GUESTS}"), F.trim(F.regexp_extract("__t", cut, 1))).otherwise(F.col("__t")), "__own": F.trim(F.regexp_replace("__by", rf"(?is)^(.*?){GUESTS}(.*)$", "$1$3")), "__with": F.array_distinct(F.concat(_guests(F.col("__t")), _guests(F.col("__by"))))})
    found = []
    for pattern, kind, named in PATTERNS:
        before = F.regexp_extract("__clean", rf"(?is)^(.*?)(?:{pattern})", 1)
        maker = F.regexp_extract("__clean", f"(?i){pattern}", 1) if named else F.lit("")
        found.append(F.when(F.col("__clean").rlike(f"(?i){pattern}"), F.struct(F.lit(kind).alias("type"), before.alias("before"), maker.alias("maker"), F.regexp_extract("__clean", f"(?i){pattern}", 0).alias("text"))))
    rows = rows.withColumn("__v", F.explode(F.array(F.coalesce(*found))))
    base = F.lower(F.regexp_replace(F.trim(F.coalesce("__v.before", "__clean")), _DASH, ""))
    makers = split_artists(F.col("__v.maker"))
    lowered = F.transform(makers, F.lower)
    artists = F.filter(split_artists(F.col("__own")), lambda a: ~F.array_contains(lowered, F.lower(a)))
    raw = F.regexp_replace(F.regexp_replace("__v.text", r"^[(\[\s]+", ""), r"[\s)\]]+$", "")
    version = F.struct(F.trim(base).alias("base_title"), artists.alias("artists"), F.col("__with").alias("featured"), F.coalesce("__v.type", F.lit("original")).alias("type"), makers.alias("version_artists"), raw.alias("raw_version"), F.when(F.col("__v").isNull(), 0.9).otherwise(1.0).alias("confidence"))
    return rows.withColumn("__out", version).select(*df.columns, F.col("__out").alias(name))


def matching(a: Column, b: Column) -> Column:
    """Two versions (:func:`with_version`): ``exact`` for one base and kind by a common maker, or by none on either side; ``sibling`` for one base; else ``reject``."""
    makers = [F.transform(v["version_artists"], F.lower) for v in (a, b)]
    neither = (F.size(makers[0]) == 0) & (F.size(makers[1]) == 0)
    same = (a["type"] == b["type"]) & (neither | F.arrays_overlap(*makers))
    return F.when(a["base_title"] != b["base_title"], "reject").when(same, "exact").otherwise("sibling")
