"""Text functions: titles, names, tags, comments. Built-in functions but for Unicode normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(s: Column) -> Column:
    """Canonical composition. Spark has no built-in for it, so this is an Arrow UDF."""
    @F.pandas_udf("string")
    def compose(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFC")

    return compose(s)


def name_key(s: Column) -> Column:
    return F.lower(nfc(s))


def meta_key(artist: Column, title: Column) -> Column:
    """"artist - title" in lower case; null if either is missing."""
    a, t = (F.nullif(F.lower(F.trim(c)), F.lit("")) for c in (artist, title))
    return F.concat(a, F.lit(" - "), t)


def path_after(path: Column, marker: str) -> Column:
    """The path behind the first ``marker``."""
    return F.regexp_replace(path, f"^.*?{marker}", "")


def strip_copy_suffix(s: Column) -> Column:
    """Without trailing copy numbers, repeated ones too."""
    return F.regexp_replace(s, r"((\s*-\s*|\s+)\d+)+$", "")


def signature(s: Column) -> Column:
    """Sorted tokens joined by +; a lone x is no token."""
    parts = F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: (t != "") & (t != "x"))
    return F.array_join(F.array_sort(parts), "+")


def version(title: Column) -> Column:
    """``type`` and ``base`` of a title with a mix name in brackets at its end."""
    low = F.lower(F.trim(title))
    mix = F.regexp_extract(low, r"\(([^)]*)\)\s*$", 1)
    kind = F.when(mix.rlike("remix$"), "remix").when(mix.rlike("^extended( mix)?$"), "extended").when(mix.rlike(r"^live\b"), "live").otherwise("original")
    return F.struct(kind.alias("type"), F.trim(F.regexp_replace(low, r"\s*\([^)]*\)\s*$", "")).alias("base"))


def compatible(a: Column, b: Column) -> Column:
    """exact for the same base and type, sibling for the same base, else reject."""
    return F.when(a["base"] != b["base"], "reject").when(a["type"] == b["type"], "exact").otherwise("sibling")


def canonical(label: Column, table: dict[str, str], umbrella: set[str]) -> Column:
    """A label's family from a fixed table, by lower case; umbrella labels have none."""
    key = F.lower(F.trim(label))
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(key.isin(*umbrella), None).otherwise(F.try_element_at(pairs, key))


def comment(brand: Column, energy: Column, kind: Column) -> Column:
    return F.concat_ws(" | ", brand, F.concat(F.lit("e"), energy.cast("string")), kind)


def comment_part(text: Column, i: int) -> Column:
    return F.get(F.split(text, r" \| "), i)


def comment_energy(text: Column) -> Column:
    return F.regexp_extract(text, r"(?:^| \| )e(\d+)(?: \| |$)", 1).try_cast("int")


def tag_class(tag: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The first class whose pattern the tag matches."""
    out = F.when(F.lit(False), "")
    for name, pattern in rules:
        out = out.when(F.lower(tag).rlike(pattern), name)
    return out.otherwise(other)


def has_control(s: Column) -> Column:
    return s.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")


def looks_mojibake(s: Column) -> Column:
    """UTF-8 read as cp1252 leaves these pairs."""
    return s.rlike("Ã.|Â.|â€")


def has_foreign(s: Column) -> Column:
    """Characters beyond Latin and general punctuation."""
    return s.rlike("[^\\x00-\\x{024F}\\x{2000}-\\x{206F}]")


def nearest_word(s: Column, words: list[str], most: int) -> Column:
    """The vocabulary's nearest word within ``most`` edits, ties by name; null if none."""
    scored = F.filter(F.array(*[F.struct(F.levenshtein(s, F.lit(w), most).alias("d"), F.lit(w).alias("w")) for w in words]), lambda x: x["d"] >= 0)
    return F.get(F.array_sort(scored), 0)["w"]


def ranked_badges(badges: Column, order: list[str], cap: int) -> Column:
    """Badges by their rank in ``order``, the rest by name, at most ``cap``."""
    known = F.array(*[F.lit(b) for b in order])
    place = lambda b: F.struct(F.when(F.array_contains(known, b), F.array_position(known, b)).otherwise(len(order) + 1).alias("p"), b.alias("b"))
    return F.transform(F.slice(F.array_sort(F.transform(badges, place)), 1, cap), lambda x: x["b"])


def decode_entities(s: Column) -> Column:
    """The five entities of XML, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def search_query(title: Column, most: int = 8) -> Column:
    """A title as a search query: without brackets and featured artists, at most ``most`` words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), r"[\(\[].*?[\)\]]", " "), r"\b(feat|ft)\.? .*$", " ")
    return F.array_join(F.slice(F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != ""), 1, most), " ")


# Marks that copies carry behind a title or file name.
COPY_MARK = r"\s*\[(?:archive(?: \d+)?|BACKUP2)\]"


def clean_title(title: Column) -> Column:
    """A title for grouping copies: without marks of copies and a number in brackets at its end, trimmed, composed, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(title, COPY_MARK, ""), r"\(\d+\)$", "")
    return F.trim(name_key(F.trim(bare)))


def stem_key(path: Column) -> Column:
    """The same of a file name without its extension; a leading dot starts no extension."""
    return clean_title(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", ""))
