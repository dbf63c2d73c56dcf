"""Names against names: tokens, overlap, the artist gate, imprints and key tokens. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST = 3  # a shorter artist name tells nobody apart


def primary_artist(artist: Column) -> Column:
    """The first of several artists, in lower case; empty for null."""
    return F.lower(F.trim(F.get(F.split(F.coalesce(artist, F.lit("")), "[,&]"), 0)))


def name_tokens(s: Column) -> Column:
    """Words of three or more letters and digits, in lower case; none for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2)


def title_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the longer name, each counted once; 0 where either has none."""
    x, y = F.array_distinct(name_tokens(a)), F.array_distinct(name_tokens(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


def shares_token(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_tokens(a), name_tokens(b))


def artist_points(artist: Column, credits: Column) -> Column:
    """6 if the first credit that holds the artist is the artist, 4 if it only contains it, else 0; null credits are passed over."""
    a = primary_artist(artist)
    low = F.transform(F.coalesce(credits, F.array().cast("array<string>")), F.lower)
    hit = F.get(F.filter(low, lambda c: c.contains(a)), 0)
    return F.when((F.length(a) < SHORTEST) | hit.isNull(), 0).when(hit == a, 6).otherwise(4)


def artist_fails(artist: Column, credits: Column) -> Column:
    """A name long enough to tell artists apart that no credit holds."""
    return (F.length(primary_artist(artist)) >= SHORTEST) & (artist_points(artist, credits) == 0)


def key_token(key: Column) -> Column:
    """A key like 8B as 08B, so that text order is key order; null for anything else."""
    n, letter = (F.regexp_extract(F.upper(F.trim(key)), r"^(1[0-2]|[1-9])([AB])$", i) for i in (1, 2))
    return F.when(letter != "", F.concat(F.lpad(n, 2, "0"), letter))


def imprint(label: Column, table: dict[str, str]) -> Column:
    """The key of ``table`` a record label stands for: itself, without its trade word, or the only key that continues it by a word. Null for numbers, a bare "music" and doubt."""
    base = F.lower(F.trim(label))
    bare = F.trim(F.regexp_replace(base, r"\s+(recordings?|records?|music|ltd|productions?)$", ""))
    keys = F.array(*[F.lit(k) for k in sorted(table)])
    longer = F.filter(keys, lambda k: k.startswith(F.concat(bare, F.lit(" "))))
    found = F.when(F.array_contains(keys, base), base).when((bare != "") & F.array_contains(keys, bare), bare).when(F.size(longer) == 1, F.get(longer, 0))
    return F.when((base != "") & ~base.rlike(r"^\d+$") & (base != "music"), found)


def resolve_term(raw: Column, families: list[str]) -> Column:
    """The family a term names; else the first in the list that contains it or is contained in it; else the term."""
    t = F.lower(F.trim(raw))
    out = F.when(t.isin(*families), t)
    for f in families:
        out = out.when((t != "") & (t.contains(f) | F.lit(f).contains(t)), f)
    return out.otherwise(t)
