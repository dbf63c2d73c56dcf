"""Column expressions that several operators share. All are built-in functions, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(x: Column, k: int) -> Column:
    """Half-up rounding towards +infinity: floor(x * 10^k + 0.5) / 10^k."""
    return F.floor(x * 10**k + 0.5) / float(10**k)


def fold(s: Column) -> Column:
    """Trimmed lower case; empty becomes null."""
    return F.nullif(F.lower(F.trim(s)), F.lit(""))


def bucket_label(s: Column, other: str = "unknown") -> Column:
    """The trimmed text, or ``other`` where it is null or empty."""
    return F.coalesce(F.nullif(F.trim(s), F.lit("")), F.lit(other))


def json_field(doc: Column, key: str) -> Column:
    """A field of a JSON text; null where the text isn't JSON."""
    return F.get_json_object(doc, f"$.{key}")


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that ``value`` is below, else ``last``; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(value < bound, label)
    return out.otherwise(last)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def uniform(index: Column, seed: int) -> Column:
    """Draw ``index`` (from 0) of the 32-bit generator mulberry32 as a double in [0, 1).

    The state after i calls is seed + i * step, so a draw depends on its index alone. 32-bit
    products are made of 16-bit halves, which stay within a long.
    """
    low = 0xFFFFFFFF

    def times(a: Column, b: Column) -> Column:
        return (a * (b % 65536) + ((a * F.floor(b / 65536)) % 65536) * 65536) % 4294967296

    def xor_shift(a: Column, n: int) -> Column:
        return a.bitwiseXOR(F.shiftrightunsigned(a, n))

    state = (F.lit(seed).cast("long") + times((index + 1).cast("long"), F.lit(0x6D2B79F5).cast("long"))) % 4294967296
    t = times(xor_shift(state, 15), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times(xor_shift(t, 7), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(low)))
    return xor_shift(t, 14) / F.lit(4294967296.0)


def erfc_positive(x: Column) -> Column:
    """The complementary error function for x >= 0, by the five-term rational approximation 7.1.26."""
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def normal_cdf(x: Column) -> Column:
    half = erfc_positive(F.abs(x) / F.sqrt(F.lit(2.0))) / 2
    return F.when(x >= 0, 1 - half).otherwise(half)


def name_ratio(a: Column, b: Column, d: Column | None = None) -> Column:
    """2(m + n - d) / (m + n) with edit distance d, 1 for equal names. It ranges to 2, not 1."""
    d = F.levenshtein(a, b) if d is None else d
    total = F.char_length(a) + F.char_length(b)
    return F.when(a == b, 1.0).when(total == 0, 0.0).otherwise(2.0 * (total - d) / total)


def name_similarity(a: Column, b: Column, d: Column | None = None) -> Column:
    """1 - d / max(m, n): the bounded form of :func:`name_ratio`."""
    d = F.levenshtein(a, b) if d is None else d
    return F.when(a == b, 1.0).otherwise(1 - d / F.greatest(F.char_length(a), F.char_length(b)))


def tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: t != ""))


def token_ratio(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 if either has none."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)
