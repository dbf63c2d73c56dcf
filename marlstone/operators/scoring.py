"""Pairwise transition scores: gates, terms and types, written once for columns and for arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.relational import band_count

# The weights, gates, windows and presets that scores must agree on.
WEIGHTS = {"tempo": 0.45, "key": 0.30, "arc_fit": 0.25, "anchor": 0.15, "similarity": 0.10}
PERFECT, LANE = 0.02, 0.06
DRIFT, BRANCH = 0.12, 0.06
HALF_TIME = (2.0, 0.5, 1.5, 2 / 3)
HALF_TIME_VALUE = 0.75 * 0.9
HALF_TIME_FAMILIES = ("drum and bass", "dubstep", "hip-hop", "trap", "house", "tech house", "techno", "trance", "breakbeat", "garage", "edm")
AGAINST = 0.6
REPEAT, FLOOR = 3, 0.01
PRESETS = {
    "warmup": {"arousal": (2.5, 5.5), "dance": (0.4, 0.7), "tempo": (1.0, 1.06)},
    "peak": {"arousal": (6.0, 8.5), "dance": (0.7, 0.95), "tempo": (1.0, 1.02)},
    "afterhours": {"arousal": (5.0, 3.0), "dance": (0.75, 0.6), "tempo": (1.0, 0.96)},
}
# What tells the types of a transition apart.
LONG_BLEND_BARS, SWAP_AROUSAL, DROP_AROUSAL, DROP_BAR = 16, 1.5, 6.0, 4


class _Columns:
    """The few operations of the formulas below, for Spark columns."""

    abs = staticmethod(F.abs)

    @staticmethod
    def where(test, yes, no) -> Column:
        return F.when(test, yes).otherwise(no)

    @staticmethod
    def low(a, b) -> Column:
        return F.least(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b)])

    @staticmethod
    def high(a, b) -> Column:
        return F.greatest(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b)])


class _Arrays:
    """The same for numpy arrays and numbers."""

    def __getattr__(self, name: str):
        import numpy as np

        return {"abs": np.abs, "where": np.where, "low": np.minimum, "high": np.maximum}[name]


COLUMNS, ARRAYS = _Columns(), _Arrays()


def tempo_score(a, b, o=COLUMNS):
    """1 for tempos within 2 per cent of the larger one, falling to 0 at 6 per cent."""
    d = o.abs(a - b) / o.high(a, b)
    return o.where(d <= PERFECT, 1.0, o.where(d >= LANE, 0.0, 1 - (d - PERFECT) / (LANE - PERFECT)))


def half_time_pair(a, b, o=COLUMNS):
    """True if ``b`` is within 6 per cent of 2, 1/2, 3/2 or 2/3 times ``a``."""
    near = [o.abs(b / (a * f) - 1) <= BRANCH for f in HALF_TIME]
    return near[0] | near[1] | near[2] | near[3]


def within_drift(bpm, anchor, o=COLUMNS):
    """True if a tempo lies within 12 per cent of the anchor, or within 6 per cent of its double or half."""
    return (o.abs(bpm / anchor - 1) <= DRIFT) | (o.abs(bpm / (anchor * 2) - 1) <= BRANCH) | (o.abs(bpm / (anchor * 0.5) - 1) <= BRANCH)


def key_compat(ha, ma, hb, mb, o=COLUMNS):
    """Keys as hours 1 to 12 with a mode: 1 for one hour, or a step in one mode; 0.9 a step in the other mode; 0.5 if a key (hour 0) is unknown; else 0."""
    step = o.low(o.abs(ha - hb), 12 - o.abs(ha - hb))
    known = o.where((step == 0) | (step == 1) & (ma == mb), 1.0, o.where(step == 1, 0.9, 0.0))
    return o.where((ha == 0) | (hb == 0), 0.5, known)


def mirex(na: Column, ma: Column, nb: Column, mb: Column) -> Column:
    """Key accuracy: 1 exact, 0.5 a fifth, 0.3 relative, 0.2 parallel (three hours on in the other mode); 0 if a key (hour 0) is unknown."""
    step = F.least(F.abs(na - nb), 12 - F.abs(na - nb))
    return F.when((na == 0) | (nb == 0), 0.0).when((step == 0) & (ma == mb), 1.0).when((step == 1) & (ma == mb), 0.5).when((step == 0) & (ma != mb), 0.3).when((step == 3) & (ma != mb), 0.2).otherwise(0.0)


def camelot(key: Column) -> Column:
    """A key as ``hour`` (1 to 12) and ``mode`` (0 minor, 1 major): 8A or 8 b, open keys (7m, 6d), or notes (Am, F#, Eb minor, C d); null for others.

    Hours go by fifths from 8 for A minor and C major; open keys run five hours ahead.
    """
    k = F.trim(key)
    part = lambda pattern, i: F.regexp_extract(k, pattern, i)
    wheel, numbered, noted = r"^([1-9]|1[0-2])\s*([ABab])$", r"^([1-9]|1[0-2])\s*([mdMD])$", r"^([A-Ga-g])([#b]?)\s*(maj(?:or)?|min(?:or)?|dur|moll|[md])?$"
    pitch = F.element_at(F.create_map(*[F.lit(x) for pair in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for x in pair]), F.upper(part(noted, 1)))
    pitch = pitch + F.when(part(noted, 2) == "#", 1).when(part(noted, 2) == "b", -1).otherwise(0)
    minor = part(noted, 3).isin("m", "moll") | part(noted, 3).startswith("min")
    fifths = F.pmod((pitch + F.when(minor, 3).otherwise(0)) * 7 + 7, F.lit(12)) + 1
    # A bare note is upper case: a lone "b" or "a" names no key.
    plain = (part(noted, 3) != "") | part(noted, 1).rlike("[A-G]")
    open_hour = F.pmod(part(numbered, 1).try_cast("int") - 6, F.lit(12)) + 1
    known = F.when(part(wheel, 1) != "", F.struct(part(wheel, 1).try_cast("int").alias("hour"), (F.upper(part(wheel, 2)) == "B").cast("int").alias("mode")))
    known = known.when(part(numbered, 1) != "", F.struct(open_hour.alias("hour"), (F.upper(part(numbered, 2)) == "D").cast("int").alias("mode")))
    return known.when((part(noted, 1) != "") & plain, F.struct(fifths.alias("hour"), (~minor).cast("int").alias("mode")))


def artist_key(artist: Column) -> Column:
    """The first of the credited artists in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.trim(F.split_part(artist, F.lit(","), F.lit(1)))), F.lit(""))


def mixable(pool: DataFrame) -> DataFrame:
    """The rows of a pool with a usable tempo, and the fields of the scores, none of them null but ``emb``.

    Columns read: id, bpm, hour, mode, arousal (1 to 9), dance (0 to 1), artist, family, duration_s,
    embedding. An unknown arousal counts as 5, a dance value as 0.6, a duration as 300 s, an unknown
    key is hour 0, an unknown family opens no half-time lane, an unknown artist repeats nobody.
    """
    family = F.coalesce(F.lower("family").isin(*HALF_TIME_FAMILIES), F.lit(False))
    seconds = F.col("duration_s").cast("double")
    return pool.filter((F.col("bpm") > 0) & (F.col("bpm") < float("inf"))).select(
        *[c for c in pool.columns if c not in ("bpm", "hour", "mode", "arousal", "dance", "artist", "family", "duration_s", "embedding")],
        F.col("bpm").cast("double").alias("bpm"),
        F.coalesce("hour", F.lit(0)).cast("int").alias("hour"),
        F.coalesce("mode", F.lit(0)).cast("int").alias("mode"),
        F.coalesce("arousal", F.lit(5.0)).cast("double").alias("arousal"),
        F.col("arousal").isNotNull().alias("felt"),
        F.coalesce("dance", F.lit(0.6)).cast("double").alias("dance"),
        artist_key(F.col("artist")).alias("who"),
        family.alias("half"),
        F.when((seconds > 0) & (seconds < float("inf")), seconds).otherwise(300.0).alias("seconds"),
        F.col("embedding").cast("array<double>").alias("emb"),
    )


FIELDS = ["bpm", "hour", "mode", "arousal", "felt", "dance", "who", "half", "seconds", "emb"]


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors brought to 0 to 1; 0 where one is missing or they differ in length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), (dot(a, b) / norm + 1) / 2), F.lit(0.0))


def terms(a, b, preset: dict, t, anchor, sim, o=COLUMNS) -> dict:
    """The unweighted terms of following ``a`` with ``b`` at place ``t`` (0 to 1) of a set, and whether its gates let it.

    ``a`` and ``b`` give the fields of :func:`mixable`; ``anchor`` is the tempo of the set's opener,
    to which a half-time pair may stand as well as one within the drift; ``sim`` is the similarity.
    Arousal may not move against the preset's direction by more than 0.6, but at the very end.
    """
    at = lambda name: preset[name][0] + (preset[name][1] - preset[name][0]) * t
    direct = tempo_score(a["bpm"], b["bpm"], o)
    half = (direct == 0) & half_time_pair(a["bpm"], b["bpm"], o) & a["half"] & b["half"]
    lane = o.where(half, HALF_TIME_VALUE, direct)
    key = key_compat(a["hour"], a["mode"], b["hour"], b["mode"], o)
    rise = preset["arousal"][1] - preset["arousal"][0]
    way = (rise > 1e-9) - (rise < -1e-9)
    against = a["felt"] & b["felt"] & ((b["arousal"] - a["arousal"]) * way < -AGAINST) & (t < 1)
    drift = within_drift(b["bpm"], anchor, o) | half_time_pair(anchor, b["bpm"], o)
    fit = 1 - o.low(1.0, (o.abs(b["arousal"] / 9 - at("arousal") / 9) + o.abs(b["dance"] - at("dance"))) / 2)
    pull = 1 - o.low(1.0, o.abs(b["bpm"] / (anchor * at("tempo")) - 1) / ((LANE - PERFECT) / 2))
    return {"tempo": lane, "key": key, "arc_fit": fit, "anchor": pull, "similarity": sim, "half_time": half, "repeat": (a["who"] == b["who"]) & (b["who"] != ""), "open": drift & (lane > 0) & (key > 0) & ~against}


def blend(found: dict, o=COLUMNS):
    """The weighted sum of the terms; after the same artist three less and one more, but not under 0.01; -1 behind a closed gate."""
    total = sum(w * found[name] for name, w in WEIGHTS.items())
    return o.where(found["open"], o.where(found["repeat"], o.high(FLOOR, total - REPEAT + 1), total), -1.0)


def transition(a: dict[str, Column], b: dict[str, Column], preset: str, t: Column, anchor: Column) -> Column:
    """The score of a pair as a column; see :func:`terms` and :func:`blend`."""
    return blend(terms(a, b, PRESETS[preset], t, anchor, similarity(a["emb"], b["emb"])))


def evidence(a: dict[str, Column], b: dict[str, Column], preset: str, t: Column, anchor: Column) -> Column:
    """A struct of the weighted parts of a score, the artist's penalty, the lane and the total; null behind a closed gate."""
    found = terms(a, b, PRESETS[preset], t, anchor, similarity(a["emb"], b["emb"]))
    parts = [(w * found[name]).alias(name) for name, w in WEIGHTS.items()]
    return F.when(found["open"], F.struct(*parts, F.when(found["repeat"], REPEAT).otherwise(0).alias("penalty"), found["half_time"].alias("half_time"), blend(found).alias("total")))


def transition_type(scored: Column, half_time: Column, out_bar: Column, in_bar: Column, before: Column, after: Column) -> Column:
    """The technique of a transition: by the lane, then by cue bars and arousal (unknown: 0); ``hold`` without a score or a sign.

    ``scored`` tells whether the step has a score (an opener has none).
    """
    was, now = F.coalesce(before, F.lit(0.0)), F.coalesce(after, F.lit(0.0))
    swap = F.abs(now - was) >= SWAP_AROUSAL
    cued = out_bar.isNotNull() & in_bar.isNotNull()
    by_cue = F.when((now >= DROP_AROUSAL) & (in_bar <= DROP_BAR), "drop-entry").when(swap, "energy-swap").when(F.abs(out_bar - in_bar) >= LONG_BLEND_BARS, "long-blend").otherwise("phrase-cut")
    return F.when(~scored, "hold").when(half_time, "half-time-shift").when(cued, by_cue).when(swap, "energy-swap").otherwise("hold")


def lane_pairs(pool: DataFrame, group: str) -> DataFrame:
    """``a, b``: structs of every two different rows of a group whose tempos share a lane, ``a`` with the lesser id.

    Tempos are cut into cells as wide as the lane on a log scale; a row goes to the cells around its
    own tempo and around those at half time, and meets only the rows of these cells.
    """
    import math

    width = -math.log(1 - LANE)
    cell = lambda f: F.floor(F.log(F.col("bpm") * f) / width)
    cells = F.array_distinct(F.flatten(F.array(*[F.sequence(cell(f) - 1, cell(f) + 1) for f in (1.0, *HALF_TIME)])))
    a = pool.select(F.col(group).alias("__g"), F.struct(*pool.columns).alias("a"), F.explode(cells).alias("__c"))
    b = pool.select(F.col(group).alias("__g"), F.struct(*pool.columns).alias("b"), cell(1.0).alias("__c"))
    lane = (tempo_score(F.col("a.bpm"), F.col("b.bpm")) > 0) | half_time_pair(F.col("a.bpm"), F.col("b.bpm"))
    return a.join(b, ["__g", "__c"]).filter((F.col("a.id") < F.col("b.id")) & lane).select("a", "b")


def opener(pool: DataFrame, start: float, seed: int = 0, neighbours: int = 15) -> DataFrame:
    """The row that opens a set: nearest to the ``start`` arousal, then by id, among rows with enough others within the tempo lane; seed s takes the s-th of them, round and round.

    Where no row has so many neighbours all with a tempo compete. Only the first rows of the order
    are kept, so nothing is sorted whole. ``neighbours`` counts the row itself.
    """
    mixable = band_count(pool, "bpm", 1 - LANE)
    enough = mixable.filter(F.col("neighbours") >= neighbours)
    n = enough.count()
    ranked, n = (enough, n) if n else (mixable, mixable.count())
    if not n:
        return ranked
    off = F.floor(F.abs(F.coalesce("arousal", F.lit(5 / 9)) - start) * 1e6 + 0.5)
    first = ranked.withColumn("__off", off).orderBy("__off", "id").limit(seed % n + 1)
    return first.orderBy(F.desc("__off"), F.desc("id")).limit(1).drop("__off")


def chain_digest(chains: DataFrame, group: str) -> DataFrame:
    """``group, digest``: 16 hex digits over the steps in order, ids and scores with three decimals (- for none); equal chains, equal digests."""
    line = F.concat_ws(" ", F.col("id").cast("string"), F.when(F.col("score").isNull(), "-").otherwise(F.format_string("%.3f", F.floor(F.col("score") * 1000 + 0.5) / 1000)))
    rows = chains.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("r"))
    return rows.select(group, F.substring(F.sha2(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), 256), 1, 16).alias("digest"))
