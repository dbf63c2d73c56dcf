"""Queries of genre labels and of versions named in titles, put together from lists by the rows of part."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import genres as gn
from marlstone.functions import versions as vr
from marlstone.plans.catalog import register, table

RAW = (
    "house", "Deep House", "Electronic/House", "Tech House/Tribal", "Dance / Electro Pop", "Hip Hop/Rap", "Dance & EDM", "R&B/Soul", "Drum & Bass", "Melodic House & Techno", "Hip-hop \\u0026 rap", "Techno (Peak Time / Driving)", "nu disco",
    "r&b soul", "", "Music", "https://djsoundtop.com", "House electronic swedish european edm trance", "Edits / Bootlegs", "bass house", "Afro House, Latin", "psytrance", "psy", "minimal", "future bass", "Future Rave", "DJ Tools", "Mainstage EDM", "jazz-funk", "grime\\\\",
)
SECOND = ("", "/Trance", ", pop", " & disco", " (remix)", "/electronic", " edm")

_QUOTE = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_LABELS = f"g AS (SELECT p_partkey, list_extract([{_QUOTE(RAW)}], (p_partkey % {len(RAW)} + 1)::INT) || list_extract([{_QUOTE(SECOND)}], (p_partkey // {len(RAW)} % {len(SECOND)} + 1)::INT) AS raw FROM part), f AS (SELECT *, replace(raw, '\\u0026', '&') AS fixed, contains(raw, '\\u0026') AS has FROM g)"
# Without look-around: names that do not count are taken out before the rest is looked for.
_FAMILY = """CASE WHEN {0} IN ('', 'music', 'unknown', 'fixme') OR regexp_matches({0}, '\\bloop samples\\b|\\bdj tools\\b') THEN NULL
  WHEN regexp_matches({0}, 'drum ?and ?bass|jungle|breakbeat|breaks|bass|dubstep|footwork|juke|grime|jersey club|donk|wall slappers') THEN 'bass'
  WHEN regexp_matches(regexp_replace({0}, '(bass|afro) house', '', 'g'), 'house') OR regexp_matches({0}, 'disco|garage|boogie') THEN 'house'
  WHEN regexp_matches({0}, 'techno|melodic|deep tech|hardtekk|softtekk|tekk') OR regexp_matches(replace({0}, 'minimal /', ''), 'minimal') THEN 'techno'
  WHEN regexp_matches({0}, 'trance|psy([^a-z]|$)') THEN 'trance' WHEN regexp_matches({0}, 'hip ?[- ]?hop|rap|trap') THEN 'hiphop'
  WHEN regexp_matches(replace({0}, 'future bass', ''), 'future ') OR regexp_matches({0}, 'edm|electro|big ?room|hardstyle|bounce|eurodance|euro ?dance|nightcore|uptempo|hard dance|hardcore') THEN 'edm'
  WHEN regexp_matches({0}, 'pop|rock|indie|alternative|punk|metal|folk|singer|country|top 40|chanson') THEN 'pop'
  WHEN regexp_matches({0}, 'r ?& ?b|soul|funk|amapiano|afrobeat|afro ?house|reggaeton|latin|dancehall|reggae') THEN 'groove'
  WHEN regexp_matches({0}, 'jazz|blues|ambient|downtempo|lofi|lo ?fi|classical|soundtrack|idm|chillwave|synthwave|world|spoken word|tutorial') THEN 'mood'
  WHEN regexp_matches({0}, '\\bgroove\\b') THEN 'groove' WHEN regexp_matches({0}, '\\bdance\\b|mainstream club') THEN 'edm' END"""
_NORMAL = "trim(regexp_replace(trim(split_part(lower({0}), ',', 1)), '\\(.*?\\)', '', 'g'))"
_SPELLED = "CASE WHEN t IN ('edm', 'dance', 'electronic', 'mainstage edm') THEN 1 ELSE 0 END"
_SPELL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in gn.SPELLINGS.items()) + "}"
_REFOLD = f"""{_LABELS}, s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(fixed, '\\(.*?\\)', '', 'g')), '(r\\s*)&(\\s*b)', '\\1@\\2', 'g'), '(drum\\s*)&(\\s*bass)', '\\1@\\2', 'g'), '(hip[-\\s]hop\\s*)&(\\s*rap)', '\\1@\\2', 'g'), '(melodic\\s*house\\s*)&(\\s*techno)', '\\1@\\2', 'g') AS low FROM f),
l AS (SELECT *, list_filter(list_transform(string_split_regex(low, '[/,&]'), lambda t: trim(regexp_replace(replace(t, '@', '&'), '\\s+', ' ', 'g'))), lambda t: t <> '') AS ls FROM s),
p AS (SELECT *, coalesce(list_filter(ls, lambda t: t NOT IN ('edm', 'dance', 'electronic', 'mainstage edm'))[1], ls[1]) AS t FROM l),
q AS (SELECT *, lower(trim(raw)) NOT IN ('', 'music', 'unknown', 'fixme') AS known, NOT regexp_matches(raw, 'https?://|\\b[\\w-]+\\.(?:com|net|org|io|co|ru|xyz|top)\\b', 'i') AS clean FROM p),
r AS (SELECT *, CASE WHEN known AND clean AND NOT regexp_matches(t, '\\b[\\w-]+\\.(?:com|net|org|io|co|ru|xyz|top)\\b') AND len(string_split(t, ' ')) < 5 AND regexp_matches(t, '^[a-z0-9][a-z0-9 &''-]*$') AND ({_FAMILY.format(_NORMAL.format('t'))}) IS NOT NULL
  THEN coalesce({_SPELL}[t], array_to_string(list_transform(string_split(t, '&'), lambda c: array_to_string(list_transform(list_filter(string_split(c, ' '), lambda w: w <> ''), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1]) || x[2:]), '-')), ' ')), '&')) END AS label FROM q)"""


def _labels(spark, sf):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(pick(RAW, k), pick(SECOND, F.floor(k / len(RAW)))).alias("raw"))


@register("genre_refold", f"WITH {_REFOLD} SELECT p_partkey, label, known AND has AS escaped, known AND clean AND len(ls) > 1 AS split, coalesce(label <> t, false) AS aliased FROM r")
def genre_refold(spark, sf):
    return _labels(spark, sf).select("p_partkey", gn.refold(F.col("raw")).alias("r")).select("p_partkey", "r.*")


@register("genre_family", f"WITH {_REFOLD}, n AS (SELECT *, {_NORMAL.format('fixed')} AS base FROM r) SELECT p_partkey, {_FAMILY.format('base')} AS family, CASE WHEN NOT coalesce(lower(label) IN ('edm', 'dance', 'electronic', 'mainstage edm'), false) THEN {_FAMILY.format('base')} END AS scored FROM n")
def genre_family(spark, sf):
    return _labels(spark, sf).select("p_partkey", gn.family(F.col("raw")).alias("family"), gn.scoring_family(F.col("raw")).alias("scored"))


FORMS = ("", " (Ann Remix)", " [Bob & Cy rmx]", " - Dee Re-mix", " (Radio Edit)", " (Ann Edit)", " (Eve Bootleg)", " (VIP)", " (Ann VIP)", " (Club Mix)", " (Extended  Mix)", " (Live at Home)", " (A Cappella)", " (Instrumental)", " feat. Gus & Hal", " ft. Ivy (Ann Remix)", " (Joe Dub Mix)", " -", " (Unknown Form)", " (acoustic)", " (Kim refix)")
CREDITS = ("Ann", "Ann, Bob", "Lee & Mia x Ned", "Oz feat. Pat", "Quin vs. Ray (live)", "")


def _quoted(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def _names(s):
    return f"list_filter(list_transform(string_split_regex({s}, '(?i)\\s*(?:,\\s*|\\s+&\\s+|\\s+x\\s+|\\s+vs\\.?\\s+)'), lambda a: trim(a)), lambda a: a <> '')"


_TITLES = f"t AS (SELECT p_partkey, p_name || {_quoted(FORMS)}[(p_partkey % {len(FORMS)} + 1)::INT] AS title, {_quoted(CREDITS)}[(p_partkey // {len(FORMS)} % {len(CREDITS)} + 1)::INT] AS artist FROM part)"
_NONE = "''"


def _maker(pattern):
    return f"regexp_extract(clean, '(?i){pattern}', 1)"


_CASES = " ".join(f"WHEN regexp_matches(clean, '(?i){p}') THEN {{'type': '{k}', 'before': regexp_extract(clean, '(?is)^(.*?)(?:{p})', 1), 'maker': {_maker(p) if n else _NONE}, 'text': regexp_extract(clean, '(?i){p}', 0)}}" for p, k, n in vr.PATTERNS)
_VERSIONS = f"""{_TITLES}, c AS (SELECT *, CASE WHEN regexp_matches(title, '(?i){vr.GUESTS}') THEN trim(regexp_extract(title, '(?is)^(.*?){vr.GUESTS}', 1)) ELSE trim(title) END AS clean, trim(regexp_replace(artist, '(?is)^(.*?){vr.GUESTS}(.*)$', '\\1\\3')) AS own,
  list_concat({_names(f"regexp_extract(title, '(?i){vr.GUESTS}', 1)")}, {_names(f"regexp_extract(artist, '(?i){vr.GUESTS}', 1)")}) AS guests FROM t),
v AS (SELECT *, CASE {_CASES} END AS v FROM c), o AS (SELECT *, {_names("coalesce(v.maker, '')")} AS makers, trim(lower(regexp_replace(trim(coalesce(v.before, clean)), '\\s*[-–—]\\s*$', ''))) AS base, coalesce(v.type, 'original') AS kind FROM v)"""


def _versions(spark, sf):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", pick(FORMS, k)).alias("title"), pick(CREDITS, F.floor(k / len(FORMS))).alias("artist"))
    return vr.with_version(rows, "title", "artist")


@register("version_identity", f"""
WITH {_VERSIONS} SELECT p_partkey, base AS base_title, kind AS type, array_to_string(list_filter({_names('own')}, lambda a: NOT list_contains(list_transform(makers, lambda m: lower(m)), lower(a))), ',') AS artists, array_to_string(guests, ',') AS featured, array_to_string(makers, ',') AS version_artists,
  regexp_replace(regexp_replace(v.text, '^[(\\[\\s]+', ''), '[\\s)\\]]+$', '') AS raw_version, CASE WHEN v IS NULL THEN 0.9::DOUBLE ELSE 1 END AS confidence FROM o""")
def version_identity(spark, sf):
    v = _versions(spark, sf).select("p_partkey", "version.*")
    return v.select("p_partkey", "base_title", "type", *[F.array_join(c, ",").alias(c) for c in ("artists", "featured", "version_artists")], "raw_version", "confidence")


@register("version_match", f"""
WITH {_VERSIONS}, b AS (SELECT p_partkey // 2 AS pair, base, kind, list_transform(makers, lambda m: lower(m)) AS makers, p_partkey % 2 AS side FROM o) SELECT x.pair, CASE WHEN x.base <> y.base THEN 'reject' WHEN x.kind = y.kind AND (len(x.makers) + len(y.makers) = 0 OR list_has_any(x.makers, y.makers)) THEN 'exact' ELSE 'sibling' END AS match FROM b x JOIN b y ON x.pair = y.pair AND x.side = 0 AND y.side = 1""")
def version_match(spark, sf):
    """Neighbours by number against each other."""
    v = _versions(spark, sf).select(F.floor(F.col("p_partkey") / 2).alias("pair"), (F.col("p_partkey") % 2).alias("side"), "version")
    a, b = v.filter("side = 0").select("pair", F.col("version").alias("a")), v.filter("side = 1").select("pair", F.col("version").alias("b"))
    return a.join(b, "pair").select("pair", vr.matching(F.col("a"), F.col("b")).alias("match"))
