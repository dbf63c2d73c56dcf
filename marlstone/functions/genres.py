"""Genre labels: repair, splitting, one spelling for each, and the family a label votes for. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that hold an ampersand, spellings with a form of their own, parents that are no
# genre, what is no label, and the families in the order in which they are tried.
JOINED = ("r&b", "drum&bass", "hip-hop&rap", "hip hop&rap", "melodic house&techno")
SPELLINGS = {
    "edm": "EDM", "mainstage edm": "Mainstage EDM", "r&b": "R&B", "r & b": "R&B", "hiphop": "Hip-Hop", "hip hop": "Hip-Hop", "hip-hop": "Hip-Hop", "hip-hop & rap": "Hip-Hop & Rap", "hip hop & rap": "Hip-Hop & Rap",
    "drum & bass": "Drum & Bass", "drum and bass": "Drum & Bass", "melodic house & techno": "Melodic House & Techno", "nu disco": "Nu-Disco", "nu-disco": "Nu-Disco", "edm bass": "EDM Bass",
}
PARENTS = ("edm", "dance", "electronic", "mainstage edm")
PLACEHOLDERS = ("", "music", "unknown", "fixme")
PRODUCTS = r"\bloop samples\b|\bdj tools\b"
FAMILIES = (
    (r"drum ?and ?bass|jungle|breakbeat|breaks|bass|dubstep|footwork|juke|grime|jersey club|donk|wall slappers", "bass"),
    (r"(?<!bass |afro )house|disco|garage|boogie", "house"),
    (r"techno|melodic|minimal(?! \/)|deep tech|hardtekk|softtekk|tekk", "techno"),
    (r"trance|psy(?![a-z])", "trance"),
    (r"hip ?[- ]?hop|rap|trap", "hiphop"),
    (r"edm|electro|big ?room|future (?!bass)|hardstyle|bounce|eurodance|euro ?dance|nightcore|uptempo|hard dance|hardcore", "edm"),
    (r"pop|rock|indie|alternative|punk|metal|folk|singer|country|top 40|chanson", "pop"),
    (r"r ?& ?b|soul|funk|amapiano|afrobeat|afro ?house|reggaeton|latin|dancehall|reggae", "groove"),
    (r"jazz|blues|ambient|downtempo|lofi|lo ?fi|classical|soundtrack|idm|chillwave|synthwave|world|spoken word|tutorial", "mood"),
    (r"\bgroove\b", "groove"),
    (r"\bdance\b|mainstream club", "edm"),
)
ESCAPES = r"(?:\\u[0-9a-fA-F]{4})+"
ADDRESS = r"(?i)https?://|\b[\w-]+\.(?:com|net|org|io|co|ru|xyz|top)\b"

#: Stands for the ampersand of a joined name while others separate labels.
_KEPT = "\ue000"


def _once(x: Column, fn) -> Column:
    """``fn`` of a value that is worked out once a row, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(x), fn), 0)


def repair_escapes(s: Column) -> Column:
    """Written-out escapes like ``\\u0026`` as the characters they name; a run of them is read as one, so pairs hold together."""
    runs = F.transform(F.regexp_extract_all(s, F.lit(ESCAPES), F.lit(0)), lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
    parts = F.split(s, ESCAPES)
    return F.array_join(F.zip_with(parts, F.concat(runs, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def normalise(genre: Column) -> Column:
    """The first label in lower case, without remarks in brackets; null for placeholders."""
    first = F.trim(F.split_part(F.lower(repair_escapes(genre)), F.lit(","), F.lit(1)))
    base = F.trim(F.regexp_replace(first, r"\(.*?\)", ""))
    return F.when(~base.isin(*PLACEHOLDERS), base)


def family(genre: Column) -> Column:
    """The first family in order that claims a label; null for placeholders, products and what no family claims."""

    def ladder(base: Column) -> Column:
        out = F.when(base.isNull() | base.rlike(PRODUCTS), None)
        for pattern, name in FAMILIES:
            out = out.when(base.rlike(pattern), name)
        return out

    return _once(normalise(genre), ladder)


def _titled(label: Column) -> Column:
    """First letters of words, of parts joined by a hyphen and of those joined by an ampersand as capitals."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    hyphened = lambda w: F.array_join(F.transform(F.split(w, "-"), capital), "-")
    words = lambda c: F.array_join(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), hyphened), " ")
    return F.array_join(F.transform(F.split(label, "&"), words), "&")


def refold(genre: Column) -> Column:
    """``label, escaped, split, aliased``: the one label to store for a raw one, and what was done to it.

    Escapes are repaired, remarks in brackets go, and the rest is split at ``/``, ``,`` and ``&``,
    though not at the ampersand of a joined name. The first label that is no mere parent stays, or
    else the first. Blanks are single before labels are compared. A null label proposes nothing:
    placeholders, web addresses, five words or more, odd characters, and labels without a family.
    A label that came out once comes out again.
    """
    raw = F.trim(genre)
    escaped = raw.rlike(ESCAPES)
    low = F.lower(F.regexp_replace(repair_escapes(raw), r"\(.*?\)", ""))
    for name in JOINED:
        a, b = (p.replace(" ", r"\s*") for p in name.split("&"))
        low = F.regexp_replace(low, rf"({a}\s*)&(\s*{b})", f"$1{_KEPT}$2")
    labels = F.filter(F.transform(F.split(low, "[/,&]"), lambda t: F.trim(F.regexp_replace(F.translate(t, _KEPT, "&"), r"\s+", " "))), lambda t: t != "")
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    parent = lambda t: F.lower(F.coalesce(F.try_element_at(spelled, t), t)).isin(*PARENTS)
    usable = ~F.lower(raw).isin(*PLACEHOLDERS) & ~raw.rlike(ADDRESS)
    yes = lambda c: F.coalesce(c, F.lit(False))
    known = yes(~F.lower(raw).isin(*PLACEHOLDERS))

    def settle(v: Column) -> Column:
        primary = v["primary"]
        sound = ~primary.rlike(ADDRESS) & (F.size(F.split(primary, " ")) < 5) & primary.rlike("^[a-z0-9][a-z0-9 &'-]*$") & family(primary).isNotNull()
        label = F.when(usable & sound, F.coalesce(F.try_element_at(spelled, primary), _titled(primary)))
        return F.struct(label.alias("label"), primary.alias("primary"), v["n"].alias("n"))

    def choose(found: Column) -> Column:
        primary = F.coalesce(F.get(F.filter(found, lambda t: ~parent(t)), 0), F.get(found, 0))
        return F.struct(primary.alias("primary"), F.size(found).alias("n"))

    def told(v: Column) -> Column:
        return F.struct(v["label"].alias("label"), (known & yes(escaped)).alias("escaped"), yes(usable & (v["n"] > 1)).alias("split"), yes(v["label"] != v["primary"]).alias("aliased"))

    return _once(_once(_once(labels, choose), settle), told)


def scoring_family(genre: Column) -> Column:
    """The family a label is scored as: none for a mere parent, which has no child's evidence."""
    label = refold(genre)["label"]
    return F.when(~F.coalesce(F.lower(label).isin(*PARENTS), F.lit(False)), family(genre))
