"""Genre labels: known cases as a table, and that a label once out comes out again."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import genres as gn

CASES = {
    "house": "House", "deep house": "Deep House", "afro house": "Afro House", "Electronic/House": "House", "Tech House/Tribal": "Tech House", "Dance / Electro Pop": "Electro Pop", "Hip Hop/Rap": "Hip-Hop", "Electronic/Techno": "Techno",
    "Electronic/Tech House": "Tech House", "Dance & EDM": "Dance", "R&B": "R&B", "R&B/Soul": "R&B", "Drum & Bass": "Drum & Bass", "Melodic House & Techno": "Melodic House & Techno", "Hip-Hop & Rap": "Hip-Hop & Rap", "Hip-hop \\u0026 rap": "Hip-Hop & Rap",
    "Techno (Peak Time / Driving)": "Techno", "hiphop": "Hip-Hop", "nu disco": "Nu-Disco", "Nu-Disco": "Nu-Disco", "r&b soul": "R&B Soul", "R&B Soul": "R&B Soul", "": None, "Music": None, "unknown": None, "fixme": None, "https://djsoundtop.com": None,
    "djsoundtop.com Top 100": None, "House electronic swedish european edm trance": None, "Electronic uk garage edm future garage dance garage stutter house downtempo": None, "Deep House/Indie Dance/Nu Disco": "Deep House", "Edits / Bootlegs": None,
    " / , & ": None, "house\\": None, "drum  &  bass": "Drum & Bass", None: None,
}


@pytest.fixture(scope="module")
def refolded(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "g string")
    return df.select("g", gn.refold(F.col("g")).alias("r")).select("g", "r.*").cache()


def test_labels(refolded):
    assert {r.g: r.label for r in refolded.collect()} == CASES


def test_what_was_done(refolded):
    got = {r.g: (r.escaped, r.split, r.aliased) for r in refolded.collect()}
    assert got["Hip-hop \\u0026 rap"] == (True, False, True) and got["Electronic/House"] == (False, True, True) and got["https://djsoundtop.com"] == (False, False, False)
    assert got[None] == got[""] == (False, False, False)


def test_a_label_comes_out_again(refolded):
    again = refolded.filter("label IS NOT NULL").select("label", gn.refold(F.col("label")).alias("r"))
    assert again.filter("label <> r.label OR r.split OR r.escaped OR r.label IS NULL").count() == 0


def test_escapes(spark):
    cases = {"Hip-hop \\u0026 rap": "Hip-hop & rap", "r\\u0026b": "r&b", "Deep House": "Deep House", "\\ud83d\\ude00!": "😀!", "a\\u00e9\\u00E9b\\u12": "aééb\\u12", "": "", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "g string").select("g", gn.repair_escapes(F.col("g")).alias("r"))
    assert {r.g: r.r for r in got.collect()} == cases


def test_families(spark):
    family = {"Eurodance": "edm", "Nightcore": "edm", "Big Room": "edm", "Hardtekk": "techno", "Deep House": "house", "Melodic House & Techno": "house", "Drum & Bass": "bass", "bass house": "bass", "afro house": "groove", "psy": "trance", "psyche": None, "future bass": "bass", "future rave": "edm", "loop samples": None, "Jazz": "mood", "polka": None, "groove": "groove", "Dance": "edm", "EDM": "edm", None: None}
    scored = {k: None if k in ("Dance", "EDM") else v for k, v in family.items()}
    got = spark.createDataFrame([(k,) for k in family], "g string").select("g", gn.family(F.col("g")).alias("f"), gn.scoring_family(F.col("g")).alias("s")).collect()
    assert {r.g: r.f for r in got} == family and {r.g: r.s for r in got} == scored


def version_of(spark, cases):
    from marlstone.functions import versions

    df = spark.createDataFrame(cases, "title string, artist string")
    return {(r.title, r.artist): r.version.asDict() for r in versions.with_version(df, "title", "artist").collect()}


def test_versions(spark):
    cases = [
        ("Song (Ann Remix)", "Bob"), ("Song [Ann & Cy RMX]", "Ann, Bob"), ("Song - Ann Remix", "Bob"), ("Song (Radio Edit)", "Bob"), ("Song (Ann Edit)", None), ("Song (VIP)", "A x B"), ("Song (Ann VIP)", "B"), ("Song (Club Mix) [2020]", "B"), ("Song (Live at Home)", "B"),
        ("Song feat. Dee & Eve", "B ft. Fay"), ("Song feat. Dee (Ann Remix)", "B"), ("Song -", "B vs. C"), ("Plain Song", "B feat. Dee (live)"), (" Über – ", "B"), (None, None), ("(Ann Remix)", "B"), ("A (b) Song (Ann Rework)", "B"),
    ]
    got = version_of(spark, cases)
    short = lambda t, a: (got[t, a]["base_title"], got[t, a]["type"], got[t, a]["version_artists"], got[t, a]["raw_version"])
    assert short("Song (Ann Remix)", "Bob") == ("song", "remix", ["Ann"], "Ann Remix")
    assert short("Song [Ann & Cy RMX]", "Ann, Bob") == ("song", "remix", ["Ann", "Cy"], "Ann & Cy RMX") and got["Song [Ann & Cy RMX]", "Ann, Bob"]["artists"] == ["Bob"]
    assert short("Song - Ann Remix", "Bob") == ("song", "remix", ["Ann"], "- Ann Remix")
    assert short("Song (Radio Edit)", "Bob") == ("song", "radio", [], "Radio Edit") and short("Song (Ann Edit)", None) == ("song", "edit", ["Ann"], "Ann Edit")
    assert short("Song (VIP)", "A x B") == ("song", "vip", [], "VIP") and got["Song (VIP)", "A x B"]["artists"] == ["A", "B"] and short("Song (Ann VIP)", "B")[2] == ["Ann"]
    assert short("Song (Club Mix) [2020]", "B") == ("song", "extended", [], "Club Mix") and short("Song (Live at Home)", "B")[1] == "live"
    assert got["Song feat. Dee & Eve", "B ft. Fay"] == {"base_title": "song", "artists": ["B"], "featured": ["Dee", "Eve", "Fay"], "type": "original", "version_artists": [], "raw_version": None, "confidence": 0.9}
    assert got["Song feat. Dee (Ann Remix)", "B"]["type"] == "original"  # all behind the guests goes with them
    assert short("Song -", "B vs. C")[0] == "song" and got["Plain Song", "B feat. Dee (live)"]["featured"] == ["Dee"] and short(" Über – ", "B")[0] == "über"
    assert short(None, None) == ("", "original", [], None) and short("(Ann Remix)", "B")[0] == "" and short("A (b) Song (Ann Rework)", "B")[:3] == ("a", "rework", ["b) Song (Ann"])


def test_versions_against_each_other(spark):
    from marlstone.functions import versions

    titles = ["Song (Ann Remix)", "song (ann & bob remix)", "Song (Cy Remix)", "Song", "Song (Original Mix)", "Other", "Song (VIP)"]
    df = versions.with_version(spark.createDataFrame([(i, t, "z") for i, t in enumerate(titles)], "i int, title string, artist string"), "title", "artist").select("i", "version")
    pairs = df.alias("a").join(df.alias("b"), F.col("a.i") < F.col("b.i")).select("a.i", F.col("b.i").alias("j"), versions.matching(F.col("a.version"), F.col("b.version")).alias("m"))
    got = {(r.i, r.j): r.m for r in pairs.collect()}
    assert got[0, 1] == "exact" and got[0, 2] == "sibling" and got[3, 4] == "exact" and got[0, 3] == "sibling" and got[3, 5] == "reject" and got[3, 6] == "sibling"
