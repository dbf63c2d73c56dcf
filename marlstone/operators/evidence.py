"""Votes and catalogues as evidence rows: ``track, annotator, scope, family, subgenre, confidence``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a vote of each rung says something about, and how far it is trusted.
RUNGS = {
    "bp": ("exact_recording", 0.9),
    "file": ("exact_recording", 0.85),
    "discogs": ("exact_recording", 0.85),
    "bc": ("exact_recording", 0.8),
    "ai": ("artist", 0.7),
    "mb": ("same_song_other_version", 0.75),
    "sc": ("artist", 0.5),
    "lastfm": ("user", 0.6),
    "sync": ("user", 0.3),
    "imprint": ("label", 0.4),
}
# The versions that somebody other than the artist made.
REMIXED = ("remix", "edit", "bootleg", "flip", "vip", "rework")
ROW = ["track", "annotator", "scope", "family", "subgenre", "confidence"]


def votes_to_evidence(votes: DataFrame, family: Column) -> DataFrame:
    """One row per vote of ``votes(track, rung, genre)`` that has a family; of equal keys (all but subgenre and confidence) the least genre stays."""
    rung = lambda i: F.create_map(*[F.lit(x) for k, v in RUNGS.items() for x in (k, v[i])])[F.col("rung")]
    rows = votes.withColumn("family", family).filter("family is not null").withColumns({"scope": rung(0), "confidence": rung(1)}).filter("scope is not null")
    rows = rows.withColumn("annotator", F.concat(F.lit("vote:"), F.col("rung"))).groupBy("track", "annotator", "scope", "family").agg(F.min("genre").alias("genre"), F.first("confidence").alias("confidence"))
    return rows.withColumn("subgenre", F.when(F.col("genre") != F.col("family"), F.col("genre"))).select(*ROW)


def remixer_prior(tracks: DataFrame, catalog: DataFrame) -> DataFrame:
    """The families of a remixer's catalogue ``(artist, family, confidence)`` for every remixed row of ``tracks(track, version, remixer)``."""
    made = tracks.filter(F.col("version").isin(*REMIXED) & (F.col("remixer") != "")).withColumn("__who", F.lower("remixer"))
    rows = made.join(catalog.withColumn("__who", F.lower("artist")), "__who")
    return rows.select("track", F.concat(F.lit("remixer:catalog:"), F.col("__who")).alias("annotator"), F.lit("remixer").alias("scope"), "family", F.lit(None).cast("string").alias("subgenre"), "confidence")


def with_collapsed(evidence: DataFrame, sibling: str = "same_song_other_version") -> DataFrame:
    """Direct evidence as it is, and of the siblings' one row per track and family, in any case: the most confident, ties by annotator."""
    direct = evidence.filter(~F.col("scope").eqNullSafe(sibling)).select(*ROW)
    best = evidence.filter(F.col("scope") == sibling).groupBy("track", F.lower("family")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "annotator", "scope", "family", "subgenre")).alias("b"))
    return direct.unionByName(best.select("track", F.concat(F.lit("sibling:collapsed:"), "b.annotator").alias("annotator"), "b.scope", "b.family", "b.subgenre", (-F.col("b.c")).alias("confidence")))
