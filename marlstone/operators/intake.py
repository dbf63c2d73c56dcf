"""Intake of new files: a cascade of duplicate tests, each over what the one before let through, ending at the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalar import token_ratio, tokens
from marlstone.operators.joins import join_by_size
from marlstone.session import materialise

# How alike names with one fingerprint must be, and by how much a new file must beat the archive's.
ALIKE, BETTER = 0.5, 1.05
LOSSLESS = "wav|aif|aiff|flac"


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def stem(path: Column) -> Column:
    """A file's name without its suffix, in lower case, only letters and digits."""
    return F.regexp_replace(F.lower(F.regexp_replace(base_name(path), r"\.[^.]+$", "")), "[^a-z0-9]", "")


def _best() -> Column:
    """Ascending: the best score (unknown ones last), then the shortest name, then the first id."""
    return F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.char_length(base_name(F.col("file"))).alias("c"), "id")


def _leaders(rows: DataFrame, key: list[str]) -> DataFrame:
    """``*key, lead, lead_file, n`` of every key that two rows or more share; grouped, so a common key is no burden."""
    known = rows
    for c in key:
        known = known.filter(F.col(c).isNotNull())
    lead = F.min(F.struct(_best().alias("o"), "file"))
    found = known.groupBy(*key).agg(lead.alias("l"), F.count("*").alias("n")).filter("n > 1")
    return materialise(found.select(*key, F.col("l.o.id").alias("lead"), F.col("l.file").alias("lead_file"), "n"))


def cascade(records: DataFrame, archive: DataFrame) -> DataFrame:
    """``id, outcome, keeper, review`` of every incoming file.

    ``records``: id, file, identity, size, md5, score, fp (acoustic fingerprint, null if unread).
    ``archive``: id, identity, file, score. Each test sees the survivors of the one before; the first
    claim is final and names the file that stays in ``keeper``:

    * ``identity``: of one identity the best stays: by score, then the shorter name, then the id;
    * ``content``: the same of one size and digest;
    * ``lossless twin``: an mp3 beside a lossless file of the same stem goes whatever its score;
    * ``recording``: of one fingerprint, a file whose name shares half its tokens with the best one's;
      other names may be a collision: both stay and the best one is put in ``review``;
    * ``self``: the archive's file of this identity is this very file; ``archived``: the archive's is
      as good; ``upgrade``: the new one's score is over 1.05 times as high; else ``new``.

    The archive's first file (least id) of an identity counts. Null identities, digests and
    fingerprints match nothing, a null score is the lowest. Ids are unique.
    """
    live = materialise(records.select("id", "file", "identity", "size", "md5", "score", "fp"))
    claims = []

    def settle(claimed: DataFrame, outcome: str) -> None:
        nonlocal live
        gone = materialise(claimed.select("id", F.lit(outcome).alias("outcome"), "keeper"))
        claims.append(gone)
        live = materialise(live.join(gone.select("id"), "id", "left_anti"))

    def shared(key: list[str]) -> DataFrame:
        return join_by_size(live, _leaders(live, key), key).filter("id <> lead").withColumn("keeper", F.col("lead"))

    settle(shared(["identity"]), "identity")
    settle(shared(["size", "md5"]), "content")
    suffix = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    named = live.withColumns({"suffix": suffix, "stem": stem(F.col("file"))})
    lossless = named.filter(F.col("suffix").isin(*LOSSLESS.split("|"))).groupBy("stem").agg(F.min("id").alias("keeper"))
    settle(named.filter("suffix = 'mp3'").join(lossless, "stem"), "lossless twin")
    met = materialise(shared(["fp"]).withColumn("alike", token_ratio(tokens(base_name(F.col("file"))), tokens(base_name(F.col("lead_file"))))))
    settle(met.filter(F.col("alike") >= ALIKE), "recording")
    doubts = met.filter(F.coalesce(F.col("alike"), F.lit(0.0)) < ALIKE).select("id", F.col("keeper").alias("review"))
    first = archive.filter(F.col("identity").isNotNull() & F.col("file").isNotNull()).groupBy("identity").agg(F.min(F.struct("id", "file", "score")).alias("a"))
    judged = live.join(first, "identity", "left")
    beats = F.col("score") > F.coalesce(F.col("a.score"), F.lit(-1.0)) * BETTER
    outcome = F.when(F.col("a").isNull(), "new").when(F.col("a.file") == F.col("file"), "self").when(beats, "upgrade").otherwise("archived")
    out = judged.select("id", outcome.alias("outcome"), F.col("a.id").alias("keeper"))
    for c in claims:
        out = out.unionByName(c)
    return out.join(doubts, "id", "left")
