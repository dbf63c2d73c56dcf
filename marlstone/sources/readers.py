"""Sources: file trees, XML, JSON lines, annotation files; all lazy Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JUNK_NAMES = (".ds_store", "thumbs.db", "desktop.ini")


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A read-only SQL query with named parameters."""
    return spark.sql(sql, args=args)


def tree(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """``path, relative, bytes, modified`` of the files below ``root``; hidden and junk files are left out.

    Only metadata is read: the content column of the binary source is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    keep = ~name.startswith(".") & ~name.isin(*JUNK_NAMES)
    if suffixes:
        keep = keep & F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*suffixes)
    marker = root.rstrip("/").rsplit("/", 1)[-1]
    return files.filter(keep).select("path", F.regexp_extract("path", f"/{marker}/(.*)$", 1).alias("relative"), "bytes", "modified")


def releases_xml(spark: SparkSession, path: str, row_tag: str = "release", schema: str = "_id long, title string, artists struct<artist:array<struct<name:string>>>, genres struct<genre:array<string>>, styles struct<style:array<string>>", genre: str | None = None) -> dict[str, DataFrame]:
    """A release dump as four tables: releases, artists, genres, styles; optionally of one genre. Gzip is read as it is."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    if genre:
        rows = rows.filter(F.array_contains("genres.genre", genre))
    part = lambda c, name: rows.select(F.col("_id").alias("id"), F.explode(c).alias(name))
    return {"releases": rows.select(F.col("_id").alias("id"), "title"), "artists": part("artists.artist.name", "artist"), "genres": part("genres.genre", "genre"), "styles": part("styles.style", "style")}


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and, apart, the lines that are no JSON of this schema. One bad line never fails a read."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).select("value", parsed.alias("r"))
    return rows.filter("r._bad is null").select("r.*").drop("_bad"), rows.filter("r._bad is not null").select(F.col("value").alias("_bad"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Text annotations, a file each: ``path, value, ok``; the first tab-separated field as a number or a key."""
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.trim(F.split("value", r"[\t\n]")[0]).alias("value"))
    number = F.col("value").try_cast("double")
    return text.withColumn("ok", number.isNotNull() | F.col("value").rlike("^[A-G][#b]? ?(major|minor|maj|min|m)?$"))


def vector(json: Column) -> Column:
    """A JSON array as doubles; null unless it has elements and all are finite numbers."""
    v = F.from_json(json, "array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, v)


def votes(json: Column) -> Column:
    """An array of votes; elements without a label are dropped one by one."""
    v = F.from_json(json, "array<struct<rung:string,genre:string,weight:double,detail:string>>")
    return F.filter(v, lambda x: x["genre"].isNotNull())


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded random order that does not depend on partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


#: Fixed values of the gold annotations: the version read and the branches there are.
GOLD_VERSION, BRANCHES = 1, ("house", "trap", "unknown")


def gold_annotations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Annotation files (``*.json``, one object each) as good rows and, apart, ``file, error`` of the others.

    A bad file costs its own row only. The error names the first field that fails, in the order hash,
    version, branch, firstDownbeatMs, bpm, phraseBars, hotCuesMs, note; a field of another JSON type
    fails as a missing one does. Good rows keep ``file``.
    """
    text = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.try_parse_json("value").alias("v"))
    kind = F.lower(F.schema_of_variant("v"))
    get = lambda path, t: F.try_variant_get("v", f"$.{path}", t)
    said = lambda path: F.lower(F.schema_of_variant(get(path, "variant")))
    string = lambda path: F.when(said(path) == "string", get(path, "string"))
    number = lambda path: F.when(said(path).rlike("^(bigint|double|decimal)"), get(path, "double"))
    numbers = lambda path: F.when(said(path).rlike("^array<(void|bigint|double|decimal)"), get(path, "array<double>"))
    rows = text.select(
        "file", F.col("v").isNull().alias("broken"), (~kind.startswith("object")).alias("other"), string("hash").alias("hash"), number("version").alias("version"), string("branch").alias("branch"), number("firstDownbeatMs").alias("first_downbeat_ms"),
        number("bpm").alias("bpm"), numbers("phraseBars").alias("phrase_bars"), numbers("hotCuesMs").alias("hot_cues_ms"), string("note").alias("note"), F.coalesce(said("note") != "string", F.lit(False)).alias("odd_note"),
    )
    fine = lambda c, least: F.coalesce((F.col(c) >= least) & (F.col(c) < float("inf")), F.lit(False))
    every = lambda c, test: F.coalesce(F.forall(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    rising = lambda c: F.forall(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(c))), lambda i: F.coalesce(F.get(c, i - 1) > F.get(c, i - 2), F.lit(True)))
    checks = [
        (F.col("broken"), "not valid JSON"),
        (F.col("other"), "annotation must be a JSON object"),
        (~F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash must be 64 hex digits"),
        (~F.coalesce(F.col("version") == GOLD_VERSION, F.lit(False)), f"version must be {GOLD_VERSION}"),
        (~F.coalesce(F.col("branch").isin(*BRANCHES), F.lit(False)), f"branch must be one of {', '.join(BRANCHES)}"),
        (~fine("first_downbeat_ms", 0), "firstDownbeatMs must be a number of 0 or more"),
        (~fine("bpm", 1), "bpm must be a number of 1 or more"),
        (F.col("bpm") > 400, "bpm must be 400 or less"),
        (~every("phrase_bars", lambda x: (x >= 1) & (x == F.floor(x))), "phraseBars must be whole numbers of 1 or more"),
        (~rising("phrase_bars"), "phraseBars must rise"),
        (~every("hot_cues_ms", lambda x: (x >= 0) & (x < float("inf"))) | (F.size("hot_cues_ms") > 8), "hotCuesMs must be up to 8 times of 0 or more"),
        (~rising("hot_cues_ms"), "hotCuesMs must rise"),
        (F.col("odd_note"), "note must be a string"),
    ]
    error = F.coalesce(*[F.when(test, reason) for test, reason in checks])
    judged = rows.withColumn("error", error)
    good = judged.filter("error IS NULL").select("file", "hash", "branch", "first_downbeat_ms", "bpm", F.col("phrase_bars").cast("array<int>").alias("phrase_bars"), "hot_cues_ms", "note")
    return good, judged.filter("error IS NOT NULL").select("file", "error")


def dev_and_holdout(annotations_: DataFrame, key: str = "hash") -> DataFrame:
    """With ``side``: the first two thirds (rounded half up) in the order of the key are ``dev``, the rest ``holdout``; the order of the input changes nothing."""
    from marlstone.operators.ranks import number_rows

    n = annotations_.count()
    dev = (2 * n * 2 + 3) // 6
    return number_rows(annotations_, [F.col(key)], "__n").withColumn("side", F.when(F.col("__n") <= dev, "dev").otherwise("holdout")).drop("__n")
