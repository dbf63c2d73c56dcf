"""From raw documents to a mixed training corpus, in five stages of the ``llm`` operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the caller writes it as
Parquet and reads it back as the next stage's ``docs``. Stages read the columns of ``documents``;
others, whatever their names, go. In every stage null ids are allowed, null and empty texts are
kept (by the first: unless the classifier rejects texts without words), repeated rows fare alike, a
very long text is judged whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, lines, mixing, neardup, quality
from marlstone.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIXED = ["copies", "rate", "source_size", "target", "taken"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier rejects go. It learns from the labelled documents among them."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sources go; every document stays."""
    cleaned = lines.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return neardup.keep_one(docs).select(*COLUMNS)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with the number of copies, words, rate and target of each."""
    plan = mixing.mix(docs).filter("copies > 0").groupBy("doc_id", "size").agg(*[F.max(c).alias(c) for c in MIXED])
    words = mixing.word_count(F.col("text"))
    keyed = docs.select(*COLUMNS).withColumn("__size", words)
    plan = plan.withColumnsRenamed({"doc_id": "__id", "size": "__words"})
    return keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__words"))).select(*COLUMNS, F.col("__size").alias("size"), *MIXED)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
]

#: The learnt first stage and the hashed third have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
