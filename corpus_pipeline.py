"""Corpus preparation: stages over ``documents``, each written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import circulant_minhash, decontaminate, line_runs, packing, toxicity
from seriesmill.llm.sampling import held_out
from seriesmill.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the labels learned from are those outside the held-out fifth.

    Null and empty texts get the score of the bias.  Without labels all documents score a quarter and stay.
    """
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    weights = toxicity.fit(labels.where(~held_out("id")), docs.select(F.col("doc_id").alias("id"), "text"))
    return docs.where(toxicity.score(weights) < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go, and ``n_chars`` follows; documents of which nothing is left go too.

    Null and empty texts stay as they are.
    """
    cut = line_runs.dedup_lines(docs)
    emptied = (F.col("lines_deleted") > 0) & (F.length("text") == 0)
    return cut.where(~F.coalesce(emptied, F.lit(False))).withColumn(
        "n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    ).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows that repeat an id and a text stay or go together; a row without an id, and one without text, stays.
    """
    found = circulant_minhash.near_duplicates(docs)
    gone = found.where("NOT kept").select(F.col("id").alias("doc_id"), "th").distinct()
    marked = docs.withColumn("__th", F.xxhash64("text"))
    return marked.join(gone.withColumnRenamed("th", "__th"), ["doc_id", "__th"], "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty comes from a benchmark window of 13 words; those without words stay."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    return decontaminate.contamination(docs, items).where("NOT contamination.contaminated").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of at most 4096 tokens in the training sequences; a null or empty text is the end token alone."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The first stage scores with a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; every result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
