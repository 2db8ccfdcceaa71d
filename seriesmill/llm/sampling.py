"""Held-out split and bounded training samples shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True for a fifth of the ids, by ``crc32`` of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_sample(labels: DataFrame, docs: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` labelled texts: columns ``id, label, text``.

    ``labels`` has ``id, label`` (one row per id is kept, the largest label), ``docs`` has ``id, text``
    (the smallest text of an id).  Ids are taken in the order of a hash, so the sample is random but
    the same in every run.  The id list has at most ``bound`` rows, whatever the corpus.
    """
    chosen = (
        labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.col("id").cast("string")), F.col("id")).limit(bound)
    )
    return docs.where("text IS NOT NULL").join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
