"""Labelled rows for the classifiers: a bounded, fixed sample outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.shared import crc_of_id


def held_out(modulus: int, remainder: int):
    """Whether a row is in the fold that no model learns from; false for rows without an id, which have no label either."""
    return F.coalesce(crc_of_id() % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents, the first by a hash of the id; labels other than 0 and 1 are left out.

    Of rows that repeat a labelled id the one with the least text is taken.
    """
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    few = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
