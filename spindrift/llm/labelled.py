"""The bounded labelled sample that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.cluster import columns_only, cut


def remainder(modulus: int):
    return (F.crc32(F.col("doc_id").cast("string")) % modulus).cast("int")


def held_out(modulus: int, rest: int):
    """Whether crc32(doc_id as text) leaves ``rest``; a null doc_id is in no fold and counts as not held out."""
    return F.coalesce(remainder(modulus) == rest, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int, modulus: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out fold, the first by a hash of doc_id.

    Rows with a null doc_id or label are passed over; of repeated label rows the largest label counts, of repeated
    documents the smallest text, so what is learned from is bounded by ``limit`` texts.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(remainder(modulus) != rest)
    picked = cut(y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return columns_only(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
