"""The stages of the corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, mixing to target weights.

Each takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of ``documents``;
the last adds the size and the number of the copy.  In every stage texts may be of any length, extra columns
are dropped whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.cluster import columns_only, cut, load, small
from spindrift.llm.decontam import contamination
from spindrift.llm.mixing import mix
from spindrift.llm.neardup import near_duplicates
from spindrift.llm.spans import dedup_spans
from spindrift.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``dropped``; rows with a null doc_id stay."""
    return docs.join(small(cut(dropped.select("doc_id").distinct())), "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity score rejects (0.3 or more).

    Each row is judged by its text alone: repeated rows and rows with a null id go or stay like any other,
    null and empty texts stay; without labels nothing goes.
    """
    scored = toxicity(docs, load(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group linked at 0.8 on five-word shingles.

    Null and empty texts are linked with nothing and stay, and so do rows with a null id; rows that share an
    id are one document, kept or dropped together.
    """
    docs = columns_only(docs, *COLUMNS)
    return _without(docs, near_duplicates(docs, k=5, percent=80).where("not kept")).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; every row stays, if with less text.

    The first occurrence is in the smallest id; rows that share an id are one document; a null id is searched
    only inside itself; null and empty texts stay as they are.
    """
    return dedup_spans(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy of a benchmark item.

    Rows that share an id go together; rows with a null id cannot be dropped by id and stay, as do null and
    empty texts; an empty benchmark drops nothing.
    """
    docs = columns_only(docs, *COLUMNS)
    return _without(docs, contamination(docs, load(spark, sf_dir, "benchmark"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document in the mix: the columns of documents, size, and copy from 1 on.

    Rows are mixed each by itself, repeated ones and those with a null id too; texts without words are not
    taken.
    """
    rows = cut(columns_only(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    taken = mix(rows, row="row").where("copies > 0").select("row", "size", F.col("copies").cast("int").alias("copies"))
    return rows.join(taken, "row").select(*COLUMNS, "size", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each is cut before the next reads it."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
