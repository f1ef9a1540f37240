"""The registered queries of the corpus operators, with production parameters and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.cluster import load
from spindrift.llm.decontam import contamination
from spindrift.llm.langid import languages
from spindrift.llm.licenses import scan_licenses
from spindrift.llm.lm import score_texts
from spindrift.llm.media import encode, inspect
from spindrift.llm.mixing import mix
from spindrift.llm.neardup import near_duplicates
from spindrift.llm.oracles import ORACLES
from spindrift.llm.quality import quality
from spindrift.llm.spans import dedup_spans
from spindrift.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score and 1 from 0.3 on."""
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score and 1 from 0.7 on."""
    return quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies, linked at 0.8 on two-word shingles."""
    return near_duplicates(load(spark, sf_dir, "documents"), k=2, percent=80)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    return languages(load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a copy of a benchmark item, with its place and score."""
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words of it that the mix of all sources takes."""
    return mix(load(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a WAV file and read back, with digests and features."""
    return inspect(encode(load(spark, sf_dir, "documents"))).drop("carved")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its license phrases and labels."""
    return scan_licenses(load(spark, sf_dir, "documents"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its unigram base score and its score by the class model."""
    return score_texts(load(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose a repeated passage, with the text that is left of them."""
    return dedup_spans(load(spark, sf_dir, "documents")).where("n_removed > 0")


QUERIES = {
    q.__name__: q
    for q in (op1_toxicity, op2_quality, op3_minhash_neardup, op4_language, op5_decontamination, op6_mixing, op7_media, op8_licenses, op9_class_lm, op10_substring_dedup)
}
__all__ = ["ORACLES", "QUERIES"]
