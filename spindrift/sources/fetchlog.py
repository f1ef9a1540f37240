"""Fetch logs as tables: JSON lines of responses, read with a fixed schema, bad lines kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import identity, urls
from spindrift.functions.shared import shared_folder

SCHEMA = "url string, hop int, status int, headers map<string,string>, body string, _corrupt string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(url, code, hop, status, mime, body, n_bytes, corrupt): each line with its URL judged and its media type told."""
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = F.transform_keys("headers", lambda k, v: F.lower(k))
    judged = raw.withColumn("c", urls.canonical(F.col("url"))).withColumn("m", identity.media_type(F.try_element_at(named, F.lit("content-type"))))
    return judged.select(F.coalesce("c.url", "url").alias("url"), F.coalesce("c.code", "m.code").alias("code"), "hop", "status", "m.mime", "body", F.octet_length("body").alias("n_bytes"), F.col("_corrupt").isNotNull().alias("corrupt"))


def write(log: DataFrame, path: str) -> None:
    """Writes log(url, hop, status, headers, body) as JSON lines."""
    log.select("url", "hop", "status", "headers", "body").write.json(path)


def write_sample(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages as a fetch log, every fourth a redirect, written and read back."""
    path = shared_folder(spark, "fetch-log")
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"))
    write(pages.select("url", F.lit(0).alias("hop"), F.when(F.col("page_id") % 4 == 0, 301).otherwise(200).alias("status"), headers.alias("headers"), F.col("html").alias("body")), path)
    return read(spark, path)
