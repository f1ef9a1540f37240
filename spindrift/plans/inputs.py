"""Inputs of the registered queries, in Spark and as the same relations in SQL.

The given tables hold no fetch logs, robots files or jobs; where a query needs some, it derives them from
whole tables by plain formulas that both engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sql: str) -> DataFrame:
    """A small literal relation ``VALUES ... AS t(...)``, the same text that the oracle uses."""
    return spark.sql(f"SELECT * FROM {sql}")


def choose(n: Column, *items: str | None) -> Column:
    out = F.lit(None).cast("string")
    for i, item in enumerate(items):
        out = F.when(n % len(items) == i, F.lit(item)).otherwise(out)
    return out


def choose_sql(n: str, *items: str | None) -> str:
    return "CASE " + " ".join(f"WHEN ({n}) % {len(items)} = {i} THEN " + ("CAST(NULL AS VARCHAR)" if x is None else f"'{x}'") for i, x in enumerate(items)) + " END"


# attempts from events
CODES = ("gateway.timeout", "acquisition.cloudflare_blocked", "scope.origin_not_allowed", "runner.crash", "acquisition.auth_required")
TOOLS = ("acquisition.web_http", "acquisition.playwright", "acquisition.cloakbrowser")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt log out of events: users are runs, in time order; views are skipped attempts, errors failed ones."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    called = F.col("event_type") != "view"
    return e.select(
        F.col("user_id").alias("run_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("ord"),
        F.concat(F.lit("attempt-"), F.col("event_id").cast("string")).alias("attempt_id"),
        F.concat(F.lit("https://h"), (F.col("event_id") % 7).cast("string"), F.lit(".example.test/")).alias("url"),
        choose(F.col("event_id"), *TOOLS).alias("tool_id"),
        F.when(F.col("event_type") == "error", "failed").when(~called, "skipped").otherwise("succeeded").alias("outcome"),
        F.when(F.col("event_type") == "error", choose(F.col("event_id"), *CODES)).alias("code"),
        F.when(called, F.lit(1)).otherwise(0).cast("bigint").alias("requests"),
        F.when(called, F.floor(F.abs("value") * 100)).otherwise(0).cast("bigint").alias("bytes_received"),
        F.when(called, F.get_json_object("props", "$.k").cast("bigint") * 10).otherwise(0).cast("bigint").alias("runtime_ms"),
    )


ATTEMPTS = f"""attempts AS (
  SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord,
    'attempt-' || event_id AS attempt_id, 'https://h' || (event_id % 7) || '.example.test/' AS url, {choose_sql('event_id', *TOOLS)} AS tool_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'succeeded' END AS outcome,
    CASE WHEN event_type = 'error' THEN {choose_sql('event_id', *CODES)} END AS code,
    CAST(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS BIGINT) AS requests,
    CAST(CASE WHEN event_type = 'view' THEN 0 ELSE floor(abs(value) * 100) END AS BIGINT) AS bytes_received,
    CAST(CASE WHEN event_type = 'view' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 END AS BIGINT) AS runtime_ms
  FROM events)"""


# observed bodies from documents
def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as one fetched body."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("run-"), (F.col("doc_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.test/p/"), (F.col("doc_id") % 500).cast("string")).alias("source_url"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"),
        F.when(F.col("doc_id") % 5 < 4, "text/html").otherwise("application/pdf").alias("mime"),
        F.lit("source").alias("role"),
        F.col("text").alias("body"),
        "doc_id",
    )


BODIES = """bodies AS (
  SELECT 'run-' || (doc_id % 3) AS run_id, 'https://' || source || '.example.test/p/' || (doc_id % 500) AS source_url,
    strftime(to_timestamp(1704067200 + doc_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS observed_at,
    CASE WHEN doc_id % 5 < 4 THEN 'text/html' ELSE 'application/pdf' END AS mime, 'source' AS role, text AS body, doc_id FROM documents)"""
OBSERVED = BODIES + """, observed AS (
  SELECT *, sha256(body) AS sha256, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes,
    'artifact-' || sha256('{"blob_sha256":"' || sha256(body) || '","mime_type":"' || mime || '","role":"source"}') AS artifact_id,
    'observation-' || substr(sha256(run_id || chr(10) || source_url || chr(10) || observed_at), 1, 32) AS observation_id FROM bodies)"""
