"""Observation, job and change feeds as structured streams that drain what is there and stop.

Job feeds keep a few values a job as state, not its events: a row for each job that a batch touched.  Sinks are parquet folders, one a batch, which
is replaced when a batch is run again after a failure, so reruns leave the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import identity
from spindrift.functions.shared import cut, shared_folder
from spindrift.operators.jobs import claims, machine
from spindrift.operators.store import artifacts, blobs, new_rows, observations, observe


def _drain(stream: DataFrame, name: str, mode: str, each: Callable[[DataFrame, str, int], DataFrame] = lambda rows, out, batch: rows) -> DataFrame:
    """Runs a stream over all that is available; the rows of all its batches, with the number of each as ``batch``, after ``each`` was applied to them."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    kinds = {}

    def write(rows: DataFrame, batch: int) -> None:
        kept = each(rows, out, batch)
        kinds["schema"] = kept.schema
        kept.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state").outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    if not kinds:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("bigint"))
    return spark.read.schema(kinds["schema"].add("batch", "long")).parquet(f"{out}/rows")


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that its last batch wrote."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a table that is one parquet file or a folder of them."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    folder, _, name = path.rpartition("/")
    if any(f.rpartition("/")[2] == name for f in table.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def dedup_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (artifact_id, source_url) of a stream of documents."""
    d = _read(spark, path)
    mime = F.when(F.col("doc_id") % 5 < 4, "text/html").otherwise("application/pdf")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.test/p/"), (F.col("doc_id") % 500).cast("string"))
    rows = d.select(identity.artifact_id(F.sha2("text", 256), mime, F.lit("source")).alias("artifact_id"), url.alias("source_url"))

    def unseen(batch_rows: DataFrame, out: str, batch: int) -> DataFrame:
        # what earlier batches wrote is the store of keys, so nothing is held in memory
        spark_ = batch_rows.sparkSession
        held = spark_.createDataFrame([], batch_rows.schema) if not batch else spark_.read.schema(batch_rows.schema.add("batch", "long")).parquet(f"{out}/rows").where(F.col("batch") < batch)
        pair = F.struct("artifact_id", "source_url")
        return new_rows(batch_rows.withColumn("_k", pair), held.withColumn("_k", pair), "_k").drop("_k")

    return _drain(rows, "artifacts", "append", unseen).drop("batch")


def commit_observations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables blobs, artifacts and observations of a stream of documents, each batch committed to all three.

    A batch writes one folder a table, under its number, with the keys that earlier batches do not hold; blobs
    first and observations last, so what an observation names is there.  A batch that is run again after a
    failure replaces its own folders and no others.
    """
    out = shared_folder(spark, "store")
    parts = {"blobs": (blobs, "sha256"), "artifacts": (artifacts, "artifact_id"), "observations": (observations, "observation_id")}
    kinds: dict = {}

    def commit(rows: DataFrame, batch: int) -> None:
        seen = cut(rows)
        for name, (make, key) in parts.items():
            made = make(seen)
            kinds[name] = made.schema
            held = seen.sparkSession.createDataFrame([], made.schema) if not batch else seen.sparkSession.read.schema(made.schema.add("batch", "long")).parquet(f"{out}/{name}").where(F.col("batch") < batch)
            new_rows(made, held, key).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")

    d = _read(spark, path)
    mime = F.when(F.col("doc_id") % 5 < 4, "text/html").otherwise("application/pdf")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.test/p/"), (F.col("doc_id") % 500).cast("string"))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bodies = d.select(F.concat(F.lit("run-"), (F.col("doc_id") % 3).cast("string")).alias("run_id"), url.alias("source_url"), at.alias("observed_at"), mime.alias("mime"), F.lit("source").alias("role"), F.col("text").alias("body"))
    query = observe(bodies).drop("body").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(commit).start()
    query.awaitTermination()
    return {name: spark.read.schema(kinds[name]).parquet(f"{out}/{name}") for name in parts if name in kinds}


def _folded(spark: SparkSession, log: str, name: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """The last state of each job of a stream: ``fold`` gives, from a batch's rows and the states before it, the states of the jobs in it."""
    def each(rows: DataFrame, out: str, batch: int) -> DataFrame:
        held = None
        if batch:
            before = rows.sparkSession.read.parquet(f"{out}/rows").where(F.col("batch") < batch)
            held = _last(before, "job_id").join(rows.select("job_id").distinct(), "job_id", "left_semi")
        return fold(rows, held)

    return _last(_drain(_read(spark, log), name, "append", each), "job_id")


def run_jobs(spark: SparkSession, events: DataFrame) -> DataFrame:
    """(job_id, status, n_events) after folding each job's events, in order, through the state machine; illegal events are passed over."""
    log = shared_folder(spark, "job-events")
    events.select("job_id", F.col("sequence").alias("ord"), "status").write.parquet(log)
    return _folded(spark, log, "job-states", machine)


def run_claims(spark: SparkSession, commands: DataFrame) -> DataFrame:
    """``jobs.claims`` over a stream of commands: a job's status, fencing token, lease and counts are its state."""
    log = shared_folder(spark, "commands")
    commands.select("job_id", "ord", "op", "at", "token").write.parquet(log)
    return _folded(spark, log, "claims", lambda rows, held: claims(rows, held=held)).drop("lease")


def daily(spark: SparkSession, path: str) -> DataFrame:
    """(day, event_type, n): events a day and type, late ones taken in for a day."""
    days = _read(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    rows = _drain(days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "daily", "update")
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
