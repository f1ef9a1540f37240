"""Content-addressed blobs, artifacts, observations and lineage as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import identity


def observe(bodies: DataFrame) -> DataFrame:
    """bodies(run_id, source_url, observed_at, mime, role, body) with sha256, size_bytes, artifact_id and observation_id added.

    Equal bytes give one blob and one artifact, but every row is an observation of its own.
    """
    sha = F.sha2(F.col("body").cast("binary"), 256)
    return bodies.withColumns({
        "sha256": sha,
        "size_bytes": F.octet_length("body").cast("bigint"),
        "artifact_id": identity.artifact_id(sha, F.col("mime"), F.col("role")),
        "observation_id": identity.observation_id(F.col("run_id"), F.col("source_url"), F.col("observed_at")),
    })


def blobs(observed: DataFrame) -> DataFrame:
    """(sha256, size_bytes, relative_path), one row a blob; a map-side aggregate, so copies never meet in one task."""
    return observed.groupBy("sha256").agg(F.min("size_bytes").alias("size_bytes")).withColumn("relative_path", identity.blob_path(F.col("sha256")))


def artifacts(observed: DataFrame) -> DataFrame:
    """(artifact_id, blob_sha256, mime_type, role), one row an artifact."""
    return observed.groupBy("artifact_id").agg(F.min("sha256").alias("blob_sha256"), F.min("mime").alias("mime_type"), F.min("role").alias("role"))


def observations(observed: DataFrame) -> DataFrame:
    return observed.select("observation_id", "artifact_id", "source_url", "observed_at")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows to append: one a key, keys that exist left out (the sink may be retried)."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def conflicts(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys held with other facts than the incoming ones, with the code 'blob.conflict'."""
    facts = [c for c in incoming.columns if c != key]
    other = existing.select(key, F.struct(*facts).alias("_held"))
    return incoming.join(other, key).where(~F.struct(*facts).eqNullSafe(F.col("_held"))).select(key, F.lit("blob.conflict").alias("code"))


def full_observations(obs: DataFrame, arts: DataFrame, blob: DataFrame) -> DataFrame:
    """Observations with their artifact and blob; what does not join is not readable and left out."""
    return obs.join(arts, "artifact_id").join(blob.withColumnRenamed("sha256", "blob_sha256"), "blob_sha256")


def verified(content: DataFrame) -> DataFrame:
    """Adds ``code`` to content(sha256, size_bytes, body): 'blob.missing', 'blob.corrupt', or null if bytes and size agree."""
    ok = (F.sha2(F.col("body").cast("binary"), 256) == F.col("sha256")) & (F.octet_length("body") == F.col("size_bytes"))
    return content.withColumn("code", F.when(F.col("body").isNull(), "blob.missing").when(~ok, "blob.corrupt"))


def derive(source: DataFrame, derived_mime: str, tool: str, version: str) -> DataFrame:
    """Derived observations of source(run_id, observation_id, artifact_id, observed_at, derived): with their lineage edge."""
    made = source.where(F.col("derived").isNotNull())
    url = F.concat(F.lit("urn:spindrift:transform:"), F.lit(tool), F.lit(":"), F.lit(version))
    sha = F.sha2(F.col("derived"), 256)
    art = identity.artifact_id(sha, F.lit(derived_mime), F.lit("derived"))
    obs = identity.observation_id(F.col("run_id"), url, F.col("observation_id"))
    return made.select(
        obs.alias("observation_id"), art.alias("artifact_id"), url.alias("source_url"), "observed_at", sha.alias("blob_sha256"),
        F.col("observation_id").alias("source_observation_id"), F.col("artifact_id").alias("source_artifact_id"),
        identity.lineage_id(art, obs, F.col("artifact_id"), F.col("observation_id")).alias("lineage_id"),
    )


def dangling(lineage: DataFrame, obs: DataFrame) -> DataFrame:
    """Lineage rows whose source observation does not exist with that artifact."""
    held = obs.select(F.col("observation_id").alias("source_observation_id"), F.col("artifact_id").alias("source_artifact_id"))
    return lineage.join(held, ["source_observation_id", "source_artifact_id"], "left_anti")


def latest(obs: DataFrame) -> DataFrame:
    """The latest observation of each URL, ties to the greatest id."""
    best = F.max(F.struct("observed_at", "observation_id", "artifact_id")).alias("b")
    return obs.groupBy("source_url").agg(best, F.count("*").alias("n_observations")).select("source_url", "b.*", "n_observations")


def visible(rows: DataFrame, grants: DataFrame, caller: str, key: str = "artifact_id") -> DataFrame:
    """Rows the caller has a grant for."""
    return rows.join(grants.where(F.col("caller_id") == caller).select(key).distinct(), key, "left_semi")
