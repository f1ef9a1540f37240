"""Usage rollups, budget ledgers, attempt caps and retry by switching, over attempt tables.

attempts(run_id, ord, attempt_id, url, tool_id, outcome, code, requests, bytes_received, runtime_ms);
outcome is succeeded, failed or skipped.  Skipped attempts never count as tool attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.quality import allows_switch

MEASURES = ("requests", "bytes_received", "runtime_ms")


def called() -> Column:
    return F.col("outcome") != "skipped"


def usage(attempts: DataFrame, *keys: str) -> DataFrame:
    """Sums of requests, bytes and runtime, and the count of attempts that were not skipped."""
    return attempts.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES], F.count_if(called()).alias("tool_attempts"))


def usage_rollup(attempts: DataFrame, outer: str, inner: str) -> DataFrame:
    """Usage of each (outer, inner), each outer and all, in one rollup."""
    return attempts.rollup(outer, inner).agg(*[F.sum(m).alias(m) for m in MEASURES], F.count_if(called()).alias("tool_attempts"), F.grouping_id().alias("level"))


def usage_mismatch(attempts: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Runs whose declared usage is not that of their attempts; the declared runtime may be longer, not shorter."""
    real = usage(attempts, key).select(key, *[F.col(m).alias(f"real_{m}") for m in (*MEASURES, "tool_attempts")])
    bad = (F.col("requests") != F.col("real_requests")) | (F.col("bytes_received") != F.col("real_bytes_received")) | (F.col("tool_attempts") != F.col("real_tool_attempts")) | (F.col("runtime_ms") < F.col("real_runtime_ms"))
    return declared.join(real, key).where(bad)


def ledger(attempts: DataFrame, max_requests: int, max_bytes: int, max_runtime_seconds: int) -> DataFrame:
    """Adds what was left before each attempt and whether it may be dispatched: nothing left of any budget refuses; runtime counts whole seconds."""
    before = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda m: F.coalesce(F.sum(m).over(before), F.lit(0))
    return attempts.withColumns({
        "left_requests": max_requests - spent("requests"),
        "left_bytes": max_bytes - spent("bytes_received"),
        "left_seconds": F.floor((max_runtime_seconds * 1000 - spent("runtime_ms")) / 1000),
    }).withColumn("dispatch", (F.col("left_requests") > 0) & (F.col("left_bytes") > 0) & (F.col("left_seconds") > 0))


def dispatched(ledgered: DataFrame) -> DataFrame:
    """Attempts before the first refusal of their run."""
    w = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ledgered.withColumn("_ok", F.min("dispatch").over(w)).where("_ok").drop("_ok")


def alternates(attempts: DataFrame, max_requests: int, max_bytes: int, max_runtime_seconds: int) -> DataFrame:
    """(retrieval_id, job, left_requests, left_bytes, left_seconds, runs) of the jobs of attempts(retrieval_id, job, outcome, ...): the first source and its alternates share one budget.

    A job runs if something is left of each budget and no job before it was refused or has fetched anything.
    """
    jobs = attempts.groupBy("retrieval_id", "job").agg(*[F.sum(m).alias(m) for m in MEASURES], F.bool_or(F.col("outcome") == "succeeded").alias("_got"))
    left = ledger(jobs.withColumnsRenamed({"retrieval_id": "run_id", "job": "ord"}), max_requests, max_bytes, max_runtime_seconds)
    w = Window.partitionBy("run_id").orderBy("ord")
    done = F.coalesce(F.max("_got").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    refused = ~F.min("dispatch").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = lambda x: F.col(x).cast("bigint").alias(x)
    return left.select(F.col("run_id").alias("retrieval_id"), F.col("ord").alias("job"), number("left_requests"), number("left_bytes"), number("left_seconds"), (~done & ~refused).alias("runs"))


def exhausted(attempts: DataFrame, max_requests: int, max_bytes: int, max_runtime_seconds: int) -> DataFrame:
    """(run_id, explore_exhausted, refresh_exhausted): reaching a limit exhausts an exploration, only going beyond it a refresh."""
    u = usage(attempts, "run_id")
    pairs = ((F.col("requests"), max_requests), (F.col("bytes_received"), max_bytes), (F.col("runtime_ms"), max_runtime_seconds * 1000))
    reach, beyond = F.lit(False), F.lit(False)
    for got, limit in pairs:
        reach, beyond = reach | (got >= limit), beyond | (got > limit)
    return u.select("run_id", reach.alias("explore_exhausted"), beyond.alias("refresh_exhausted"))


def capped(attempts: DataFrame, cap: int, *keys: str) -> DataFrame:
    """Adds ``within``: whether a called attempt is among the first ``cap`` of its target; skipped ones always are."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(called(), 1).otherwise(0)).over(w), F.lit(0))
    return attempts.withColumn("within", ~called() | (earlier < cap))


def renumbered(attempts: DataFrame, *order: str) -> DataFrame:
    """Attempts of a run numbered 0.. in order, as ``position``."""
    return attempts.withColumn("position", (F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1).cast("bigint"))


def not_contiguous(attempts: DataFrame) -> DataFrame:
    """Runs whose ``ord`` is not 0..n-1 without gap or repeat."""
    return attempts.groupBy("run_id").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n"), F.countDistinct("ord").alias("d")).where("lo <> 0 or hi <> n - 1 or d <> n").select("run_id")


def switching(attempts: DataFrame) -> DataFrame:
    """Attempts that a run makes of a target when it stops at the first success and at a failure that allows no other tool."""
    stop = (F.col("outcome") == "succeeded") | ((F.col("outcome") == "failed") & ~allows_switch(F.col("code"), F.col("tool_id")))
    w = Window.partitionBy("run_id", "url").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("_stopped", F.coalesce(F.max(stop).over(w), F.lit(False))).where("not _stopped").drop("_stopped")


def last_called(attempts: DataFrame) -> DataFrame:
    """(run_id, n_called, tool_id, outcome, code) of each run's last attempt that was not skipped."""
    best = F.max_by(F.struct("tool_id", "outcome", "code"), "ord").alias("b")
    return attempts.where(called()).groupBy("run_id").agg(F.count("*").alias("n_called"), best).select("run_id", "n_called", "b.*")


def first_rejection(attempts: DataFrame) -> DataFrame:
    """(run_id, code) of each run's first rejection."""
    return attempts.where(rejection(F.col("code"))).groupBy("run_id").agg(F.min_by("code", "ord").alias("code"))


# Codes that reject whatever their prefix, codes of spent budgets.
REJECTIONS = ("gateway.dns_not_public", "gateway.peer_not_public", "gateway.https_downgrade")
BUDGET_CODES = ("budget.exhausted", "budget.requests", "budget.bytes", "budget.runtime")


def rejection(code: Column) -> Column:
    out = code.isin(*REJECTIONS)
    for p in ("scope.", "robots.", "security.", "policy."):
        out = out | code.startswith(p)
    return F.coalesce(out, F.lit(False))


def stop_reason(codes: Column, rejected: Column) -> Column:
    """cancelled before budget_exhausted before rejected before acquisition_failed, over an array of codes."""
    return (
        F.when(F.array_contains(codes, "runtime.cancelled"), "cancelled")
        .when(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in BUDGET_CODES])), "budget_exhausted")
        .when(rejected | F.exists(codes, rejection), "rejected")
        .otherwise("acquisition_failed")
    )


def result_status(n_artifacts: Column, n_succeeded: Column, n_other: Column, n_errors: Column, rejected: Column) -> Column:
    """completed, partial, rejected or failed."""
    kept = (n_artifacts > 0) & (n_succeeded > 0)
    return F.when(kept & (n_other + n_errors == 0), "completed").when(kept, "partial").when(rejected, "rejected").otherwise("failed")
