"""Durable jobs as event tables: final states, illegal transitions, idempotency, queue order, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# States that end a job.
TERMINAL = ("completed", "partial", "rejected", "failed")


def final_states(events: DataFrame) -> DataFrame:
    """(job_id, status, at, n_events, terminal) of events(job_id, sequence, status, at)."""
    last = F.max_by(F.struct("status", "at"), "sequence").alias("s")
    return events.groupBy("job_id").agg(last, F.count("*").alias("n_events")).select("job_id", "s.*", "n_events", F.col("s.status").isin(*TERMINAL).alias("terminal"))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events that do not follow their predecessor: nothing to submitted, submitted to running, running to an end; numbers from 1 without gap; time never back."""
    w = Window.partitionBy("job_id").orderBy("sequence")
    got = events.withColumns({"_n": F.row_number().over(w), "_status": F.lag("status").over(w), "_at": F.lag("at").over(w)})
    legal = (
        (F.col("_status").isNull() & (F.col("status") == "submitted"))
        | ((F.col("_status") == "submitted") & (F.col("status") == "running"))
        | ((F.col("_status") == "running") & F.col("status").isin(*TERMINAL))
    )
    ok = F.coalesce(legal, F.lit(False)) & (F.col("sequence") == F.col("_n")) & F.coalesce(F.col("at") >= F.col("_at"), F.lit(True))
    return got.where(~ok).select("job_id", "sequence", F.col("_status").alias("previous_status"), "status")


def idempotency(submissions: DataFrame) -> DataFrame:
    """(caller_id, key, job_id, n, code): a key's first job answers all its submissions; different requests under one key conflict."""
    got = submissions.groupBy("caller_id", "idempotency_key").agg(F.min_by("job_id", F.struct("at", "job_id")).alias("job_id"), F.count("*").alias("n"), F.min("fingerprint").alias("_a"), F.max("fingerprint").alias("_b"))
    return got.select("caller_id", "idempotency_key", "job_id", "n", F.when(F.col("_a") != F.col("_b"), "idempotency.conflict").alias("code"))


def submit(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """(submission_id, job_id, created, code) of incoming(submission_id, caller_id, idempotency_key, fingerprint, job_id, at) beside held(caller_id, idempotency_key, fingerprint, job_id).

    A key that is held answers with its job, of new submissions under one key the first makes it; one that
    asks for something else under a key is a conflict and gets no job.  The rows to append are those created.
    """
    key = ["caller_id", "idempotency_key"]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct("job_id", "fingerprint", "submission_id"), F.struct("at", "submission_id")).alias("f"))
    own = first.join(held.select(*key, F.struct(F.col("job_id").alias("job_id"), F.col("fingerprint").alias("fingerprint")).alias("h")), key, "left")
    j = incoming.select(*key, "submission_id", "fingerprint").join(own, key)
    answer = F.coalesce(F.col("h.fingerprint"), F.col("f.fingerprint"))
    code = F.when(~F.col("fingerprint").eqNullSafe(answer), "idempotency.conflict")
    created = F.col("h").isNull() & (F.col("submission_id") == F.col("f.submission_id"))
    return j.select("submission_id", F.when(code.isNull(), F.coalesce("h.job_id", "f.job_id")).alias("job_id"), (created & code.isNull()).alias("created"), code.alias("code"))


def resume(slots: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(batch_id, pos, site_key) of slots(batch_id, pos, site_key) that are still to run: those behind the unbroken beginning of checkpoints(batch_id, ordinal).

    A checkpoint behind a gap counts for nothing.
    """
    w = Window.partitionBy("batch_id").orderBy("ordinal")
    done = checkpoints.select("batch_id", "ordinal").distinct().withColumn("_n", F.row_number().over(w) - 1).where("ordinal = _n").groupBy("batch_id").agg(F.max("ordinal").alias("_last"))
    return slots.join(done, "batch_id", "left").where(F.col("pos") > F.coalesce("_last", F.lit(-1))).select("batch_id", "pos", "site_key")


def next_job(jobs: DataFrame) -> DataFrame:
    """The submitted job that is next: oldest first, ties by id."""
    return jobs.where("status = 'submitted'").orderBy("at", "job_id").limit(1)


def reconcile(jobs: DataFrame, now: str) -> DataFrame:
    """jobs(job_id, kind, status, lease_deadline): abandoned single jobs fail, batches and url fetches go back to the queue."""
    lost = (F.col("status") == "running") & (F.coalesce(F.col("lease_deadline"), F.lit("")) < now)
    again = F.col("kind").isin("batch", "url_fetch")
    return jobs.select(
        "job_id", "kind",
        F.when(lost & again, "submitted").when(lost, "failed").otherwise(F.col("status")).alias("status"),
        F.when(lost & ~again, "service.restart_interrupted").alias("failure_code"),
    )


def checkpoint_gaps(checkpoints: DataFrame) -> DataFrame:
    """Batches of checkpoints(batch_id, ordinal) whose ordinals are not a prefix 0..n-1."""
    return checkpoints.groupBy("batch_id").agg(F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d")).where("hi <> d - 1").select("batch_id")


def batch_completion(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(batch_id, status, stop_reason) of results(batch_id, pos, status, cancelled, file_found) and expected(batch_id, n_sites)."""
    g = results.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("status") == "completed").alias("all_ok"), F.bool_and(F.col("status") == "rejected").alias("all_no"), F.bool_and(F.col("status") == "failed").alias("all_bad"),
        F.bool_or("cancelled").alias("any_cancelled"), F.max_by("cancelled", "pos").alias("last_cancelled"), F.count_if("cancelled").alias("n_cancelled"), F.bool_or(~F.col("file_found")).alias("not_found"),
    )
    j = g.join(expected, "batch_id")
    said = lambda status, reason: F.struct(F.lit(status).alias("s"), F.lit(reason).alias("r"))
    kind = (
        F.when(F.col("any_cancelled") & ~(F.col("last_cancelled") & (F.col("n_cancelled") == 1)), said("invalid", "site_batch.cancellation_order_invalid"))
        .when(F.col("any_cancelled"), said("partial", "cancelled"))
        .when(F.col("n") != F.col("n_sites"), said("invalid", "site_batch.site_results_missing"))
        .when(F.col("all_ok") & ~F.col("not_found"), said("completed", "source_exhausted"))
        .when(F.col("all_no"), said("rejected", "rejected"))
        .when(F.col("all_bad"), said("failed", "failed"))
        .otherwise(said("partial", "partial"))
    )
    return j.withColumn("k", kind).select("batch_id", F.col("k.s").alias("status"), F.col("k.r").alias("stop_reason"))


def _folded(rows: DataFrame, held: DataFrame | None, values: list[str], empty: list, step) -> DataFrame:
    """(job_id, the named values) after folding each job's rows(job_id, ord, ...), in order, from the values that ``held`` has of it, else from ``empty``."""
    log = F.array_sort(F.collect_list(F.struct("ord", *[c for c in rows.columns if c not in ("job_id", "ord")]))).alias("log")
    got = rows.groupBy("job_id").agg(log)
    start = F.struct(*[x.alias(v) for v, x in zip(values, empty, strict=True)])
    if held is not None:
        got = got.join(held.select("job_id", F.struct(*values).alias("_held")), "job_id", "left")
        start = F.coalesce("_held", start)
    return got.withColumn("s", F.aggregate("log", start, step)).select("job_id", "s.*")


def machine(events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(job_id, status, n_events) after folding events(job_id, ord, status) through the states of a job; illegal events are passed over.

    ``held`` are the states so far, of which those of jobs without an event are not returned.
    """
    def step(s, x):
        legal = (s["status"].isNull() & (x["status"] == "submitted")) | ((s["status"] == "submitted") & (x["status"] == "running")) | ((s["status"] == "running") & x["status"].isin(*TERMINAL))
        ok = F.coalesce(legal, F.lit(False))
        return F.struct(F.when(ok, x["status"]).otherwise(s["status"]).alias("status"), (s["n_events"] + ok.cast("bigint")).alias("n_events"))

    return _folded(events, held, ["status", "n_events"], [F.lit(None).cast("string"), F.lit(0).cast("bigint")], step)


def claims(commands: DataFrame, lease_seconds: int = 3600, held: DataFrame | None = None) -> DataFrame:
    """(job_id, status, token, lease, cancelled, n_applied, n_stale) of commands(job_id, ord, op, at, token), folded in order, from ``held`` states on.

    submit opens a job once; claim takes a submitted one, or a running one whose lease is over, under a new
    fencing token; finish ends it if its token is the last one handed out, as failed if a cancel came
    before, and is stale otherwise; the first cancel of an open job counts, ends win over later commands.
    A job's commands, in a stream those of a batch, are one array, so the fold is a built-in expression.
    """
    def step(s, x):
        is_open, running = s["status"].isin("submitted", "running"), s["status"] == "running"
        free = (s["status"] == "submitted") | (running & (s["lease"] < x["at"]))
        submit = (x["op"] == "submit") & s["status"].isNull()
        claim = F.coalesce((x["op"] == "claim") & free, F.lit(False))
        mine = F.coalesce((x["op"] == "finish") & running & (x["token"] == s["token"]), F.lit(False))
        stale = F.coalesce((x["op"] == "finish") & running & (x["token"] != s["token"]), F.lit(False))
        cancel = F.coalesce((x["op"] == "cancel") & is_open & ~s["cancelled"], F.lit(False))
        return F.struct(
            F.when(submit, "submitted").when(claim, "running").when(mine & s["cancelled"], "failed").when(mine, "completed").otherwise(s["status"]).alias("status"),
            F.when(claim, s["token"] + 1).otherwise(s["token"]).alias("token"),
            F.when(claim, x["at"] + lease_seconds).otherwise(s["lease"]).alias("lease"),
            (s["cancelled"] | cancel).alias("cancelled"),
            (s["n_applied"] + (submit | claim | mine | cancel).cast("bigint")).alias("n_applied"),
            (s["n_stale"] + stale.cast("bigint")).alias("n_stale"),
        )

    zero = F.lit(0).cast("bigint")
    return _folded(commands, held, ["status", "token", "lease", "cancelled", "n_applied", "n_stale"], [F.lit(None).cast("string"), zero, zero, F.lit(False), zero, zero], step)
