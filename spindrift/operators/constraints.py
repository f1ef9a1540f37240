"""Integrity constraints over evidence tables, as codes of rows or as the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import identity, safety
from spindrift.operators.ledger import BUDGET_CODES


def attempt_code() -> Column:
    """Code of an attempt(outcome, code, final_url, http_status, requests, bytes_received, runtime_ms, started_at, finished_at) whose facts do not fit.

    A success is a whole network success or none of its facts; anything else needs an error; a skipped one has no effects.
    """
    c = F.col
    any_effect = c("final_url").isNotNull() | c("http_status").isNotNull() | (c("requests") != 0) | (c("bytes_received") != 0)
    network = c("final_url").isNotNull() & c("http_status").isNotNull() & (c("requests") > 0)
    ok = c("outcome") == "succeeded"
    return (
        F.when(~c("outcome").isin("succeeded", "failed", "skipped"), "attempt.outcome_invalid")
        .when(~identity.utc_valid(c("started_at")) | ~identity.utc_valid(c("finished_at")) | (c("finished_at") < c("started_at")), "attempt.time_invalid")
        .when(~F.coalesce(c("http_status").between(100, 599), F.lit(True)), "attempt.http_status_invalid")
        .when(F.least("requests", "bytes_received", "runtime_ms") < 0, "attempt.usage_invalid")
        .when(ok & (c("code").isNotNull() | (any_effect & ~network)), "attempt.success_invalid")
        .when(~ok & c("code").isNull(), "attempt.error_required")
        .when((c("outcome") == "skipped") & (any_effect | (c("runtime_ms") != 0)), "attempt.skipped_invalid")
    )


def artifact_code() -> Column:
    """Code of an artifact(artifact_id, sha256, mime_type, role, observation_id, lineage array<struct<observation_id, artifact_id>>) that does not hold together."""
    c = F.col
    n = F.coalesce(F.size("lineage"), F.lit(0))
    return (
        F.when(c("artifact_id") != identity.artifact_id(c("sha256"), c("mime_type"), c("role")), "artifact.identity_mismatch")
        .when((c("role") == "source") & (n > 0), "lineage.forbidden").when((c("role") == "derived") & (n != 1), "lineage.required")
        .when(F.exists("lineage", lambda e: (e["observation_id"] != c("observation_id")) | (e["artifact_id"] != c("artifact_id"))), "lineage.invalid")
    )


def manifest_code(attempts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, code) of runs by attempts(run_id, outcome, final_url) and artifacts(run_id, artifact_id, role, source_url): one source and one acquisition, or nothing."""
    a = attempts.where("outcome = 'succeeded'").groupBy("run_id").agg(F.count_if(F.col("final_url").isNotNull()).alias("got"), F.count_if(F.col("final_url").isNull()).alias("made"), F.max("final_url").alias("final"))
    b = artifacts.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "source").alias("sources"), F.countDistinct("artifact_id").alias("ids"), F.max(F.when(F.col("role") == "source", F.col("source_url"))).alias("source"))
    j = a.join(b, "run_id", "full_outer").fillna(0, ["got", "made", "n", "sources", "ids"])
    code = (
        F.when(F.col("ids") != F.col("n"), "artifact.duplicate").when(F.col("made") > 1, "manifest.success_cardinality_invalid")
        .when((F.col("n") > 0) & (F.col("sources") != 1), "manifest.source_cardinality_invalid").when((F.col("n") > 0) & (F.col("got") != 1), "manifest.success_cardinality_invalid")
        .when((F.col("n") > 0) & (F.col("source") != F.col("final")), "manifest.success_facts_invalid").when((F.col("n") == 0) & (F.col("got") + F.col("made") > 0), "manifest.artifact_required")
    )
    return j.select("run_id", code.alias("code"))


def result_code() -> Column:
    """Code of a result(status, n_artifacts, n_succeeded, n_other, n_errors) whose status its parts do not allow."""
    c = F.col
    kept, failed = (c("n_artifacts") > 0) & (c("n_succeeded") > 0), (c("n_other") > 0) | (c("n_errors") > 0)
    s = c("status")
    return (
        F.when((s == "completed") & ~kept, "result.completed_requires_artifact").when((s == "completed") & failed, "result.completed_has_failure")
        .when((s == "partial") & ~kept, "result.partial_requires_artifact").when((s == "partial") & ~failed, "result.partial_requires_failure")
        .when(s.isin("rejected", "failed") & ((c("n_artifacts") > 0) | (c("n_succeeded") > 0)), F.concat(F.lit("result."), s, F.lit("_has_artifact")))
        .when(s.isin("rejected", "failed") & (c("n_errors") == 0), F.concat(F.lit("result."), s, F.lit("_requires_error")))
    )


def change_code() -> Column:
    """Code of a change(change_type, previous_digest, current_digest, n_attempts, n_codes) whose shape is not its type's."""
    c = F.col
    p, q, t = c("previous_digest").isNotNull(), c("current_digest").isNotNull(), c("change_type")
    plain = (c("n_attempts") == 0) & (c("n_codes") == 0)
    fits = (
        F.when(t == "added", ~p & q & plain).when(t == "changed", p & q & plain & F.coalesce(c("previous_digest") != c("current_digest"), F.lit(False)))
        .when(t == "unchanged", plain & F.coalesce(c("previous_digest") == c("current_digest"), F.lit(False))).when(t.isin("missing", "unresolved"), p & ~q & plain)
        .when(t == "failed", ~q & (c("n_attempts") > 0) & (c("n_codes") > 0))
    )
    return F.when(fits.isNull(), "site_refresh.change_type_invalid").when(~fits, "site_refresh.change_invalid")


def completion_code() -> Column:
    """Code of a refresh(complete, status, stop_reason, n_missing, n_unresolved) that claims too much or too little."""
    c = F.col
    done = c("complete")
    return (
        F.when(done != (c("status") == "completed"), "site_refresh.status_invalid").when(done != (c("stop_reason") == "source_exhausted"), "site_refresh.stop_reason_invalid")
        .when(done & (c("n_unresolved") > 0), "site_refresh.unresolved_forbidden").when(~done & (c("n_missing") > 0), "site_refresh.missing_forbidden")
    )


def explore_stop_code() -> Column:
    """Code of an exploration(stop_reason, status, complete, has_skill, codes, discovery_failed) whose stop reason its evidence does not bear out."""
    c = F.col
    has = lambda *codes: F.arrays_overlap("codes", F.array(*[F.lit(x) for x in codes]))
    stop, status = c("stop_reason"), c("status")
    evidence = (
        F.when(stop == "cancelled", has("runtime.cancelled")).when(stop == "budget_exhausted", has("budget.exhausted"))
        .when(stop == "discovery_failed", c("discovery_failed") | has("runtime.discovery_unavailable", "discovery.no_candidates"))
    )
    bad = (
        ((stop != "budget_exhausted") & has(*BUDGET_CODES)) | ((stop == "budget_exhausted") & (status != "partial"))
        | ((stop == "source_exhausted") & ~((status == "completed") & c("complete") & c("has_skill"))) | ((stop == "rejected") != (status == "rejected"))
        | F.coalesce((stop != "source_exhausted") & (stop != "rejected") & ((status == "completed") | c("complete") | ~evidence), F.lit(False))
    )
    return F.when(bad, "site_explore.stop_reason_inconsistent")


def target_order(targets: DataFrame) -> DataFrame:
    """Runs of targets(parent, pos, run_id) that are not the seed followed by candidates of ascending numbers."""
    w = Window.partitionBy("parent").orderBy("pos")
    number = F.when(F.col("pos") == 0, F.when(F.col("run_id") == F.concat("parent", F.lit("-seed")), 0)).otherwise(F.when(F.substring_index("run_id", "-candidate-", 1) == F.col("parent"), F.regexp_extract("run_id", "-candidate-([1-9][0-9]*)$", 1).try_cast("int")))
    got = targets.withColumn("_n", number).withColumn("_prev", F.lag("_n").over(w))
    return got.where(F.col("_n").isNull() | (F.col("_n") <= F.col("_prev"))).select("parent", "pos", "run_id")


def unattributed(parent_errors: DataFrame, child_errors: DataFrame, parent_only: tuple[str, ...]) -> DataFrame:
    """(run_id, code, side): errors of the parent that no child and no rule accounts for, and errors of children the parent lacks; both count repeats."""
    p, c = parent_errors.select("run_id", "code"), child_errors.select("run_id", "code")
    extra = p.exceptAll(c).where(~F.col("code").isin(*parent_only)).withColumn("side", F.lit("parent"))
    return extra.unionByName(c.exceptAll(p).withColumn("side", F.lit("child")))


def changed_children(parent: DataFrame, child: DataFrame) -> DataFrame:
    """attempt_ids whose row in the parent differs from the child's in anything but its order, or is missing on one side."""
    facts = [x for x in parent.columns if x not in ("attempt_id", "ord")]
    a = parent.select("attempt_id", F.struct(*facts).alias("p"))
    b = child.select("attempt_id", F.struct(*facts).alias("c"))
    return a.join(b, "attempt_id", "full_outer").where(~F.col("p").eqNullSafe(F.col("c"))).select("attempt_id")


def without_success(pages: DataFrame, attempts: DataFrame) -> DataFrame:
    """State pages(canonical_url) without a successful attempt(url, outcome)."""
    ok = attempts.where("outcome = 'succeeded'").select(F.col("url").alias("canonical_url")).distinct()
    return pages.join(ok, "canonical_url", "left_anti").select("canonical_url")


def reused(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Observations that two snapshots both claim as their own."""
    return current.join(previous.select("observation_id"), "observation_id", "left_semi").select("observation_id")


def unmatched_changes(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """Changes whose current digest is not their page's, and pages that no change mentions."""
    c = changes.where("current_digest is not null").select(F.col("url").alias("canonical_url"), "current_digest")
    return c.join(pages.select("canonical_url", "content_digest"), "canonical_url", "full_outer").where(~F.col("current_digest").eqNullSafe(F.col("content_digest"))).select("canonical_url")


def evidence_matches(evidence: DataFrame, attempts: DataFrame) -> DataFrame:
    """Evidence(evidence_id, tool_id, url, outcome, code) with the number of attempts that say exactly the same; one is right."""
    facts = ["tool_id", "url", "outcome", "code"]
    said = attempts.groupBy(*facts).agg(F.count("*").alias("n")).alias("a")
    e = evidence.alias("e")
    same = (F.col("e.tool_id") == F.col("a.tool_id")) & (F.col("e.url") == F.col("a.url")) & (F.col("e.outcome") == F.col("a.outcome")) & F.col("e.code").eqNullSafe(F.col("a.code"))
    return e.join(said, same, "left").select("e.evidence_id", F.coalesce("a.n", F.lit(0)).alias("n"))


def transform_pairs(successes: DataFrame, derived: DataFrame, prefix: str = "urn:spindrift:transform:") -> DataFrame:
    """(run_id, source_url) of transform successes(run_id, tool_id, tool_version) and derived(run_id, source_url) that do not pair one to one."""
    want = successes.select("run_id", F.concat(F.lit(prefix), "tool_id", F.lit(":"), "tool_version").alias("source_url")).groupBy("run_id", "source_url").agg(F.count("*").alias("a"))
    have = derived.where(F.col("source_url").startswith(prefix)).groupBy("run_id", "source_url").agg(F.count("*").alias("b"))
    return want.join(have, ["run_id", "source_url"], "full_outer").where(~(F.col("a").eqNullSafe(F.lit(1)) & F.col("b").eqNullSafe(F.lit(1)))).select("run_id", "source_url")


def retrieval_code() -> Column:
    """Code of a retrieval(outcome, reason, method, n_artifacts, n_jobs, actions) that contradicts itself."""
    c = F.col
    fetched = c("outcome") == "FETCHED"
    ok = (
        c("outcome").isin("FETCHED", "UNRESOLVED") & (fetched == (c("n_artifacts") > 0)) & (fetched == (c("reason") == "HTTP_OK")) & (~fetched | (c("method").isNotNull() & (F.size("actions") == 0)))
        & (c("n_jobs") > 0) & F.forall("actions", lambda a: a.isin("retrieve-browser", "retrieve-alternate", "discover_official_alternates")) & (F.size("actions") == F.size(F.array_distinct("actions")))
    )
    return F.when(~F.coalesce(ok, F.lit(False)), "retrieval.state_invalid")


def output_code() -> Column:
    """Code of an acquisition output(requested_url, final_url, hops array<struct<from_url, to_url>>, requests, bytes_received, size, measured) whose chain or counts do not fit."""
    c = F.col
    end = F.aggregate("hops", F.struct(c("requested_url").alias("at"), F.lit(True).alias("ok")), lambda s, h: F.struct(h["to_url"].alias("at"), (s["ok"] & (s["at"] == h["from_url"])).alias("ok")))
    return (
        F.when(~end["ok"] | (end["at"] != c("final_url")), "acquisition.redirect_invalid").when(c("requests") < F.size("hops") + 1, "acquisition.requests_invalid")
        .when(~c("measured") & (c("bytes_received") < c("size")), "acquisition.bytes_invalid")
    )


def discovery_code() -> Column:
    """Code of a discovery output(source, candidates, sources) whose lists do not fit: each candidate once, each with the source."""
    return F.when(F.size("candidates") != F.size("sources"), "discovery.provenance_length").when(~F.forall("sources", lambda s: s == F.col("source")), "discovery.provenance_source").when(F.size("candidates") != F.size(F.array_distinct("candidates")), "discovery.duplicate")


def limit_code() -> Column:
    """Code of a tool run(runtime_ms, input_bytes, output_bytes, max_*) beyond the tool's own limits."""
    c = F.col
    return F.when(F.ceil(c("runtime_ms") / 1000) > c("max_runtime_seconds"), "tool.runtime_limit").when(c("input_bytes") > c("max_input_bytes"), "tool.input_limit").when(c("output_bytes") > c("max_output_bytes"), "tool.output_limit")


def query_secrets(url: Column) -> Column:
    """Whether a URL's query has a key that names a secret; built-ins only."""
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda kv: F.coalesce(F.try_url_decode(F.substring_index(kv, "=", 1)), F.substring_index(kv, "=", 1)))
    return F.exists(keys, safety.secret_key)


def field_codes(keys: Column, known: tuple[str, ...]) -> Column:
    """Code of a record by its field names: secret ones first, then unknown ones, then missing ones."""
    return (
        F.when(F.exists(keys, safety.secret_key), "field.secret").when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0, "field.unknown")
        .when(F.size(F.array_except(F.array(*[F.lit(k) for k in known]), keys)) > 0, "field.missing")
    )


def snapshot_mismatch(jobs: DataFrame, final: DataFrame) -> DataFrame:
    """Jobs(job_id, status) whose stored status is not that of their events, or that have none."""
    return jobs.join(final.select("job_id", F.col("status").alias("_s")), "job_id", "left").where(~F.col("status").eqNullSafe(F.col("_s"))).select("job_id")
