"""Whole records held against what they are made of: results and manifests, batches, URL fetches, skills, JSON scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import identity, safety, urls
from spindrift.operators.evidence import _first
from spindrift.operators.policy import DIGEST, TOOL_ID, VERSION, child_run_id, matches, strict_json, validate_scopes

# The fields of a scope, and those of the usage of a run.
SCOPE_FIELDS = ("seeds", "allowed_origins", "include_paths", "content_types")
USAGE = ("requests", "bytes_received", "runtime_ms", "tool_attempts")
# Where a handed-off artifact's content is read.
CONTENT_REF = "/v1/artifacts/"


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def state_url_code(url: Column) -> Column:
    """Code of a page URL of a site's state: it must be canonical already and hold neither secrets nor local paths in any of its forms."""
    canonical = urls.canonical(url)
    unsafe = safety.unsafe(url)
    return _first(
        ("site_state.page_invalid", ~F.coalesce(canonical["url"] == url, F.lit(False)) | url.endswith("?")), ("site_state.sensitive_data", unsafe == "result.sensitive_data"), ("site_state.absolute_path", unsafe == "result.absolute_path"),
        ("site_state.page_invalid", unsafe.isNotNull()),
    )


def result_manifest_code() -> Column:
    """Code of a result(attempts, usage, skill) beside its manifest(manifest_attempts, manifest_usage, manifest_skill), or whose attempts are not numbered from 0."""
    return _first(
        ("attempt.order_invalid", F.transform("attempts", lambda a: a["ord"].cast("int")) != F.sequence(F.lit(0), F.size("attempts") - 1)),
        ("result.attempts_mismatch", _differs("attempts", "manifest_attempts")), ("result.usage_mismatch", _differs("usage", "manifest_usage")), ("result.site_skill_mismatch", _differs("skill", "manifest_skill")),
    )


def manifest_facts_code() -> Column:
    """Code of a manifest(facts, source, success): facts, a struct of requested_url, final_url, http_status, tool_id, tool_version, mime_type, size_bytes and sha256, are those of the stored source and of the one success, or all absent."""
    c = F.col
    pairs = [c(f"facts.{x}").eqNullSafe(c(f"success.{x}")) for x in ("requested_url", "final_url", "http_status", "tool_id", "tool_version")]
    pairs += [c(f"facts.{x}").eqNullSafe(c(f"source.{x}")) for x in ("mime_type", "size_bytes", "sha256")] + [c("facts.final_url").eqNullSafe(c("source.source_url"))]
    same = F.lit(True)
    for p in pairs:
        same = same & p
    empty = F.lit(True)
    for x in ("final_url", "http_status", "mime_type", "size_bytes", "sha256"):
        empty = empty & c(f"facts.{x}").isNull()
    return _first(
        ("manifest.tool_invalid", c("facts.tool_id").isNull() != c("facts.tool_version").isNull()), ("manifest.http_status_invalid", ~c("facts.http_status").between(100, 599)),
        ("manifest.success_facts_invalid", c("source").isNotNull() & (~same | c("facts.final_url").isNull() | c("facts.http_status").isNull() | c("facts.tool_id").isNull())),
        ("manifest.artifact_required", c("source").isNull() & ~empty),
    )


def fetch_code(fetches: DataFrame, parts: DataFrame) -> DataFrame:
    """(fetch_id, code) of fetches(fetch_id, usage columns, errors, stop_reason, terminal_artifact, terminal_role, terminal_mime, content) beside parts(fetch_id, pos, terminal, usage columns, errors, artifacts): its results and discoveries.

    Usage is the sum of the parts', errors are theirs in order and one of its own after a cancel; the terminal
    artifact is a source of the terminal result, of the content that is claimed.
    """
    c = F.col
    sums = [F.sum(x).alias(f"_{x}") for x in USAGE]
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "errors"))), lambda p: p["errors"])).alias("_errors")
    held = F.flatten(F.collect_list(F.when(c("terminal"), c("artifacts")))).alias("_artifacts")
    j = fetches.join(parts.groupBy("fetch_id").agg(*sums, listed, held), "fetch_id", "left")
    expected = F.concat(F.coalesce("_errors", F.array().cast("array<string>")), F.when(c("stop_reason") == "cancelled", F.array(F.lit("runtime.cancelled"))).otherwise(F.array().cast("array<string>")))
    spent = F.lit(False)
    for x in USAGE:
        spent = spent | (c(x) != F.coalesce(f"_{x}", F.lit(0)))
    kind = identity.content_kind(F.when(c("terminal_artifact").isNotNull(), c("terminal_mime")))
    code = _first(
        ("url_fetch.usage_mismatch", spent), ("url_fetch.errors_mismatch", c("errors") != expected),
        ("url_fetch.terminal_artifact_invalid", c("terminal_artifact").isNotNull() & ~F.coalesce((c("terminal_role") == "source") & F.array_contains("_artifacts", c("terminal_artifact")), F.lit(False))),
        ("url_fetch.content_type_mismatch", ~c("content").eqNullSafe(kind)),
    )
    return j.select("fetch_id", code.alias("code"))


def batch_mode(first_phase: Column, has_pages: Column, updated: Column, run_id: Column, identities: Column) -> Column:
    """How a site of a batch came to its state: failed without pages, recovered by an exploration, an update or a recovery run, else replayed."""
    again = F.exists(identities, lambda i: i.startswith(F.concat(run_id, F.lit("-recovery-"))))
    return F.when(~has_pages, "failed").when(first_phase | updated | again, "recovered").otherwise("replayed")


def batch_code(slots: DataFrame, sites: DataFrame) -> DataFrame:
    """(batch_id, pos, code) of sites of a batch that are not what the batch says of them.

    slots(batch_id, pos, site_key); sites(batch_id, pos, site_key, first_phase, run_ids, attempt_ids,
    has_pages, updated, has_candidate, stop_reason, mode, usable, continued, file_status, file_found): what the
    batch claims (mode, usable, continued, file_status) and what its result holds.  Keys stand in the order of
    the slots, run and attempt ids begin with the slot's own id, the claims are those that the result gives.
    """
    c = F.col
    j = sites.alias("r").join(slots.select("batch_id", "pos", c("site_key").alias("_slot")), ["batch_id", "pos"], "left")
    root = child_run_id(c("batch_id"), c("pos") + 1)
    ids = F.concat("run_ids", "attempt_ids")
    start = F.concat(root, F.when(c("first_phase"), "-seed").otherwise("-source"))
    mode = batch_mode(c("first_phase"), c("has_pages"), c("updated"), root, ids)
    going = c("has_pages") & ~c("stop_reason").isin("rejected", "cancelled") & (c("file_status") != "not_found") & F.when(c("first_phase"), c("has_candidate")).otherwise(c("updated") | (mode == "replayed"))
    code = _first(
        ("site_batch.site_order_invalid", ~c("_slot").eqNullSafe(c("r.site_key"))), ("site_batch.run_identity_mismatch", F.get("run_ids", F.lit(0)) != start), ("site_batch.run_identity_mismatch", F.exists(ids, lambda i: ~i.startswith(F.concat(root, F.lit("-"))))),
        ("site_batch.mode_mismatch", c("mode") != mode), ("site_batch.file_discovery_status_invalid", ~c("file_status").isin("not_requested", "satisfied", "not_found")),
        ("site_batch.file_discovery_status_mismatch", ((c("file_status") == "satisfied") & ~c("file_found")) | ((c("file_status") == "not_found") & c("file_found"))),
        ("site_batch.usable_sites_mismatch", c("usable") != c("has_pages")), ("site_batch.next_context_mismatch", c("continued") != going),
    )
    return j.select("batch_id", "pos", code.alias("code")).where("code is not null")


def handoff_record_code(prefix: str = "urn:spindrift:transform:") -> Column:
    """Code of a handoff whose parts contradict each other.

    Of (handoff_id, body_digest, job_id, run_id, status, generated_at, n_errors, source, artifacts, attempts):
    source is a struct of source_id, requested_url, current_url, final_url and redirects(from_url, to_url,
    decision); artifacts have artifact_id, observation_id, role, source_url, observed_at, tool_id,
    tool_version, content_ref; attempts outcome, requested_url, final_url, tool_id, tool_version, finished_at.
    """
    c = F.col
    kept, won = F.size("artifacts") > 0, F.filter("attempts", lambda a: a["outcome"] == "succeeded")
    fetched, made = F.filter(won, lambda a: a["final_url"].isNotNull()), F.filter(won, lambda a: a["final_url"].isNull())
    sources = F.filter("artifacts", lambda a: a["role"] == "source")
    first, src = F.get(fetched, F.lit(0)), F.get(sources, F.lit(0))
    failed = (c("n_errors") > 0) | F.exists("attempts", lambda a: a["outcome"] != "succeeded")
    start = F.struct(c("source.requested_url").alias("at"), F.lit(True).alias("ok"), F.lit(False).alias("ended"))
    walk = F.aggregate("source.redirects", start, lambda s, r: F.struct(
        F.when(r["decision"] == "rejected", r["from_url"]).otherwise(r["to_url"]).alias("at"), (s["ok"] & ~s["ended"] & (r["from_url"] == s["at"])).alias("ok"), (r["decision"] == "rejected").alias("ended")))
    ids = lambda name: F.transform("artifacts", lambda a: a[name])
    twice = lambda name: F.size(F.array_distinct(ids(name))) != F.size("artifacts")
    urn = lambda a: F.concat(F.lit(prefix), a["tool_id"], F.lit(":"), a["tool_version"])
    derived = F.filter("artifacts", lambda a: (a["role"] == "derived") & a["source_url"].startswith(prefix))
    paired = (F.size(derived) == F.size(made)) & F.forall(derived, lambda d: F.exists(made, lambda a: (urn(a) == d["source_url"]) & (a["tool_id"] == d["tool_id"]) & (a["requested_url"] == src["source_url"])))
    return _first(
        ("handoff.id_invalid", ~c("handoff_id").rlike("^[0-9a-f]{64}$")), ("handoff.run_id_mismatch", c("run_id") != c("job_id")), ("result.status_invalid", ~c("status").isin("completed", "partial", "rejected", "failed")), ("schema.time_invalid", ~identity.utc_valid(c("generated_at"))),
        ("handoff.source_id_mismatch", c("source.source_id") != c("source.requested_url")), ("redirect.chain_invalid", ~walk["ok"] | (walk["at"] != c("source.current_url")) | F.coalesce(c("source.final_url") != walk["at"], F.lit(False))),
        ("handoff.content_ref_invalid", F.exists("artifacts", lambda a: a["content_ref"] != F.concat(F.lit(CONTENT_REF), a["artifact_id"]))), ("artifact.duplicate", twice("artifact_id") | twice("observation_id")),
        ("job.time_invalid", F.exists("attempts", lambda a: a["finished_at"] > c("generated_at")) | F.exists("artifacts", lambda a: a["observed_at"] > c("generated_at"))),
        (F.concat(F.lit("result."), c("status"), F.lit("_requires_artifact")), c("status").isin("completed", "partial") & ~(kept & (F.size(won) > 0))), ("result.completed_has_failure", (c("status") == "completed") & failed), ("result.partial_requires_failure", (c("status") == "partial") & ~failed),
        (F.concat(F.lit("result."), c("status"), F.lit("_has_artifact")), c("status").isin("rejected", "failed") & (kept | (F.size(won) > 0))), (F.concat(F.lit("result."), c("status"), F.lit("_requires_error")), c("status").isin("rejected", "failed") & (c("n_errors") == 0)),
        ("manifest.artifact_required", ~kept & c("source.final_url").isNotNull()), ("redirect.chain_invalid", kept & walk["ended"]), ("handoff.source_invalid", kept & ((F.size(sources) != 1) | (F.size(fetched) != 1))),
        ("handoff.source_mismatch", kept & ~(
            src["source_url"].eqNullSafe(c("source.final_url")) & (src["tool_id"] == first["tool_id"]) & (src["tool_version"] == first["tool_version"]) & (first["requested_url"] == c("source.requested_url")) & first["final_url"].eqNullSafe(c("source.final_url")))),
        ("manifest.success_cardinality_invalid", F.size(made) > 1), ("manifest.transform_lineage_invalid", kept & ~paired), ("handoff.id_mismatch", c("handoff_id") != c("body_digest")),
    )


def skill_record_codes(skills: DataFrame) -> DataFrame:
    """Adds ``code`` to skills(site_key, version, previous_digest, tool_id, tool_version, capabilities, mime_types, minimum_words, discovery_category, discovery_source, origins, paths, digest, body_digest, verified_at): the first rule of a valid one that fails."""
    c = F.col
    own = lambda name: F.coalesce(F.size(name), F.lit(0)) <= 0
    twice = lambda name: F.size(name) != F.size(F.array_distinct(name))
    decided = urls.decide(c("_source"), c("origins"), c("paths"))
    found = c("discovery_source").isNotNull()
    code = _first(
        ("site_skill.site_key_invalid", ~matches(c("site_key"), TOOL_ID, 128)), ("site_skill.version_invalid", ~F.coalesce(c("version") > 0, F.lit(False))),
        ("site_skill.previous_invalid", (c("version") == 1) & c("previous_digest").isNotNull()), ("site_skill.previous_required", (c("version") > 1) & c("previous_digest").isNull()), ("site_skill.digest_invalid", c("previous_digest").isNotNull() & ~matches(c("previous_digest"), DIGEST)),
        ("site_skill.discovery_invalid", found & ~c("discovery_category").eqNullSafe(F.lit("discovery"))), (decided["code"], found & ~decided["allowed"]),
        ("site_skill.tool_capabilities_invalid", own("capabilities") | twice("capabilities") | F.exists("capabilities", lambda x: ~matches(x, TOOL_ID, 128))), ("site_skill.tool_invalid", ~matches(c("tool_id"), TOOL_ID, 128) | ~matches(c("tool_version"), VERSION)),
        ("site_skill.checks_invalid", own("mime_types") | twice("mime_types") | ~F.coalesce(c("minimum_words") > 0, F.lit(False)) | F.exists("mime_types", lambda m: ~identity.mime_valid(m))),
        ("site_skill.time_invalid", ~identity.utc_valid(c("verified_at"))), ("site_skill.digest_invalid", ~matches(c("digest"), DIGEST)), ("site_skill.digest_mismatch", c("digest") != c("body_digest")),
    )
    return skills.withColumn("_source", urls.canonical(c("discovery_source"))).withColumn("code", code).drop("_source")


def parsed_scopes(texts: DataFrame) -> DataFrame:
    """(scope_id, code, seeds, origins, paths) of texts(scope_id, body): strict JSON objects with exactly the fields of a scope, then ``validate_scopes``."""
    schema = "struct<seeds:array<string>,allowed_origins:array<string>,include_paths:array<string>,content_types:array<string>>"
    fields = F.array(*[F.lit(f) for f in SCOPE_FIELDS])
    strict = strict_json(F.col("body"))
    keys = F.json_object_keys("body")
    shape = F.when(strict == "json.duplicate_key", "schema.duplicate_key").when(strict.isNotNull(), "scope.invalid").when(F.size(F.array_except(keys, fields)) > 0, "scope.unknown_field").when(F.size(F.array_except(fields, keys)) > 0, "scope.missing")
    got = texts.withColumn("_shape", shape).withColumn("_s", F.from_json("body", schema))
    checked = validate_scopes(got.where("_shape is null").select("scope_id", F.col("_s.seeds").alias("seeds"), F.col("_s.allowed_origins").alias("origins"), F.col("_s.include_paths").alias("paths"), F.col("_s.content_types").alias("kinds")))
    return got.select("scope_id", "_shape").join(checked, "scope_id", "left").select("scope_id", F.coalesce("_shape", "code").alias("code"), "seeds", "origins", "paths")
