"""Evidence that a run leaves: exploded results, proposals and stored chains re-verified, redirect authority, skill proofs.

Codes are columns, sets are DataFrames; all of it is built-in expressions but for IPv6 addresses.
"""

from __future__ import annotations

import ipaddress
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import identity, urls
from spindrift.functions.shared import small
from spindrift.operators.policy import OBSERVATION_ID, matches
from spindrift.operators.results import REDIRECTS, public_address, retrieval_error

# The policy id of robots decisions, their kinds, and reasons of tools that are declared but not usable.
ROBOTS_POLICY, ROBOTS_DECISIONS = "robots-unknown-allow.v1", ("allowed", "denied", "absent", "unknown_allow")
UNAVAILABLE = ("eligibility.version_mismatch", "eligibility.runtime_identity_mismatch", "eligibility.not_installed", "eligibility.disabled", "eligibility.inactive", "eligibility.unhealthy", "eligibility.unqualified")
# Failures after which no alternate may be tried.
NO_ALTERNATE = ("acquisition.auth_required", "acquisition.permission_denied", "acquisition.interaction_required")
# The types of changes, in the order of their collections.
CHANGE_TYPES = ("added", "changed", "unchanged", "missing", "failed", "unresolved")


def _first(*rules: tuple[str | Column, Column]) -> Column:
    """The code of the first rule that holds; a rule that cannot be told holds not."""
    return F.coalesce(*[F.when(when, F.lit(code) if isinstance(code, str) else code) for code, when in rules])


# ---- exploded results


def attempt_rows(results: DataFrame) -> DataFrame:
    """results(run_id, attempts array<struct>) as (run_id, ord, every field of an attempt), ord from 0."""
    return results.select("run_id", F.posexplode("attempts").alias("ord", "a")).select("run_id", F.col("ord").cast("bigint").alias("ord"), "a.*")


def artifact_rows(results: DataFrame) -> DataFrame:
    """results(run_id, artifacts array<struct<..., lineage array>>) as (run_id, every field of an artifact but its lineage)."""
    return results.select("run_id", F.inline("artifacts")).drop("lineage")


def lineage_rows(results: DataFrame) -> DataFrame:
    """(run_id, every field of an edge) of the artifacts' lineage."""
    return results.select("run_id", F.explode("artifacts").alias("a")).select("run_id", F.inline("a.lineage"))


def redirect_rows(results: DataFrame) -> DataFrame:
    """results(run_id, redirects array<struct<kind, source_url, target_url, status_code>>) as rows, ordinals from 1."""
    return results.select("run_id", F.posexplode("redirects").alias("at", "r")).select("run_id", (F.col("at") + 1).cast("bigint").alias("ordinal"), "r.*")


def grants(results: DataFrame) -> DataFrame:
    """(caller_id, artifact_id), each once: what the callers of results(caller_id, artifacts array<struct<artifact_id, ...>>) may read."""
    return results.select("caller_id", F.explode(F.array_distinct(F.transform("artifacts", lambda a: a["artifact_id"]))).alias("artifact_id")).distinct()


# ---- stored evidence


def source_url_valid(url: Column) -> Column:
    """Whether a source locator is 1 to 2048 characters without control characters or white space around it."""
    return F.coalesce(url.rlike(r"(?U)^\S(?:.*\S)?$") & ~url.rlike(r"[\x00-\x1f\x7f]") & (F.length(url) <= 2048), F.lit(False))


def proposal_code() -> Column:
    """Code of a proposal(content, sha256, size_bytes, mime_type, role, derived_from, source_url, observed_at) that must not be stored."""
    c = F.col
    derived = c("role") == "derived"
    return _first(
        ("blob.sha256_invalid", ~F.coalesce(c("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), ("blob.size_invalid", ~F.coalesce(c("size_bytes") >= 0, F.lit(False))),
        ("blob.sha256_mismatch", F.sha2(c("content").cast("binary"), 256) != c("sha256")), ("blob.size_mismatch", F.octet_length("content") != c("size_bytes")),
        ("mime.invalid", ~identity.mime_valid(c("mime_type"))), ("artifact.role_invalid", ~F.coalesce(c("role").isin("source", "derived"), F.lit(False))),
        ("lineage.forbidden", ~derived & c("derived_from").isNotNull()), ("lineage.required", derived & c("derived_from").isNull()),
        ("observation.id_invalid", derived & ~matches(c("derived_from"), OBSERVATION_ID)),
        ("observation.source_invalid", ~source_url_valid(c("source_url"))), ("observation.time_invalid", ~identity.utc_valid(c("observed_at"))),
    )


def lineage_code(edge: Column | None = None) -> Column:
    """Code of an edge(observation_id, artifact_id, relation, source_observation_id, source_artifact_id, lineage_id) that is of another kind, its own source, or has another's id."""
    at = (lambda name: edge[name]) if edge is not None else F.col
    expected = identity.lineage_id(at("artifact_id"), at("observation_id"), at("source_artifact_id"), at("source_observation_id"))
    return _first(
        ("lineage.invalid", ~F.coalesce(at("relation") == "derived_from", F.lit(False))), ("lineage.self_reference", at("observation_id") == at("source_observation_id")),
        ("lineage.invalid", ~F.coalesce(at("lineage_id") == expected, F.lit(False))),
    )


def chain_code() -> Column:
    """Code of a loaded observation(content, sha256, size_bytes, relative_path, artifact_id, blob_sha256, mime_type, role, observation_id, observed_artifact_id, source_url, observed_at, lineage) one of whose links does not verify."""
    c = F.col
    edges = F.coalesce("lineage", F.array().cast("array<struct<lineage_id:string,observation_id:string,artifact_id:string,relation:string,source_observation_id:string,source_artifact_id:string>>"))
    wrong = F.get(F.filter(F.transform(edges, lineage_code), lambda code: code.isNotNull()), F.lit(0))
    return _first(
        ("blob.missing", c("content").isNull()), ("blob.sha256_mismatch", F.sha2(c("content").cast("binary"), 256) != c("sha256")), ("blob.size_mismatch", F.octet_length("content") != c("size_bytes")),
        ("path.invalid", ~identity.portable_path(c("relative_path"))), ("blob.path_invalid", c("relative_path") != identity.blob_path(c("sha256"))),
        ("artifact.invalid", (c("blob_sha256") != c("sha256")) | (c("artifact_id") != identity.artifact_id(c("sha256"), c("mime_type"), c("role")))),
        ("observation.id_invalid", ~matches(c("observation_id"), OBSERVATION_ID)), ("observation.source_invalid", ~source_url_valid(c("source_url"))), ("observation.time_invalid", ~identity.utc_valid(c("observed_at"))),
        ("observation.invalid", c("observed_artifact_id") != c("artifact_id")), (wrong, wrong.isNotNull()),
        ("lineage.forbidden", (c("role") == "source") & (F.size(edges) > 0)), ("lineage.required", (c("role") == "derived") & (F.size(edges) != 1)),
        ("lineage.invalid", F.exists(edges, lambda e: (e["observation_id"] != c("observation_id")) | (e["artifact_id"] != c("artifact_id")))),
    )


def collection_lineage(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, observation_id, code) of edges whose source pair is not among artifacts(run_id, observation_id, artifact_id, role) of their run, or is no source."""
    held = artifacts.select("run_id", F.col("observation_id").alias("source_observation_id"), F.col("artifact_id").alias("source_artifact_id"), F.col("role").alias("_role"))
    code = F.when(F.col("_role").isNull(), "lineage.dangling").when(F.col("_role") != "source", "lineage.source_role_invalid")
    return edges.join(held, ["run_id", "source_observation_id", "source_artifact_id"], "left").select("run_id", "observation_id", code.alias("code")).where("code is not null")


def unreadable(observations: DataFrame, artifacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """(observation_id, code) of observations whose artifact or blob is not there: a read of them fails."""
    a = artifacts.select("artifact_id", "blob_sha256")
    b = blobs.select(F.col("sha256").alias("blob_sha256"), F.lit(True).alias("_held"))
    code = F.when(F.col("blob_sha256").isNull(), "artifact.missing").when(F.col("_held").isNull(), "blob.missing")
    return observations.join(a, "artifact_id", "left").join(b, "blob_sha256", "left").select("observation_id", code.alias("code")).where("code is not null")


def reconciled(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(observation_id, code) of handed-off artifacts whose facts are not those of the stored observation; both have the same columns."""
    facts = [c for c in expected.columns if c != "observation_id"]
    a, b = expected.select("observation_id", F.struct(*facts).alias("_e")), stored.select("observation_id", F.struct(*facts).alias("_s"))
    bad = ~F.col("_e").eqNullSafe(F.col("_s"))
    return a.join(b, "observation_id", "left").where(bad).select("observation_id", F.lit("handoff.artifact_mismatch").alias("code"))


# ---- decisions and redirects


def robots_code() -> Column:
    """Code of a robots decision(origin, robots_url, target_url, status_code, decision, reason_code, policy_id) whose record is not sound."""
    c = F.col
    unsafe = lambda u: ~F.coalesce(u.rlike(r"^https?://[^/?#@\s\\]+(?:/[^?#\\]*)?(?:\?query-sha256=[0-9a-f]{64})?$"), F.lit(False))
    return _first(
        ("robots.url_invalid", unsafe(c("origin")) | unsafe(c("robots_url")) | unsafe(c("target_url"))), ("robots.origin_invalid", ~c("origin").rlike("^https?://[^/?#]+$")),
        ("robots.status_invalid", ~c("status_code").between(100, 599)), ("robots.decision_invalid", ~F.coalesce(c("decision").isin(*ROBOTS_DECISIONS), F.lit(False))),
        ("robots.reason_invalid", ~F.coalesce(c("reason_code").rlike(r"^[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+$"), F.lit(False))), ("robots.policy_invalid", ~c("policy_id").eqNullSafe(F.lit(ROBOTS_POLICY))),
    )


def redirect_authority(hops: DataFrame, origins: Column, paths: Column) -> DataFrame:
    """Adds (target_url, code) to hops(kind, current_url, location, status_code, origin): where a redirect leads, resolved and canonical, and whether it may be followed.

    A redirect of a target stays in scope, one of a robots file on the origin that the file is for; neither
    leaves https.
    """
    location = F.trim("location")
    joined = urls.canonical(urls.resolved(F.col("current_url"), location))
    got = hops.withColumn("_t", F.when(F.coalesce(location, F.lit("")) != "", joined))
    target = F.col("_t.url")
    robots = F.col("kind") == "robots"
    down = F.col("current_url").startswith("https://") & target.startswith("http://")
    decided = urls.decide(F.col("_t"), origins, paths)
    code = _first(
        ("gateway.redirect_status", ~F.coalesce(F.col("status_code").isin(*REDIRECTS), F.lit(False))), ("robots.redirect_missing", robots & (F.coalesce(location, F.lit("")) == "")), ("gateway.redirect_missing", F.coalesce(location, F.lit("")) == ""),
        ("gateway.redirect_invalid", target.isNull()), ("gateway.https_downgrade", down), ("robots.redirect_origin", robots & (urls.origin(target) != F.col("origin"))), ("policy.allowed", robots), (decided["code"], F.lit(True)),
    )
    return got.withColumns({"target_url": target, "code": code}).drop("_t")


def public_ip(ip: Column) -> Column:
    """Whether an address of either version is global and no multicast; dotted ones by built-ins."""
    def run(texts: pd.Series) -> pd.Series:
        def judge(text):
            try:
                address = ipaddress.ip_address(text)
            except ValueError:
                return False
            return address.is_global and not address.is_multicast

        return pd.Series([t is not None and judge(t) for t in texts])

    six = ip.contains(":")
    return F.when(six, F.pandas_udf(run, "boolean")(F.when(six, ip))).otherwise(public_address(ip))


def resolution_code(addresses: Column, public: Column) -> Column:
    """Code of a name's resolved addresses, with whether each is public: none at all, or one that is not."""
    return F.when(F.coalesce(F.size(addresses), F.lit(0)) <= 0, "gateway.dns_failed").when(~F.forall(public, lambda p: p), "gateway.dns_not_public")


def may_use_alternates(codes: Column) -> Column:
    """Whether a retrieval whose called attempts failed with ``codes`` may go on to alternates: no final code, and nothing that asks for a person."""
    return retrieval_error(codes, F.lit(False)).isNull() & ~F.exists(codes, lambda c: c.isin(*NO_ALTERNATE))


def failure_projection(status: Column, n_artifacts: Column, cancelled: Column) -> Column:
    """Status of a run that ended in an exception or a cancel: what was kept makes it partial; a rejection stays one."""
    return F.when(status == "rejected", "rejected").when(n_artifacts > 0, "partial").when(cancelled, "partial").otherwise("failed")


def refresh_assembly(complete: Column, codes: Column, rejected: Column) -> Column:
    """struct<complete, status, stop_reason> of a refresh: an exhausted budget makes it incomplete whatever it found."""
    spent, cancelled = F.array_contains(codes, "budget.exhausted"), F.array_contains(codes, "runtime.cancelled")
    stop = F.when(cancelled, "cancelled").when(spent, "budget_exhausted").when(rejected, "rejected").when(complete, "source_exhausted").otherwise("acquisition_failed")
    done = stop == "source_exhausted"
    return F.struct(done.alias("complete"), F.when(done, "completed").when(stop == "rejected", "rejected").otherwise("partial").alias("status"), stop.alias("stop_reason"))


# ---- refreshes and batches


def collection_code(changes: DataFrame) -> DataFrame:
    """(run_id, code) of refreshes whose changes(run_id, collection, pos, url, change_type) are out of order, of another type than their collection, or in two of them."""
    listed = changes.groupBy("run_id", "collection").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "change_type"))).alias("c"))
    names = F.transform("c", lambda x: x["url"])
    own = listed.select("run_id", _first(("site_refresh.change_order_invalid", names != F.array_sort(names)), ("site_refresh.change_type_invalid", F.exists("c", lambda x: ~x["change_type"].eqNullSafe(F.col("collection"))))).alias("code"))
    twice = changes.groupBy("run_id", "url").agg(F.count("*").alias("n")).where("n > 1").select("run_id", F.lit("site_refresh.change_overlap").alias("code"))
    rank = F.array_position(F.array(*[F.lit(f"site_refresh.change_{x}") for x in ("order_invalid", "type_invalid", "overlap")]), F.col("code"))
    return own.where("code is not null").unionByName(twice).groupBy("run_id").agg(F.min_by("code", rank).alias("code"))


def refresh_state_code() -> Column:
    """Code of a refresh(previous_site, current_site, previous_digest, current_digest, used_digest, update_previous, update_digest, update_site, complete) whose states do not belong to its skill."""
    c = F.col
    updated = c("update_digest").isNotNull()
    current = c("current_digest").eqNullSafe(c("used_digest")) | (updated & c("current_digest").eqNullSafe(c("update_digest"))) | (~updated & ~c("complete") & c("current_digest").isNull())
    return _first(
        ("site_refresh.state_mismatch", (c("previous_site") != c("current_site")) | ~c("previous_digest").eqNullSafe(c("used_digest"))),
        ("site_refresh.skill_update_invalid", updated & (~c("update_previous").eqNullSafe(c("used_digest")) | ~c("update_site").eqNullSafe(c("current_site")))),
        ("site_refresh.state_mismatch", ~current),
    )


def file_goal(artifacts: DataFrame, pages: DataFrame, barred: DataFrame) -> DataFrame:
    """Site keys with a file that a candidate run acquired and the site's state holds: artifacts(site_key, run_id, role, mime_type, source_url, observation_id, artifact_id, sha256), pages(site_key, canonical_url, observation_id, artifact_id, content_digest), barred(site_key) rejected or cancelled."""
    files = artifacts.where((F.col("role") == "source") & F.col("run_id").rlike(r"-candidate-[1-9]\d*$") & ~F.col("mime_type").isin(*identity.HTML_TYPES))
    facts = files.select("site_key", F.col("source_url").alias("canonical_url"), "observation_id", "artifact_id", F.concat(F.lit("sha256:"), "sha256").alias("content_digest"))
    return facts.join(pages, ["site_key", "canonical_url", "observation_id", "artifact_id", "content_digest"], "left_semi").select("site_key").distinct().join(barred.select("site_key").distinct(), "site_key", "left_anti")


def success_checks(results: DataFrame) -> DataFrame:
    """(site_key, passed) of results(site_key, mime_type, text): each has a source, and each HTML one a word."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"(?U)\S+")), F.lit(0))
    ok = F.col("mime_type").isNotNull() & (~F.col("mime_type").isin(*identity.HTML_TYPES) | (words >= 1))
    return results.groupBy("site_key").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("passed"))


# ---- tools and skills


def preferred_transform(decisions: DataFrame) -> DataFrame:
    """(req_id, tool_id, version) of the transform that is tried, one at most: of decisions(req_id, tool_id, version, eligible, external, position) the first eligible one, installed ones before the built-in."""
    order = F.struct((~F.col("external")).cast("int").alias("builtin"), "position", "tool_id")
    return decisions.where("eligible").groupBy("req_id").agg(F.min_by(F.struct("tool_id", "version"), order).alias("t")).select("req_id", "t.*")


def with_unavailable(decisions: DataFrame, declared: DataFrame) -> DataFrame:
    """decisions(req_id, tool_id, version, eligible, reasons) and one for each request and tool that is declared unavailable: declared(tool_id, version, reason), each reason one of ``UNAVAILABLE``."""
    known = small(declared.where(F.col("reason").isin(*UNAVAILABLE)))
    out = decisions.select("req_id").distinct().join(known).select("req_id", "tool_id", "version", F.lit(False).alias("eligible"), F.array("reason").alias("reasons"))
    return decisions.select("req_id", "tool_id", "version", "eligible", "reasons").unionByName(out)


def declaration_code(registered: DataFrame, declared: DataFrame) -> DataFrame:
    """(tool_id, code) of declarations(tool_id, reason) that may not be made: the id is taken, or the reason is none."""
    many = declared.groupBy("tool_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("reason").isin(*UNAVAILABLE), F.lit(False))).alias("ok"))
    j = many.join(registered.select("tool_id", F.lit(True).alias("taken")).distinct(), "tool_id", "left")
    return j.select("tool_id", _first(("registry.duplicate_id", (F.col("n") > 1) | F.col("taken")), ("eligibility.facts_invalid", ~F.col("ok"))).alias("code")).where("code is not null")


def skill_candidates(attempts: DataFrame, selected: DataFrame, discovery: DataFrame, sources: DataFrame) -> DataFrame:
    """(site_key, tool_id, tool_version, discovery_tool, discovery_version, discovery_source, mime_types, code): the skill that an exploration proves.

    attempts(site_key, run_id, is_seed, tool_id, tool_version, requested_url, final_url, outcome),
    selected(site_key, url, discovery_source, discovery_tool, discovery_version), discovery(site_key,
    tool_id, tool_version, source_url, outcome), sources(site_key, run_id, is_seed, mime_type).  A proof is a
    success on a selected candidate with a tool that succeeded on the seed too; it can be replayed if the
    discovery that found the candidate succeeded.  The least proof is chosen; the content types are the
    seed's and those of its tool's proofs.
    """
    tool = ["site_key", "tool_id", "tool_version"]
    good = attempts.where("outcome = 'succeeded' and final_url is not null")
    seed_tools = good.where("is_seed").select(*tool).distinct()
    found = selected.withColumnRenamed("url", "requested_url")
    proofs = good.where("not is_seed").join(seed_tools, tool, "left_semi").join(found, ["site_key", "requested_url"])
    ran = discovery.where("outcome = 'succeeded'").select("site_key", F.col("tool_id").alias("discovery_tool"), F.col("tool_version").alias("discovery_version"), F.col("source_url").alias("discovery_source"), F.lit(True).alias("_ran")).distinct()
    proofs = proofs.join(ran, ["site_key", "discovery_tool", "discovery_version", "discovery_source"], "left")
    order = F.struct("tool_id", "tool_version", "requested_url", "discovery_tool", "discovery_version", "discovery_source")
    replay = F.coalesce("_ran", F.lit(False))
    best = proofs.groupBy("site_key").agg(F.min(F.when(replay, order)).alias("p"))
    kinds = proofs.where(replay).join(sources.select("site_key", "run_id", "mime_type"), ["site_key", "run_id"]).groupBy(*tool).agg(F.collect_set("mime_type").alias("_kinds"))
    seeds = sources.where("is_seed").groupBy("site_key").agg(F.min("mime_type").alias("_seed"))
    sites = attempts.select("site_key").distinct()
    j = sites.join(best.withColumn("_proved", F.lit(True)), "site_key", "left").join(seeds, "site_key", "left")
    j = j.select("site_key", "_proved", "_seed", "p.*").join(kinds, tool, "left")
    code = _first(("runtime.site_skill_tool_unverified", F.col("_proved").isNull()), ("runtime.site_skill_discovery_unverified", F.col("tool_id").isNull()), ("runtime.site_skill_tool_unverified", F.col("_seed").isNull()))
    mimes = F.when(code.isNull(), F.array_sort(F.array_union(F.array("_seed"), F.coalesce("_kinds", F.array().cast("array<string>")))))
    return j.select("site_key", "tool_id", "tool_version", "discovery_tool", "discovery_version", "discovery_source", mimes.alias("mime_types"), code.alias("code"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
