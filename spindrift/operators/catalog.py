"""Skill resolution, exact recipes, tool catalogs, and the outcome cascades of explorations and refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import identity
from spindrift.functions.shared import small
from spindrift.operators.policy import DIGEST, matches
from spindrift.operators.results import METHODS


def _first_reason(*pairs: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for when, code in reversed(pairs):
        out = F.when(when, code).otherwise(out)
    return out


def resolve_skills(skills: DataFrame, tools: DataFrame) -> DataFrame:
    """(site_key, eligible, reasons) of skills(site_key, tool_id, version, category, capabilities): the registered tool of that id must have the exact version and be usable."""
    t = small(tools.select("tool_id", F.col("version").alias("_v"), F.col("category").alias("_c"), F.col("capabilities").alias("_caps"), "health", "qualification"))
    j = skills.join(t, "tool_id", "left")
    missing = F.transform(F.array_sort(F.array_except("capabilities", "_caps")), lambda c: F.concat(F.lit("eligibility.capability_missing:"), c))
    own = F.filter(F.array(F.when(F.col("category") != F.col("_c"), "eligibility.category_mismatch"), F.when(F.col("health") != "healthy", "eligibility.unhealthy"), F.when(F.col("qualification") != "qualified", "eligibility.unqualified")), lambda x: x.isNotNull())
    reasons = F.when(F.col("_v").isNull(), F.array(F.lit("site_skill.tool_unknown"))).when(F.col("_v") != F.col("version"), F.array(F.lit("site_skill.tool_version_mismatch"))).otherwise(F.concat(own, missing))
    return j.select("site_key", reasons.alias("reasons")).withColumn("eligible", F.size("reasons") == 0)


def exact_recipe(recipes: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds ``usable`` to recipes(tool_id, version, capabilities, input_bytes): the discovery tool of that id, version and all capabilities exists and takes the input."""
    t = small(tools.where("category = 'discovery' and health = 'healthy' and qualification = 'qualified'").select("tool_id", F.col("version").alias("_v"), F.col("capabilities").alias("_caps"), "max_input_bytes"))
    j = recipes.join(t, "tool_id", "left")
    ok = (F.col("_v") == F.col("version")) & (F.size(F.array_except("capabilities", "_caps")) == 0) & (F.col("input_bytes") <= F.col("max_input_bytes"))
    return j.withColumn("usable", F.coalesce(ok, F.lit(False))).drop("_v", "_caps", "max_input_bytes")


def browser_exclusions(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tool_id, version, reason) of wanted(tool_id, version) browsers that are not active, by states(tool_id, version, ord, active, disabled, broken, qualified, identity_ok).

    Of a tool's installed versions the active one speaks, else the wanted one, else the last.
    """
    w = wanted.withColumnRenamed("version", "_want")
    s = states.join(small(w), "tool_id")
    rank = F.struct(F.col("active").cast("int").alias("a"), (F.col("version") == F.col("_want")).cast("int").alias("w"), "ord")
    pick = s.groupBy("tool_id").agg(F.max_by(F.struct("version", "active", "disabled", "broken", "qualified", "identity_ok"), rank).alias("s"))
    j = w.join(pick, "tool_id", "left")
    reason = _first_reason(
        (F.col("s").isNull(), "eligibility.not_installed"), (F.col("s.version") != F.col("_want"), "eligibility.version_mismatch"), (F.col("s.active") & ~F.col("s.identity_ok"), "eligibility.runtime_identity_mismatch"),
        (F.col("s.active"), "usable"), (F.col("s.disabled"), "eligibility.disabled"), (F.col("s.broken"), "eligibility.unhealthy"), (~F.col("s.qualified"), "eligibility.unqualified"), (F.lit(True), "eligibility.inactive"),
    )
    return j.select("tool_id", F.coalesce("s.version", "_want").alias("version"), reason.alias("reason")).where("reason <> 'usable'")


def method_catalog(decisions: DataFrame, kinds: DataFrame) -> DataFrame:
    """(req_id, method, tool_id, eligible, reasons) of each method a caller may name, by decisions(req_id, tool_id, eligible, reasons) and kinds(req_id, kinds): the requested content kinds."""
    spark = decisions.sparkSession
    rows = [(m, t) for t, m in METHODS.items()] + [("FILE", "acquisition.web_http"), ("OFFICIAL_ALTERNATE", "acquisition.web_http")]
    methods = spark.createDataFrame(rows, "method string, tool_id string")
    j = kinds.join(F.broadcast(methods)).join(decisions.select("req_id", "tool_id", "eligible", "reasons"), ["req_id", "tool_id"], "left")
    has = lambda k: F.array_contains("kinds", k)
    extra = F.when((F.col("method") == "FILE") & ~has("file"), F.array(F.lit("retrieval.file_request_required"))).when((F.col("method") == "HTTP") & ~has("html"), F.array(F.lit("retrieval.html_request_required"))).otherwise(F.array().cast("array<string>"))
    reasons = F.when(F.col("method") == "OFFICIAL_ALTERNATE", F.array(F.lit("retrieval.candidate_request_required"))).otherwise(F.concat(F.coalesce("reasons", F.array(F.lit("eligibility.not_installed"))), extra))
    return j.select("req_id", "method", "tool_id", (F.coalesce("eligible", F.lit(False)) & (F.size(extra) == 0) & (F.col("method") != "OFFICIAL_ALTERNATE")).alias("eligible"), reasons.alias("reasons"))


def discovery_flags(discoveries: DataFrame) -> DataFrame:
    """(site_key, any_failed, all_complete, kinds) of discoveries(site_key, outcome, coverage, mime)."""
    return discoveries.groupBy("site_key").agg(
        F.bool_or(F.col("outcome") == "failed").alias("any_failed"), F.bool_and(F.coalesce(F.col("coverage") == "complete", F.lit(False))).alias("all_complete"), F.array_sort(F.collect_set("mime")).alias("kinds")
    )


def explore_outcome() -> Column:
    """struct<status, stop_reason> of an exploration(has_skill, rejected, cancelled, budget_exhausted, discovery_failed, n_selected), first rule that holds."""
    stop = _first_reason(
        (F.col("has_skill"), "source_exhausted"), (F.col("rejected"), "rejected"), (F.col("cancelled"), "cancelled"), (F.col("budget_exhausted"), "budget_exhausted"),
        (F.col("discovery_failed") | (F.col("n_selected") == 0), "discovery_failed"), (F.lit(True), "acquisition_failed"),
    )
    return F.struct(F.when(stop == "source_exhausted", "completed").when(stop == "rejected", "rejected").otherwise("partial").alias("status"), stop.alias("stop_reason"))


def recovery_outcome() -> Column:
    """struct<complete, stop_reason> of a recovery(identity_mismatch, rejected, budget_exhausted, explored, has_skill, covered, stop_reason)."""
    c = F.col
    stop = (
        F.when((c("identity_mismatch") | c("rejected")) & c("budget_exhausted"), "budget_exhausted").when(c("identity_mismatch") | c("rejected"), "rejected")
        .when(c("explored") & c("has_skill") & ~c("budget_exhausted"), F.when(c("covered"), "source_exhausted").otherwise("recovery_incomplete"))
        .when(c("budget_exhausted"), "budget_exhausted").when(c("stop_reason").isin("budget_exhausted", "cancelled", "rejected"), c("stop_reason")).otherwise("recovery_incomplete")
    )
    return F.struct((stop == "source_exhausted").alias("complete"), stop.alias("stop_reason"))


def merged_errors(codes: Column, attempt_codes: Column) -> Column:
    """Errors of a run and then those of its attempts that are new, each once, in order."""
    new = F.array_distinct(F.filter(attempt_codes, lambda c: c.isNotNull() & ~F.array_contains(codes, c)))
    return F.concat(codes, new)


def first_failure(errors: Column, attempt_codes: Column) -> Column:
    """The code of a failed result: its first error's, else that of its first attempt with one."""
    return F.coalesce(F.get(errors, F.lit(0)), F.get(F.filter(attempt_codes, lambda c: c.isNotNull()), F.lit(0)))


def usable_sites(results: DataFrame) -> DataFrame:
    """(batch_id, site_keys): the sites of results(batch_id, pos, site_key, usable) whose state can be continued, in order."""
    listed = F.array_sort(F.collect_list(F.when(F.col("usable"), F.struct("pos", "site_key"))))
    return results.groupBy("batch_id").agg(F.transform(listed, lambda x: x["site_key"]).alias("site_keys"))


def slot_mismatches(sites: DataFrame, contexts: DataFrame) -> DataFrame:
    """(batch_id, pos, code) of batch slots and refresh contexts (batch_id, pos, site_key) that do not stand at the same place."""
    j = sites.alias("s").join(contexts.alias("c"), ["batch_id", "pos"], "full_outer")
    code = F.when(F.col("c.site_key").isNull() | F.col("s.site_key").isNull(), "site_batch_request.refresh_context_missing").when(F.col("s.site_key") != F.col("c.site_key"), "site_batch_request.site_order_mismatch")
    return j.select("batch_id", "pos", code.alias("code")).where("code is not null")


def skill_code() -> Column:
    """Code of a skill(site_key, version, digest, previous_digest, body_digest, verified_at, words) whose record does not hold together."""
    c = F.col
    return (
        F.when(~matches(c("digest"), DIGEST), "site_skill.digest_invalid").when(c("digest") != c("body_digest"), "site_skill.digest_mismatch").when(c("version") < 1, "site_skill.version_invalid")
        .when((c("version") == 1) != c("previous_digest").isNull(), "site_skill.previous_invalid").when(c("previous_digest") == c("digest"), "site_skill.previous_invalid")
        .when(~identity.utc_valid(c("verified_at")), "site_skill.time_invalid").when(c("words") < 1, "site_skill.checks_invalid")
    )


def handoff_code() -> Column:
    """Code of a handoff(handoff_id, body, generated_at, last_observed_at, source_tool, attempt_tool) that contradicts its own facts."""
    c = F.col
    return (
        F.when(c("handoff_id") != F.concat(F.lit("handoff-"), F.sha2(c("body"), 256)), "handoff.identity_mismatch").when(c("last_observed_at") > c("generated_at"), "handoff.time_invalid")
        .when(~c("source_tool").eqNullSafe(c("attempt_tool")), "handoff.tool_mismatch")
    )


def external_code() -> Column:
    """Code of an external tool's response(claimed_sha256, claimed_size, claimed_mime, body, path_suffix, runtime_ms, max_runtime_seconds) that its re-read file does not confirm."""
    c = F.col
    suffix = F.when(c("claimed_mime") == "text/markdown", ".md").when(c("claimed_mime").isin(*identity.HTML_TYPES), ".html").when(c("claimed_mime") == "application/json", ".json")
    return (
        F.when(c("body").isNull(), "external.file_missing").when(F.octet_length("body") != c("claimed_size"), "external.size_mismatch").when(F.sha2(c("body").cast("binary"), 256) != c("claimed_sha256"), "external.sha256_mismatch")
        .when(~F.coalesce(c("path_suffix") == suffix, F.lit(False)), "external.mime_mismatch").when(F.ceil(c("runtime_ms") / 1000) > c("max_runtime_seconds"), "external.runtime_limit")
    )
