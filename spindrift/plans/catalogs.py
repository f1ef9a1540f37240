"""Queries over skills, catalogs and outcome cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import catalog, tools
from spindrift.plans.inputs import ATTEMPTS, attempts, choose, choose_sql, table
from spindrift.plans.runs import ELIGIBLE, TOOLS, _requirements, _tools

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(f"""WITH t AS (SELECT * FROM {TOOLS}) SELECT event_id AS site_key, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'site_skill.tool_unknown' WHEN 2 THEN 'site_skill.tool_version_mismatch' ELSE 'eligibility.unhealthy,eligibility.capability_missing:pdf' END AS reasons, event_id % 4 = 0 AS eligible FROM events""")
def skill_resolution(spark, sf_dir):
    n = F.col("event_id")
    s = events(spark, sf_dir).select(
        n.alias("site_key"), choose(n, "acquisition.web_http", "acquisition.none", "acquisition.playwright", "acquisition.cloakbrowser").alias("tool_id"), choose(n, "1.0.0", "1.0.0", "2.0.0", "0.5.9").alias("version"), F.lit("acquisition").alias("category"),
        F.when(n % 4 == 3, F.array(F.lit("html"), F.lit("pdf"))).otherwise(F.array(F.lit("html"))).alias("capabilities"),
    )
    return catalog.resolve_skills(s, _tools(spark)).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT event_id, event_id % 5 = 0 AS usable FROM events")
def exact_recipes(spark, sf_dir):
    n = F.col("event_id") % 5
    t = _tools(spark).withColumn("qualification", F.lit("qualified"))
    r = events(spark, sf_dir).select("event_id", F.when(n == 1, "discovery.none").otherwise("discovery.rss").alias("tool_id"), F.when(n == 2, "1.0.1").otherwise("1.0.0").alias("version"), F.when(n == 3, F.array(F.lit("rss"), F.lit("x"))).otherwise(F.array(F.lit("rss"))).alias("capabilities"), F.when(n == 4, 2000).otherwise(10).alias("input_bytes"))
    return catalog.exact_recipe(r, t).select("event_id", "usable")


@query("""SELECT 'b' || user_id AS tool_id, CASE WHEN user_id % 8 = 1 THEN '0.9.0' ELSE '1.0.0' END AS version, CASE user_id % 8 WHEN 0 THEN 'eligibility.not_installed' WHEN 1 THEN 'eligibility.version_mismatch' WHEN 2 THEN 'eligibility.runtime_identity_mismatch' WHEN 4 THEN 'eligibility.disabled' WHEN 5 THEN 'eligibility.unhealthy' WHEN 6 THEN 'eligibility.unqualified' ELSE 'eligibility.inactive' END AS reason
FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 8 <> 3""")
def browser_catalog(spark, sf_dir):
    """Users stand for browsers: not installed, other version active, other identity, usable, disabled, broken, unqualified, inactive."""
    u = events(spark, sf_dir).select("user_id").distinct()
    k = F.col("user_id") % 8
    tool = F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("tool_id")
    old = u.where("user_id % 8 <> 0").select(tool, F.lit("0.9.0").alias("version"), F.lit(1).alias("ord"), (k == 1).alias("active"), F.lit(False).alias("disabled"), F.lit(False).alias("broken"), F.lit(True).alias("qualified"), F.lit(True).alias("identity_ok"))
    new = u.where("user_id % 8 <> 0").select(tool, F.lit("1.0.0").alias("version"), F.lit(0).alias("ord"), k.isin(2, 3).alias("active"), (k == 4).alias("disabled"), (k == 5).alias("broken"), (k != 6).alias("qualified"), (k != 2).alias("identity_ok"))
    return catalog.browser_exclusions(old.unionByName(new), u.select(tool, F.lit("1.0.0").alias("version")))


@query(f"""WITH {ELIGIBLE}, m AS (SELECT * FROM (VALUES ('HTTP', 'acquisition.web_http'), ('BROWSER', 'acquisition.playwright'), ('CLOAK', 'acquisition.cloakbrowser'), ('FILE', 'acquisition.web_http'), ('OFFICIAL_ALTERNATE', 'acquisition.web_http')) AS v(method, tool_id))
SELECT req_id, method, tool_id, reasons = '' AND method <> 'OFFICIAL_ALTERNATE' AND NOT (method = 'FILE' AND req_id % 2 = 0) AND NOT (method = 'HTTP' AND req_id % 2 = 1) AS eligible,
CASE WHEN method = 'OFFICIAL_ALTERNATE' THEN 'retrieval.candidate_request_required' ELSE concat_ws(',', nullif(reasons, ''), CASE WHEN method = 'FILE' AND req_id % 2 = 0 THEN 'retrieval.file_request_required' WHEN method = 'HTTP' AND req_id % 2 = 1 THEN 'retrieval.html_request_required' END) END AS reasons FROM m JOIN e USING (tool_id)""")
def method_catalog(spark, sf_dir):
    """Even requests are for HTML, odd ones for files."""
    d = tools.eligibility(_tools(spark), _requirements(spark, sf_dir))
    kinds = events(spark, sf_dir).select(F.col("event_id").alias("req_id"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("html"))).otherwise(F.array(F.lit("file"))).alias("kinds"))
    return catalog.method_catalog(d, kinds).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT user_id AS site_key, bool_or(event_type = 'error') AS any_failed, bool_and(event_type <> 'error' AND event_id % 50 <> 0) AS all_complete, string_agg(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'text/html' ELSE 'text/xml' END, ',' ORDER BY CASE WHEN event_id % 2 = 0 THEN 'text/html' ELSE 'text/xml' END) AS kinds FROM events GROUP BY user_id")
def discovery_flags(spark, sf_dir):
    n = F.col("event_id")
    d = events(spark, sf_dir).select(F.col("user_id").alias("site_key"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("outcome"), F.when(F.col("event_type") != "error", F.when(n % 50 == 0, "truncated").otherwise("complete")).alias("coverage"), F.when(n % 2 == 0, "text/html").otherwise("text/xml").alias("mime"))
    return catalog.discovery_flags(d).withColumn("kinds", F.array_join("kinds", ","))


STOPS = "CASE WHEN event_id % 13 = 0 THEN 'source_exhausted' WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 5 = 0 THEN 'budget_exhausted' WHEN event_id % 3 = 0 THEN 'discovery_failed' ELSE 'acquisition_failed' END"


@query(f"SELECT event_id, CASE {STOPS} WHEN 'source_exhausted' THEN 'completed' WHEN 'rejected' THEN 'rejected' ELSE 'partial' END AS status, {STOPS} AS stop_reason FROM events")
def explore_outcome(spark, sf_dir):
    n = F.col("event_id")
    e = events(spark, sf_dir).select("event_id", (n % 13 == 0).alias("has_skill"), (n % 11 == 0).alias("rejected"), (n % 7 == 0).alias("cancelled"), (n % 5 == 0).alias("budget_exhausted"), F.lit(False).alias("discovery_failed"), (n % 3).alias("n_selected"))
    return e.withColumn("o", catalog.explore_outcome()).select("event_id", "o.status", "o.stop_reason")


RECOVERED = "CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'budget_exhausted' ELSE 'rejected' END WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN CASE WHEN event_id % 3 > 0 THEN 'source_exhausted' ELSE 'recovery_incomplete' END WHEN event_id % 5 = 0 THEN 'budget_exhausted' WHEN event_id % 9 = 0 THEN 'cancelled' ELSE 'recovery_incomplete' END"


@query(f"SELECT event_id, {RECOVERED} = 'source_exhausted' AS complete, {RECOVERED} AS stop_reason FROM events")
def recovery_outcome(spark, sf_dir):
    n = F.col("event_id")
    e = events(spark, sf_dir).select("event_id", F.lit(False).alias("identity_mismatch"), (n % 7 == 0).alias("rejected"), (n % 5 == 0).alias("budget_exhausted"), (n % 2 == 0).alias("explored"), F.lit(True).alias("has_skill"), (n % 3 > 0).alias("covered"), F.when(n % 9 == 0, "cancelled").otherwise("acquisition_failed").alias("stop_reason"))
    return e.withColumn("o", catalog.recovery_outcome()).select("event_id", "o.complete", "o.stop_reason")


@query(f"""WITH {ATTEMPTS}, c AS (SELECT run_id, code, min(ord) AS o FROM attempts WHERE code IS NOT NULL AND code <> 'gateway.timeout' GROUP BY ALL)
SELECT run_id, 'gateway.timeout' || coalesce(',' || string_agg(code, ',' ORDER BY o), '') AS codes, 'gateway.timeout' AS first FROM c GROUP BY run_id""")
def error_merge(spark, sf_dir):
    """Each run has one error of its own, a timeout, and then those of its attempts."""
    a = attempts(spark, sf_dir)
    codes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"])
    own = F.array(F.lit("gateway.timeout"))
    g = a.groupBy("run_id").agg(codes.alias("c"), F.count_if(F.col("code") != "gateway.timeout").alias("n")).where("n > 0")
    return g.select("run_id", F.array_join(catalog.merged_errors(own, F.col("c")), ",").alias("codes"), catalog.first_failure(own, F.col("c")).alias("first"))


@query("SELECT user_id AS batch_id, coalesce(string_agg('s' || event_id, ',' ORDER BY event_id) FILTER (WHERE event_id % 3 = 0), '') AS site_keys FROM events GROUP BY user_id")
def usable_sites(spark, sf_dir):
    r = events(spark, sf_dir).select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("pos"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("site_key"), (F.col("event_id") % 3 == 0).alias("usable"))
    return catalog.usable_sites(r).withColumn("site_keys", F.array_join("site_keys", ","))


@query("SELECT user_id AS batch_id, event_id AS pos, CASE WHEN event_id % 10 = 0 THEN 'site_batch_request.refresh_context_missing' ELSE 'site_batch_request.site_order_mismatch' END AS code FROM events WHERE event_id % 10 = 0 OR event_id % 10 = 3")
def slot_mismatches(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("site_key"))
    return catalog.slot_mismatches(e, e.where("pos % 10 <> 0").withColumn("site_key", F.when(F.col("pos") % 10 == 3, "other").otherwise(F.col("site_key"))))


@query(f"SELECT doc_id, {choose_sql('doc_id', None, 'site_skill.digest_invalid', 'site_skill.digest_mismatch', 'site_skill.version_invalid', 'site_skill.previous_invalid', 'site_skill.time_invalid', 'site_skill.checks_invalid')} AS code FROM documents")
def skill_shape(spark, sf_dir):
    n = F.col("doc_id") % 7
    d = F.concat(F.lit("sha256:"), F.sha2("text", 256))
    s = table(spark, sf_dir, "documents").select("doc_id", F.when(n == 3, 0).when(n == 4, 2).otherwise(1).alias("version"), F.when(n == 1, "sha1:0").otherwise(d).alias("digest"), F.lit(None).cast("string").alias("previous_digest"), F.when(n == 2, "sha256:0").when(n == 1, "sha1:0").otherwise(d).alias("body_digest"), F.when(n == 5, "2024-13-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z").alias("verified_at"), F.when(n == 6, 0).otherwise(1).alias("words"))
    return s.select("doc_id", catalog.skill_code().alias("code"))


@query(f"SELECT doc_id, {choose_sql('doc_id', None, 'handoff.identity_mismatch', 'handoff.time_invalid', 'handoff.tool_mismatch')} AS code FROM documents")
def handoff_shape(spark, sf_dir):
    n = F.col("doc_id") % 4
    ident = F.concat(F.lit("handoff-"), F.sha2("text", 256))
    h = table(spark, sf_dir, "documents").select("doc_id", F.when(n == 1, "handoff-0").otherwise(ident).alias("handoff_id"), F.col("text").alias("body"), F.lit("2024-01-01T00:00:01Z").alias("generated_at"), F.when(n == 2, "2024-01-01T00:00:02Z").otherwise("2024-01-01T00:00:00Z").alias("last_observed_at"), F.lit("a").alias("source_tool"), F.when(n != 3, "a").alias("attempt_tool"))
    return h.select("doc_id", catalog.handoff_code().alias("code"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS gone, n_chars, lang FROM documents) SELECT doc_id, CASE WHEN gone THEN 'external.file_missing' WHEN octet_length(encode(t)) <> n_chars THEN 'external.size_mismatch' WHEN t <> trim(t) OR n_chars % 10 = 0 THEN 'external.sha256_mismatch' WHEN lang IS DISTINCT FROM 'en' THEN 'external.mime_mismatch' WHEN n_chars > 1000 THEN 'external.runtime_limit' END AS code FROM d""")
def external_responses(spark, sf_dir):
    """Documents as an external tool's files: sizes are given in characters, digests of the trimmed text or of another, only English ones with the right suffix, a millisecond a character of a second's limit."""
    text = F.concat(F.trim("text"), F.when(F.col("n_chars") % 10 == 0, "!").otherwise(""))
    r = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text, 256).alias("claimed_sha256"), F.col("n_chars").alias("claimed_size"), F.lit("text/markdown").alias("claimed_mime"), F.col("text").alias("body"), F.when(F.col("lang") == "en", ".md").otherwise(".txt").alias("path_suffix"), F.col("n_chars").alias("runtime_ms"), F.lit(1).alias("max_runtime_seconds"))
    return r.select("doc_id", catalog.external_code().alias("code"))
