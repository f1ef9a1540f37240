"""Queries over runs: store tables, snapshots, ledgers, tools, jobs, results, streams and the fetch-log source."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import jobs, ledger, results, state, store, tools
from spindrift.plans.inputs import ATTEMPTS, BODIES, OBSERVED, attempts, bodies, choose, choose_sql, table, values
from spindrift.sources import fetchlog
from spindrift.streaming import feeds

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- store


def _observed(spark, sf_dir):
    return store.observe(bodies(spark, sf_dir))


@query(f"WITH {OBSERVED} SELECT sha256, min(size_bytes) AS size_bytes, 'blobs/' || substr(sha256, 1, 2) || '/' || sha256 || '.blob' AS relative_path FROM observed GROUP BY sha256")
def blob_dedup(spark, sf_dir):
    return store.blobs(_observed(spark, sf_dir))


@query(f"WITH {OBSERVED} SELECT artifact_id, count(*) AS n_observations, count(DISTINCT source_url) AS n_urls FROM observed GROUP BY artifact_id")
def blob_reuse(spark, sf_dir):
    return _observed(spark, sf_dir).groupBy("artifact_id").agg(F.count("*").alias("n_observations"), F.countDistinct("source_url").alias("n_urls"))


@query(f"WITH {OBSERVED} SELECT observation_id, artifact_id, source_url, observed_at, sha256 AS blob_sha256, mime AS mime_type, size_bytes FROM observed")
def observation_join(spark, sf_dir):
    o = _observed(spark, sf_dir)
    return store.full_observations(store.observations(o), store.artifacts(o), store.blobs(o)).select("observation_id", "artifact_id", "source_url", "observed_at", "blob_sha256", "mime_type", "size_bytes")


@query(f"""WITH {OBSERVED} SELECT source_url, observed_at, observation_id, artifact_id, n_observations FROM
(SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY observed_at DESC, observation_id DESC) AS rn, count(*) OVER (PARTITION BY source_url) AS n_observations FROM observed) WHERE rn = 1""")
def latest_observation(spark, sf_dir):
    return store.latest(store.observations(_observed(spark, sf_dir)))


DERIVED = OBSERVED + """, made AS (SELECT *, '# ' || doc_id AS derived FROM observed WHERE mime = 'text/html'),
edges AS (SELECT observation_id AS source_observation_id, artifact_id AS source_artifact_id, sha256(derived) AS blob_sha256,
 'artifact-' || sha256('{"blob_sha256":"' || sha256(derived) || '","mime_type":"text/markdown","role":"derived"}') AS artifact_id,
 'observation-' || substr(sha256(run_id || chr(10) || 'urn:spindrift:transform:transform.simple:1.0.0' || chr(10) || observation_id), 1, 32) AS observation_id FROM made)"""


def _edges(spark, sf_dir):
    o = _observed(spark, sf_dir).where("mime = 'text/html'").withColumn("derived", F.concat(F.lit("# "), F.col("doc_id").cast("string")))
    return store.derive(o, "text/markdown", "transform.simple", "1.0.0")


@query(f"""WITH {DERIVED} SELECT observation_id, artifact_id, source_observation_id, source_artifact_id,
'lineage-' || sha256('{{"artifact_id":"' || artifact_id || '","observation_id":"' || observation_id || '","relation":"derived_from","source_artifact_id":"' || source_artifact_id || '","source_observation_id":"' || source_observation_id || '"}}') AS lineage_id FROM edges""")
def lineage_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("observation_id", "artifact_id", "source_observation_id", "source_artifact_id", "lineage_id")


@query(f"WITH {OBSERVED} SELECT artifact_id, count(*) AS n FROM observed GROUP BY artifact_id HAVING bool_or(doc_id % 2 = 0)")
def caller_visibility(spark, sf_dir):
    """Observations of the artifacts that the caller was granted: those that an even document holds."""
    o = _observed(spark, sf_dir)
    grants = o.select("artifact_id", choose(F.col("doc_id"), "caller-0", "caller-1").alias("caller_id"))
    return store.visible(o, grants, "caller-0").groupBy("artifact_id").agg(F.count("*").alias("n"))


@query(f"WITH {OBSERVED} SELECT sha256, 'blob.conflict' AS code FROM observed GROUP BY sha256 HAVING min(doc_id) % 10 = 0")
def blob_conflicts(spark, sf_dir):
    """Blobs whose held size differs, here by construction those whose first document's id ends in 0."""
    o = _observed(spark, sf_dir)
    held = o.groupBy("sha256").agg(F.min("size_bytes").alias("size_bytes"), F.min("doc_id").alias("d"))
    held = held.select("sha256", (F.col("size_bytes") + F.when(F.col("d") % 10 == 0, 1).otherwise(0)).alias("size_bytes"))
    return store.conflicts(store.blobs(o).select("sha256", "size_bytes"), held, "sha256")


@query(f"WITH {OBSERVED} SELECT DISTINCT sha256 FROM observed WHERE run_id = 'run-2' AND sha256 NOT IN (SELECT sha256 FROM observed WHERE run_id <> 'run-2')")
def blob_append(spark, sf_dir):
    """Blobs a third run adds to those of the first two."""
    o = _observed(spark, sf_dir)
    return store.new_rows(store.blobs(o.where("run_id = 'run-2'")), store.blobs(o.where("run_id <> 'run-2'")), "sha256").select("sha256")


@query(f"WITH {OBSERVED} SELECT sha256, CASE WHEN min(doc_id) % 50 = 0 THEN 'blob.corrupt' WHEN min(doc_id) % 50 = 1 THEN 'blob.missing' END AS code FROM observed GROUP BY sha256")
def blob_verify(spark, sf_dir):
    o = _observed(spark, sf_dir)
    held = o.groupBy("sha256").agg(F.min("size_bytes").alias("size_bytes"), F.min_by("body", "doc_id").alias("body"), F.min("doc_id").alias("d"))
    broken = held.withColumn("body", F.when(F.col("d") % 50 == 0, F.concat("body", F.lit("!"))).when(F.col("d") % 50 != 1, F.col("body")))
    return store.verified(broken).select("sha256", "code")


# ---- snapshots

SNAPSHOTS = """prev AS (SELECT url, page_id, 'sha256:' || sha256(html) AS d FROM pages WHERE page_id % 5 <> 0),
cur AS (SELECT url, page_id, 'sha256:' || sha256(CASE WHEN page_id % 3 = 0 THEN html || '!' ELSE html END) AS d FROM pages WHERE page_id % 4 <> 0),
p AS (SELECT url, min_by(d, page_id) AS d FROM prev GROUP BY url), c AS (SELECT url, min_by(d, page_id) AS d FROM cur GROUP BY url), f AS (SELECT DISTINCT url FROM pages WHERE page_id % 7 = 0),
diff AS (SELECT coalesce(p.url, c.url, f.url) AS url, p.d AS previous_digest, c.d AS current_digest,
 CASE WHEN c.d IS NOT NULL AND p.d IS NULL THEN 'added' WHEN c.d = p.d THEN 'unchanged' WHEN c.d IS NOT NULL THEN 'changed' WHEN f.url IS NOT NULL THEN 'failed' ELSE '{rest}' END AS change_type
 FROM p FULL OUTER JOIN c ON p.url = c.url FULL OUTER JOIN f ON f.url = coalesce(p.url, c.url))"""


def _snapshots(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("canonical_url", F.col("url"))

    def take(rows, body):
        digest = F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("content_digest")
        return rows.select("canonical_url", "page_id", digest).groupBy("canonical_url").agg(F.min_by("content_digest", "page_id").alias("content_digest"))

    prev = take(p.where("page_id % 5 <> 0"), F.col("html"))
    cur = take(p.where("page_id % 4 <> 0"), F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    return prev, cur, p.where("page_id % 7 = 0").select("url")


def _diff(spark, sf_dir, complete):
    return state.diff(*_snapshots(spark, sf_dir), complete=complete)


@query(f"WITH {SNAPSHOTS.format(rest='missing')} SELECT url, change_type, previous_digest, current_digest FROM diff")
def site_diff_complete(spark, sf_dir):
    return _diff(spark, sf_dir, True)


@query(f"WITH {SNAPSHOTS.format(rest='unresolved')} SELECT url, change_type, previous_digest, current_digest FROM diff")
def site_diff_incomplete(spark, sf_dir):
    return _diff(spark, sf_dir, False)


@query(f"WITH {SNAPSHOTS.format(rest='missing')} SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS site_key, change_type, count(*) AS n FROM diff GROUP BY ALL")
def change_counts(spark, sf_dir):
    return _diff(spark, sf_dir, True).groupBy(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("site_key"), "change_type").agg(F.count("*").alias("n"))


@query(f"WITH {SNAPSHOTS.format(rest='missing')} SELECT coalesce(c.url, p.url) AS canonical_url, coalesce(c.d, p.d) AS content_digest FROM p FULL OUTER JOIN c ON p.url = c.url")
def state_merge(spark, sf_dir):
    prev, cur, _ = _snapshots(spark, sf_dir)
    return state.merge_recovered(cur, prev)


@query(f"WITH {SNAPSHOTS.format(rest='missing')} SELECT url, 'not_attempted' AS gap FROM p WHERE url NOT IN (SELECT url FROM c) UNION ALL SELECT url, 'not_expected' FROM c WHERE url NOT IN (SELECT url FROM p)")
def coverage_gaps(spark, sf_dir):
    prev, cur, _ = _snapshots(spark, sf_dir)
    p, c = prev.select(F.col("canonical_url").alias("url")), cur.select(F.col("canonical_url").alias("url"))
    return state.coverage_gaps(p, c, c)


@query(f"""WITH {OBSERVED}, first AS (SELECT regexp_extract(source_url, '^https?://([^/?#]*)', 1) AS site_key, source_url, min_by(artifact_id, observed_at) AS a, 'sha256:' || min_by(sha256, observed_at) AS d, min_by(observation_id, observed_at) AS o FROM observed GROUP BY ALL)
SELECT site_key, count(*) AS n_pages, 'sha256:' || sha256('[' || string_agg('{{"artifact_id":"' || a || '","canonical_url":"' || source_url || '","content_digest":"' || d || '","observation_id":"' || o || '"}}', ',' ORDER BY source_url) || ']') AS digest FROM first GROUP BY site_key""")
def site_state_digest(spark, sf_dir):
    o = _observed(spark, sf_dir).select(F.regexp_extract("source_url", "^https?://([^/?#]*)", 1).alias("site_key"), F.col("source_url").alias("canonical_url"), "observation_id", "artifact_id", F.concat(F.lit("sha256:"), "sha256").alias("content_digest"), "observed_at")
    return state.state_digest(state.site_state(o, F.col("observed_at")))


# ---- ledgers

A = f"WITH {ATTEMPTS}"


@query(f"{A} SELECT run_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(bytes_received) AS BIGINT) AS bytes_received, CAST(sum(runtime_ms) AS BIGINT) AS runtime_ms, count(*) FILTER (WHERE outcome <> 'skipped') AS tool_attempts FROM attempts GROUP BY run_id")
def usage_rollup(spark, sf_dir):
    return ledger.usage(attempts(spark, sf_dir), "run_id")


@query(f"{A} SELECT run_id % 10 AS batch_id, run_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(bytes_received) AS BIGINT) AS bytes_received, CAST(sum(runtime_ms) AS BIGINT) AS runtime_ms, count(*) FILTER (WHERE outcome <> 'skipped') AS tool_attempts, CAST(grouping(run_id % 10) * 2 + grouping(run_id) AS BIGINT) AS level FROM attempts GROUP BY ROLLUP (run_id % 10, run_id)")
def usage_batch_rollup(spark, sf_dir):
    return ledger.usage_rollup(attempts(spark, sf_dir).withColumn("batch_id", F.col("run_id") % 10), "batch_id", "run_id")


@query(f"{A} SELECT run_id FROM attempts GROUP BY run_id HAVING run_id % 3 = 0")
def usage_consistency(spark, sf_dir):
    """Runs whose declared usage is wrong, here by construction every third."""
    a = attempts(spark, sf_dir)
    declared = ledger.usage(a, "run_id").withColumn("requests", F.col("requests") + F.when(F.col("run_id") % 3 == 0, 1).otherwise(0)).withColumn("runtime_ms", F.col("runtime_ms") + 5)
    return ledger.usage_mismatch(a, declared, "run_id").select("run_id")


REQ, BYTES, SECONDS = 30, 90_000, 15
LEDGER = f"""{ATTEMPTS}, before AS (SELECT *, {REQ} - coalesce(sum(requests) OVER w, 0) AS left_requests, {BYTES} - coalesce(sum(bytes_received) OVER w, 0) AS left_bytes,
 floor(({SECONDS} * 1000 - coalesce(sum(runtime_ms) OVER w, 0)) / 1000.0) AS left_seconds FROM attempts WINDOW w AS (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ledger AS (SELECT *, left_requests > 0 AND left_bytes > 0 AND left_seconds > 0 AS dispatch FROM before)"""


@query(f"WITH {LEDGER} SELECT attempt_id, CAST(left_requests AS BIGINT) AS left_requests, CAST(left_bytes AS BIGINT) AS left_bytes, CAST(left_seconds AS BIGINT) AS left_seconds, dispatch FROM ledger")
def budget_ledger(spark, sf_dir):
    return ledger.ledger(attempts(spark, sf_dir), REQ, BYTES, SECONDS).select("attempt_id", F.col("left_requests").cast("bigint"), F.col("left_bytes").cast("bigint"), F.col("left_seconds").cast("bigint"), "dispatch")


@query(f"WITH {LEDGER} SELECT run_id, count(*) AS n, max(ord) AS last_ord FROM (SELECT *, bool_and(dispatch) OVER (PARTITION BY run_id ORDER BY ord) AS going FROM ledger) WHERE going GROUP BY run_id")
def budget_dispatch(spark, sf_dir):
    return ledger.dispatched(ledger.ledger(attempts(spark, sf_dir), REQ, BYTES, SECONDS)).groupBy("run_id").agg(F.count("*").alias("n"), F.max("ord").alias("last_ord"))


@query(f"{A} SELECT run_id, sum(requests) >= 50 OR sum(bytes_received) >= 100000 OR sum(runtime_ms) >= 26000 AS explore_exhausted, sum(requests) > 50 OR sum(bytes_received) > 100000 OR sum(runtime_ms) > 26000 AS refresh_exhausted FROM attempts GROUP BY run_id")
def budget_exhausted(spark, sf_dir):
    return ledger.exhausted(attempts(spark, sf_dir), 50, 100_000, 26)


@query(f"{A} SELECT attempt_id, outcome = 'skipped' OR coalesce(sum(CASE WHEN outcome <> 'skipped' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, url ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4 AS within FROM attempts")
def attempt_cap(spark, sf_dir):
    return ledger.capped(attempts(spark, sf_dir), 4, "run_id", "url").select("attempt_id", "within")


STOP = "outcome = 'succeeded' OR (outcome = 'failed' AND NOT (code = 'gateway.timeout' OR (code = 'acquisition.cloudflare_blocked' AND tool_id = 'acquisition.web_http')))"


@query(f"{A} SELECT attempt_id FROM (SELECT *, coalesce(max(CASE WHEN {STOP} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, url ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM attempts) WHERE s = 0")
def retry_switching(spark, sf_dir):
    return ledger.switching(attempts(spark, sf_dir)).select("attempt_id")


@query(f"{A} SELECT run_id, count(*) AS n_called, arg_max(tool_id, ord) AS tool_id, arg_max(outcome, ord) AS outcome, max_by(code, ord) FILTER (WHERE true) AS code0, CASE WHEN arg_max(outcome, ord) = 'failed' THEN arg_max(coalesce(code, ''), ord) END AS code FROM attempts WHERE outcome <> 'skipped' GROUP BY run_id".replace("max_by(code, ord) FILTER (WHERE true) AS code0, ", ""))
def last_called_attempt(spark, sf_dir):
    return ledger.last_called(attempts(spark, sf_dir))


@query(f"""{A}, t AS (SELECT run_id || '/' || (ord // 8) || '/' || url AS target, * FROM attempts) SELECT target AS url, string_agg(DISTINCT attempt_id, ',' ORDER BY attempt_id) AS attempt_ids, string_agg(DISTINCT code, ',' ORDER BY code) AS codes
FROM t WHERE outcome = 'failed' AND code IS NOT NULL AND target NOT IN (SELECT target FROM t WHERE outcome = 'succeeded') GROUP BY target""")
def failed_urls(spark, sf_dir):
    """Targets of each eight attempts of a run that failed and never succeeded in them."""
    a = attempts(spark, sf_dir).withColumn("url", F.concat_ws("/", "run_id", F.floor(F.col("ord") / 8), "url"))
    return state.failed_urls(a).select("url", F.array_join("attempt_ids", ",").alias("attempt_ids"), F.array_join("codes", ",").alias("codes"))


@query(f"{A} SELECT attempt_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ord DESC) - 1 AS BIGINT) AS position FROM attempts")
def attempt_renumber(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("back", -F.col("ord"))
    return ledger.renumbered(a, "back").select("attempt_id", "position")


@query(f"{A} SELECT run_id, arg_min(code, ord) AS code FROM attempts WHERE starts_with(code, 'scope.') GROUP BY run_id")
def first_rejection(spark, sf_dir):
    return ledger.first_rejection(attempts(spark, sf_dir))


@query(f"""{A} SELECT url, outcome, CASE WHEN bool_or(starts_with(coalesce(code, ''), 'scope.')) THEN 'rejected' ELSE 'acquisition_failed' END AS stop_reason FROM attempts GROUP BY url, outcome""")
def stop_reason(spark, sf_dir):
    g = attempts(spark, sf_dir).groupBy("url", "outcome").agg(F.collect_set("code").alias("codes"))
    return g.select("url", "outcome", ledger.stop_reason(F.col("codes"), F.lit(False)).alias("stop_reason"))


@query(f"""{A}, g AS (SELECT run_id || '/' || (ord // 3) AS result, count(*) FILTER (WHERE outcome = 'succeeded') AS s, count(*) FILTER (WHERE outcome <> 'succeeded') AS o, bool_or(starts_with(coalesce(code, ''), 'scope.')) AS r FROM attempts GROUP BY result)
SELECT result, CASE WHEN s > 0 AND o = 0 THEN 'completed' WHEN s > 0 THEN 'partial' WHEN r THEN 'rejected' ELSE 'failed' END AS status FROM g""")
def result_status(spark, sf_dir):
    """Status of each three attempts of a run, every success leaving an artifact."""
    g = attempts(spark, sf_dir).groupBy(F.concat_ws("/", "run_id", F.floor(F.col("ord") / 3)).alias("result")).agg(F.count_if(F.col("outcome") == "succeeded").alias("s"), F.count_if(F.col("outcome") != "succeeded").alias("o"), F.bool_or(ledger.rejection(F.col("code"))).alias("r"))
    return g.select("result", ledger.result_status(F.col("s"), F.col("s"), F.col("o"), F.lit(0), F.col("r")).alias("status"))


# ---- tools and skills

TOOLS = """(VALUES ('acquisition.web_http', '1.0.0', 'acquisition', 'healthy', 'qualified', 'html', 30, 1000, 9000), ('acquisition.playwright', '1.0.0', 'acquisition', 'healthy', 'qualified', 'html,render', 60, 1000, 9000),
 ('acquisition.cloakbrowser', '0.5.9', 'acquisition', 'unhealthy', 'qualified', 'html,render', 60, 1000, 9000), ('discovery.rss', '1.0.0', 'discovery', 'healthy', 'unqualified', 'rss', 30, 1000, 500)) AS t(tool_id, version, category, health, qualification, caps, max_runtime_seconds, max_input_bytes, max_output_bytes)"""


def _tools(spark):
    return values(spark, TOOLS).withColumn("capabilities", F.split("caps", ",")).drop("caps")


def _requirements(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("req_id"), F.lit("acquisition").alias("category"), F.when(n % 2 == 0, F.array(F.lit("html"))).otherwise(F.array(F.lit("html"), F.lit("render"))).alias("capabilities"),
        ((n % 3) * 600).cast("int").alias("input_bytes"), F.lit(100).alias("output_bytes"), F.when(n % 5 == 0, 45).otherwise(20).alias("runtime_seconds"),
        F.lit(None).cast("array<string>").alias("installed"), F.lit(None).cast("array<string>").alias("compliant"), (n % 11).alias("left_requests"), F.lit(1).alias("left_bytes"), F.lit(5000).alias("left_runtime_ms"), F.lit(1).alias("left_attempts"),
    )


ELIGIBLE = f"""r AS (SELECT event_id AS n FROM events), t AS (SELECT * FROM {TOOLS}), e AS (SELECT n AS req_id, tool_id, version, concat_ws(',',
 CASE WHEN category <> 'acquisition' THEN 'eligibility.category_mismatch' END, CASE WHEN health <> 'healthy' THEN 'eligibility.unhealthy' END, CASE WHEN qualification <> 'qualified' THEN 'eligibility.unqualified' END,
 CASE WHEN NOT contains(caps, 'html') THEN 'eligibility.capability_missing:html' END, CASE WHEN n % 2 = 1 AND NOT contains(caps, 'render') THEN 'eligibility.capability_missing:render' END,
 CASE WHEN (n % 3) * 600 > max_input_bytes THEN 'eligibility.input_limit' END, CASE WHEN (CASE WHEN n % 5 = 0 THEN 45 ELSE 20 END) > max_runtime_seconds THEN 'eligibility.runtime_limit' END, CASE WHEN n % 11 = 0 THEN 'eligibility.request_budget_exhausted' END) AS reasons FROM r, t)"""


@query(f"WITH {ELIGIBLE} SELECT req_id, tool_id, version, reasons, reasons = '' AS eligible FROM e")
def tool_eligibility(spark, sf_dir):
    got = tools.eligibility(_tools(spark), _requirements(spark, sf_dir))
    return got.select("req_id", "tool_id", "version", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query(f"""WITH {ELIGIBLE}, ok AS (SELECT *, req_id % 4 = 1 AS attempted FROM e WHERE reasons = '' AND NOT (req_id % 4 = 1 AND tool_id = 'acquisition.playwright')),
g AS (SELECT req_id, bool_or(tool_id = 'acquisition.playwright') AS has FROM ok GROUP BY req_id)
SELECT req_id, tool_id, version, row_number() OVER (PARTITION BY req_id ORDER BY tool_id <> 'acquisition.playwright', CASE tool_id WHEN 'acquisition.web_http' THEN 0 WHEN 'acquisition.playwright' THEN 1 WHEN 'acquisition.cloakbrowser' THEN 2 ELSE 3 END, tool_id) AS rank FROM ok JOIN g USING (req_id) WHERE has OR attempted""")
def tool_ranking(spark, sf_dir):
    """Ranking with the browser preferred, which every fourth request has attempted already."""
    d = tools.eligibility(_tools(spark), _requirements(spark, sf_dir))
    none = F.array().cast("array<string>")
    pref = table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), F.lit("acquisition.playwright").alias("preferred"), F.when(F.col("event_id") % 4 == 1, F.array(F.lit("acquisition.playwright"))).otherwise(none).alias("attempted"), F.lit(True).alias("alternates"))
    return tools.ranking(d, pref)


@query(f"{A} SELECT attempt_id, CASE WHEN code = 'gateway.timeout' THEN true WHEN code = 'acquisition.cloudflare_blocked' THEN tool_id = 'acquisition.web_http' ELSE false END AS switch, coalesce(starts_with(code, 'runner.'), false) AS operational FROM attempts")
def failure_switch(spark, sf_dir):
    from spindrift.operators import quality

    return attempts(spark, sf_dir).select("attempt_id", quality.allows_switch(F.col("code"), F.col("tool_id")).alias("switch"), quality.operational(F.col("code")).alias("operational"))


@query(f"{A}, t AS (SELECT tool_id AS next_tool_id FROM {TOOLS} WHERE category = 'acquisition') SELECT attempt_id, next_tool_id FROM attempts, t WHERE outcome = 'failed' AND (NOT (code = 'acquisition.cloudflare_blocked' AND tool_id = 'acquisition.web_http') OR next_tool_id = 'acquisition.playwright')")
def followup_tools(spark, sf_dir):
    a = attempts(spark, sf_dir).where("outcome = 'failed'").select(F.col("attempt_id").alias("run_id"), "code", "tool_id")
    return tools.followups(a, _tools(spark).where("category = 'acquisition'")).withColumnRenamed("run_id", "attempt_id")


SKILL_EVENTS = "skill_events AS (SELECT user_id AS site_key, event_id AS sequence, CASE event_type WHEN 'purchase' THEN 'activate' WHEN 'error' THEN 'rollback' ELSE 'candidate' END AS action, 'd' || (event_id % 9) AS to_digest FROM events)"


def _skill_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("site_key"), F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "purchase", "activate").when(F.col("event_type") == "error", "rollback").otherwise("candidate").alias("action"), F.concat(F.lit("d"), (F.col("event_id") % 9).cast("string")).alias("to_digest"))


@query(f"WITH {SKILL_EVENTS} SELECT site_key, arg_max(to_digest, sequence) AS digest, max(sequence) AS sequence FROM skill_events WHERE action IN ('activate', 'rollback') GROUP BY site_key")
def skill_active(spark, sf_dir):
    return tools.active_skills(_skill_events(spark, sf_dir))


def _skills(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return c.select(F.concat(F.lit("site"), F.col("conv_id").cast("string")).alias("site_key"), (F.col("turn") + 1).alias("version"), F.concat(F.lit("s"), "conv_id", F.lit("v"), "turn").alias("digest"), F.when(F.col("turn") > 0, F.concat(F.lit("s"), "conv_id", F.lit("v"), F.col("turn") - 1)).alias("previous_digest"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT 'site' || a.conv_id AS site_key, 's' || a.conv_id || 'v' || a.turn AS digest, 's' || a.conv_id || 'v' || b.g AS ancestor, CAST(a.turn - b.g AS BIGINT) AS depth
FROM t a, (SELECT unnest(range(0, 1000)) AS g) b WHERE b.g <= a.turn AND NOT EXISTS (SELECT 1 FROM range(b.g + 1, a.turn + 1) r(x) WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.conv_id = a.conv_id AND c.turn = r.x))""".replace("(SELECT unnest(range(0, 1000)) AS g) b WHERE b.g <= a.turn AND NOT EXISTS (SELECT 1 FROM range(b.g + 1, a.turn + 1) r(x) WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.conv_id = a.conv_id AND c.turn = r.x))", "(SELECT DISTINCT conv_id, turn AS g FROM t) b WHERE b.conv_id = a.conv_id AND b.g <= a.turn"))
def skill_lineage(spark, sf_dir):
    """Conversations' turns stand for the versions of a skill, each following the one before."""
    return tools.ancestors(_skills(spark, sf_dir))


@query("SELECT 'site' || conv_id AS site_key, CAST(turn + 1 AS BIGINT) AS version FROM (SELECT DISTINCT conv_id, turn FROM conversations) a WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.turn % 5 <> 3)")
def skill_breaks(spark, sf_dir):
    """Versions whose predecessor is gone, here by construction each fourth of five."""
    s = _skills(spark, sf_dir)
    kept = s.where("(version - 1) % 5 <> 3")
    prev = kept.select("site_key", (F.col("version") + 1).alias("version"), F.lit(1).alias("k"))
    return tools.lineage_breaks(s.join(prev, ["site_key", "version"], "left").withColumn("previous_digest", F.when(F.col("k").isNull() & (F.col("version") > 1), "gone").otherwise(F.col("previous_digest"))).drop("k")).select("site_key", F.col("version").cast("bigint").alias("version"))


@query("""WITH v AS (SELECT 'tool' || (user_id % 20) AS tool_id, '1.' || (event_id % 4) || '.0' AS version, event_id AS sequence, CASE event_type WHEN 'purchase' THEN 'activate' WHEN 'error' THEN 'disable' WHEN 'signup' THEN 'install' WHEN 'click' THEN 'qualify' ELSE 'broken' END AS event FROM events),
live AS (SELECT tool_id, arg_max(version, sequence) AS live FROM v WHERE event = 'activate' GROUP BY tool_id)
SELECT tool_id, version, arg_max(event, sequence) AS status, coalesce(version = any_value(live) AND arg_max(event, sequence) = 'activate', false) AS active FROM v LEFT JOIN live USING (tool_id) GROUP BY tool_id, version""")
def tool_lifecycle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    event = F.when(F.col("event_type") == "purchase", "activate").when(F.col("event_type") == "error", "disable").when(F.col("event_type") == "signup", "install").when(F.col("event_type") == "click", "qualify").otherwise("broken")
    return tools.tool_states(e.select(F.concat(F.lit("tool"), F.col("user_id") % 20).alias("tool_id"), F.concat(F.lit("1."), F.col("event_id") % 4, F.lit(".0")).alias("version"), F.col("event_id").alias("sequence"), event.alias("event")))


# ---- jobs: every event is a job of its own with two or three states

JOB = """job_events AS (SELECT 'job-' || event_id AS job_id, s AS sequence, CASE WHEN s = 1 THEN 'submitted' WHEN s = 2 THEN CASE WHEN event_id % 13 = 0 THEN 'completed' ELSE 'running' END ELSE """ + choose_sql("event_id", "completed", "partial", "rejected", "failed") + """ END AS status,
 strftime(date_trunc('second', ts) + to_seconds(s * 5), '%Y-%m-%dT%H:%M:%SZ') AS "at" FROM events, (VALUES (1), (2), (3)) q(s) WHERE s < 3 OR event_type <> 'view')"""


def _job_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("s < 3 or event_type <> 'view'")
    n = F.col("event_id")
    status = F.when(F.col("s") == 1, "submitted").when(F.col("s") == 2, F.when(n % 13 == 0, "completed").otherwise("running")).otherwise(choose(n, "completed", "partial", "rejected", "failed"))
    at = F.date_format(F.date_trunc("second", "ts") + F.make_dt_interval(secs=F.col("s") * 5), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(F.concat(F.lit("job-"), n.cast("string")).alias("job_id"), F.col("s").alias("sequence"), status.alias("status"), at.alias("at"))


@query(f"""WITH {JOB} SELECT job_id, arg_max(status, sequence) AS status, arg_max("at", sequence) AS "at", count(*) AS n_events, arg_max(status, sequence) IN ('completed', 'partial', 'rejected', 'failed') AS terminal FROM job_events GROUP BY job_id""")
def job_final_state(spark, sf_dir):
    return jobs.final_states(_job_events(spark, sf_dir))


@query(f"""WITH {JOB} SELECT job_id, sequence, prev AS previous_status, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY sequence) AS prev FROM job_events) WHERE NOT ((prev IS NULL AND status = 'submitted') OR (coalesce(prev, '') = 'submitted' AND status = 'running') OR (coalesce(prev, '') = 'running' AND status NOT IN ('submitted', 'running')))""")
def job_illegal_transitions(spark, sf_dir):
    return jobs.illegal_transitions(_job_events(spark, sf_dir))


@query("""SELECT CAST(user_id AS VARCHAR) AS caller_id, event_type AS idempotency_key, 'job-' || arg_min(event_id, event_id) AS job_id, count(*) AS n, CASE WHEN count(DISTINCT event_id % 2) > 1 THEN 'idempotency.conflict' END AS code FROM events GROUP BY user_id, event_type""")
def idempotency_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    got = e.select(F.col("user_id").cast("string").alias("caller_id"), F.col("event_type").alias("idempotency_key"), F.col("event_id").alias("job_id"), F.col("event_id").alias("at"), (F.col("event_id") % 2).alias("fingerprint"))
    return jobs.idempotency(got).withColumn("job_id", F.concat(F.lit("job-"), F.col("job_id").cast("string")))


@query(f"""WITH {JOB}, f AS (SELECT job_id, arg_max(status, sequence) AS status, arg_max("at", sequence) AS "at" FROM job_events WHERE sequence = 1 GROUP BY job_id) SELECT job_id, "at" FROM f ORDER BY "at", job_id LIMIT 1""")
def next_job(spark, sf_dir):
    return jobs.next_job(jobs.final_states(_job_events(spark, sf_dir).where("sequence = 1"))).select("job_id", "at")


@query(f"""WITH {JOB}, f AS (SELECT job_id, {choose_sql("CAST(replace(job_id, 'job-', '') AS BIGINT)", 'single', 'batch', 'url_fetch')} AS kind, arg_max(status, sequence) AS status, arg_max("at", sequence) AS lease FROM job_events GROUP BY job_id)
SELECT job_id, kind, CASE WHEN status = 'running' AND lease < '2024-01-20' AND kind <> 'single' THEN 'submitted' WHEN status = 'running' AND lease < '2024-01-20' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND lease < '2024-01-20' AND kind = 'single' THEN 'service.restart_interrupted' END AS failure_code FROM f""")
def job_reconcile(spark, sf_dir):
    f = jobs.final_states(_job_events(spark, sf_dir))
    n = F.replace("job_id", F.lit("job-"), F.lit("")).cast("bigint")
    return jobs.reconcile(f.select("job_id", choose(n, "single", "batch", "url_fetch").alias("kind"), "status", F.col("at").alias("lease_deadline")), "2024-01-20")


BATCH = """r AS (SELECT user_id AS batch_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CASE WHEN user_id % 4 = 0 THEN 'completed' WHEN user_id % 4 = 1 THEN 'rejected' ELSE """ + choose_sql("event_id", "completed", "failed") + """ END AS status, event_id FROM events),
g AS (SELECT batch_id, count(*) AS n, bool_and(status = 'completed') AS ok, bool_and(status = 'rejected') AS no, bool_and(status = 'failed') AS bad FROM r GROUP BY batch_id)"""


@query(f"""WITH {BATCH} SELECT batch_id, CASE WHEN batch_id % 7 = 0 THEN 'partial' WHEN batch_id % 11 = 0 THEN 'invalid' WHEN ok THEN 'completed' WHEN no THEN 'rejected' WHEN bad THEN 'failed' ELSE 'partial' END AS status,
CASE WHEN batch_id % 7 = 0 THEN 'cancelled' WHEN batch_id % 11 = 0 THEN 'site_batch.site_results_missing' WHEN ok THEN 'source_exhausted' WHEN no THEN 'rejected' WHEN bad THEN 'failed' ELSE 'partial' END AS stop_reason FROM g""")
def batch_completion(spark, sf_dir):
    """Users stand for batches and their events for sites; every seventh batch was cancelled at its last site, every eleventh lacks one."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    r = e.select(
        F.col("user_id").alias("batch_id"), (F.row_number().over(w.orderBy("event_id")) - 1).alias("pos"), F.count("*").over(w).alias("_n"),
        F.when(F.col("user_id") % 4 == 0, "completed").when(F.col("user_id") % 4 == 1, "rejected").otherwise(choose(F.col("event_id"), "completed", "failed")).alias("status"), F.lit(True).alias("file_found"),
    ).withColumn("cancelled", (F.col("batch_id") % 7 == 0) & (F.col("pos") == F.col("_n") - 1))
    expected = e.groupBy(F.col("user_id").alias("batch_id")).agg((F.count("*") + F.when(F.col("batch_id") % 11 == 0, 1).otherwise(0)).alias("n_sites"))
    return jobs.batch_completion(r, expected)


@query("SELECT CAST(conv_id AS VARCHAR) AS batch_id FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 0) GROUP BY conv_id HAVING max(turn) <> count(DISTINCT turn) - 1")
def checkpoint_gaps(spark, sf_dir):
    """Conversations stand for batches, turns for checkpoints; every third lost its first."""
    c = table(spark, sf_dir, "conversations").where("not (conv_id % 3 = 0 and turn = 0)")
    return jobs.checkpoint_gaps(c.select(F.col("conv_id").cast("string").alias("batch_id"), F.col("turn").alias("ordinal")))


COMMANDS = """c AS (SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS ord, event_id * 60 AS at_,
 CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'claim' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'cancel' ELSE 'none' END ELSE CASE WHEN event_id % 4 = 0 THEN 'finish' ELSE 'none' END END AS op, event_id % 3 AS token FROM events),
f(job_id, ord, status, token, lease, cancelled, applied, stale) AS (
 SELECT DISTINCT job_id, CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM c
 UNION ALL
 SELECT job_id, ord, CASE WHEN su THEN 'submitted' WHEN cl THEN 'running' WHEN mi AND cancelled THEN 'failed' WHEN mi THEN 'completed' ELSE status END, CASE WHEN cl THEN token + 1 ELSE token END, CASE WHEN cl THEN at_ + 3600 ELSE lease END, cancelled OR ca,
  applied + CASE WHEN su OR cl OR mi OR ca THEN 1 ELSE 0 END, stale + CASE WHEN st THEN 1 ELSE 0 END
 FROM (SELECT f.job_id, c.ord, f.status, f.token, f.lease, f.cancelled, f.applied, f.stale, c.at_, op = 'submit' AND f.status IS NULL AS su,
   coalesce(op = 'claim' AND (f.status = 'submitted' OR (f.status = 'running' AND f.lease < c.at_)), false) AS cl, coalesce(op = 'finish' AND f.status = 'running' AND c.token = f.token, false) AS mi,
   coalesce(op = 'finish' AND f.status = 'running' AND c.token <> f.token, false) AS st, coalesce(op = 'cancel' AND f.status IN ('submitted', 'running') AND NOT f.cancelled, false) AS ca
  FROM f JOIN c ON c.job_id = f.job_id AND c.ord = f.ord + 1))"""


def _commands(spark, sf_dir):
    from pyspark.sql import Window

    n, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind == "signup", "submit").when(kind == "purchase", "claim").when(kind == "error", F.when(n % 3 == 0, "cancel").otherwise("none")).otherwise(F.when(n % 4 == 0, "finish").otherwise("none"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("ord"), op.alias("op"), (n * 60).alias("at"), (n % 3).alias("token"))


CLAIMED = f"WITH RECURSIVE {COMMANDS} SELECT job_id, arg_max(coalesce(status, ''), ord) AS status, arg_max(token, ord) AS token, arg_max(cancelled, ord) AS cancelled, arg_max(applied, ord) AS n_applied, arg_max(stale, ord) AS n_stale FROM f GROUP BY job_id"


@query(CLAIMED)
def job_claims(spark, sf_dir):
    """Users stand for jobs, their events for commands: claims under leases and fencing tokens, cancels, stale finishes."""
    return jobs.claims(_commands(spark, sf_dir)).drop("lease").withColumn("status", F.coalesce("status", F.lit("")))


@query(CLAIMED)
def stream_job_claims(spark, sf_dir):
    return feeds.run_claims(spark, _commands(spark, sf_dir)).withColumn("status", F.coalesce("status", F.lit("")))


# ---- results


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unresolved' ELSE (CASE WHEN event_id % 3 > 1 THEN 'html_navigation' WHEN event_id % 2 > 0 THEN 'redirect' ELSE 'direct' END) || '_' || (CASE WHEN event_id % 7 < 4 THEN 'html' ELSE 'file' END) END AS kind FROM events")
def url_resolution(spark, sf_dir):
    n = F.col("event_id")
    kind = F.when(n % 5 == 0, None).when(n % 7 < 4, "html").otherwise("file")
    return table(spark, sf_dir, "events").select("event_id", results.resolution_kind(kind, n % 3, n % 2).alias("kind"))


LAST = f"""{ATTEMPTS}, called AS (SELECT run_id || '/' || (ord // 6) AS run_id, run_id AS run, ord, tool_id, outcome, code FROM attempts WHERE outcome <> 'skipped'), l AS (SELECT run_id, any_value(run) AS run, count(*) AS n, arg_max(tool_id, ord) AS tool_id, CASE WHEN arg_max(outcome, ord) = 'failed' THEN arg_max(coalesce(code, ''), ord) ELSE '' END AS code FROM called GROUP BY run_id),
p AS (SELECT *, run % 2 = 0 AND code = '' AS fetched, CASE tool_id WHEN 'acquisition.web_http' THEN 'HTTP' WHEN 'acquisition.playwright' THEN 'BROWSER' ELSE 'CLOAK' END AS method FROM l),
q AS (SELECT *, CASE WHEN fetched THEN 'HTTP_OK' WHEN code = 'acquisition.cloudflare_blocked' THEN 'CLOUDFLARE_BLOCKED' WHEN code = 'acquisition.auth_required' THEN 'AUTH_REQUIRED' ELSE 'METHODS_EXHAUSTED' END AS reason FROM p)"""


@query(f"""WITH {LAST} SELECT run_id, CASE WHEN fetched THEN 'FETCHED' ELSE 'UNRESOLVED' END AS outcome, reason, method, n > 1 AS switched,
concat_ws(',', CASE WHEN NOT fetched AND method = 'HTTP' AND reason = 'CLOUDFLARE_BLOCKED' THEN 'retrieve-browser' END, CASE WHEN NOT fetched AND reason <> 'AUTH_REQUIRED' THEN 'discover_official_alternates,retrieve-alternate' END) AS actions FROM q""")
def retrieval_projection(spark, sf_dir):
    """Each six attempts of a run as a retrieval; even runs keep what they fetch."""
    l = ledger.last_called(attempts(spark, sf_dir).withColumn("run_id", F.concat_ws("/", "run_id", F.floor(F.col("ord") / 6))))
    ok = (F.split("run_id", "/")[0].cast("bigint") % 2 == 0) & F.col("code").isNull()
    got = l.select("run_id", "tool_id", "code", "n_called", F.when(ok, 1).otherwise(0).alias("n_artifacts"), F.lit(1).alias("n_jobs"), F.lit(False).alias("file_source"), F.lit(True).alias("browser_eligible"))
    return results.retrieval(got).withColumn("actions", F.array_join("actions", ","))


@query(f"""{A}, c AS (SELECT run_id || '/' || (ord // 12) AS retrieval, any_value(run_id) AS run, min(ord) FILTER (WHERE code = 'runner.crash') AS b, min(ord) FILTER (WHERE code = 'scope.origin_not_allowed') AS s FROM attempts WHERE code IS NOT NULL GROUP BY retrieval)
SELECT retrieval, CASE WHEN b IS NOT NULL THEN 'runner.crash' WHEN s IS NOT NULL AND run % 2 = 1 THEN 'scope.origin_not_allowed' END AS code FROM c""")
def retrieval_error(spark, sf_dir):
    """Each twelve attempts of a run as a retrieval; even runs fetched something."""
    a = attempts(spark, sf_dir).where("code is not null").withColumn("retrieval", F.concat_ws("/", "run_id", F.floor(F.col("ord") / 12)))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"])
    return a.groupBy("retrieval").agg(codes.alias("codes"), F.first("run_id").alias("run")).select("retrieval", results.retrieval_error(F.col("codes"), F.col("run") % 2 == 0).alias("code"))


@query(f"""WITH {BODIES} SELECT doc_id, 'handoff-' || sha256('{{"mime":"' || mime || '","observed_at":"' || observed_at || '","role":"source","run_id":"' || run_id || '","source_url":"' || source_url || '"}}') AS handoff_id FROM bodies""")
def handoff_ids(spark, sf_dir):
    return results.handoff(bodies(spark, sf_dir), "run_id", "source_url", "observed_at", "mime", "role").select("doc_id", "handoff_id")


@query(f"""WITH {DERIVED}, a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS k FROM (SELECT run_id, ord, outcome FROM {{attempts}} WHERE outcome <> 'skipped'))
SELECT 'attempts_contiguous' AS "constraint", (SELECT count(DISTINCT run_id) FROM a WHERE k <> ord) AS violations UNION ALL SELECT 'lineage_dangling', (SELECT count(*) FROM edges WHERE source_observation_id NOT IN (SELECT observation_id FROM observed WHERE size_bytes <= 1000))
UNION ALL SELECT 'urls_observed_once', (SELECT count(*) FROM (SELECT source_url FROM observed GROUP BY source_url HAVING count(*) > 1)) UNION ALL SELECT 'blob_paths_portable', (SELECT count(DISTINCT sha256) FROM observed WHERE size_bytes > 500)
UNION ALL SELECT 'times_valid', (SELECT count(*) FROM observed WHERE mime <> 'text/html')""".replace("{attempts}", f"(WITH {ATTEMPTS} SELECT * FROM attempts)"))
def invariants(spark, sf_dir):
    """Integrity constraints over tables that lost rows or hold other spellings; each counts what breaks it."""
    from spindrift.functions import identity

    o = _observed(spark, sf_dir)
    path = F.when(F.col("size_bytes") > 500, F.replace("relative_path", F.lit("/"), F.lit("\\"))).otherwise(F.col("relative_path"))
    time = F.when(F.col("mime") != "text/html", F.replace("observed_at", F.lit("Z"), F.lit("+00:00"))).otherwise(F.col("observed_at"))
    return results.violations(
        attempts_contiguous=ledger.not_contiguous(attempts(spark, sf_dir).where("outcome <> 'skipped'")),
        lineage_dangling=store.dangling(_edges(spark, sf_dir), o.where("size_bytes <= 1000").select("observation_id", "artifact_id")),
        urls_observed_once=o.groupBy("source_url").agg(F.count("*").alias("n")).where("n > 1"),
        blob_paths_portable=store.blobs(o).where(~identity.portable_path(path)),
        times_valid=o.where(~identity.utc_valid(time)),
    )


# ---- streams and the fetch-log source


@query(f"WITH {OBSERVED} SELECT artifact_id, count(*) AS n FROM (SELECT DISTINCT artifact_id, source_url FROM observed) GROUP BY artifact_id")
def stream_observation_dedup(spark, sf_dir):
    """Distinct (artifact, URL) pairs of documents read as a stream."""
    return feeds.dedup_artifacts(spark, f"{sf_dir}/documents.parquet").groupBy("artifact_id").agg(F.count("*").alias("n"))


@query(f"""WITH {JOB} SELECT job_id, status, n_events FROM (SELECT job_id, arg_max(status, sequence) AS status, count(*) AS n_events FROM job_events WHERE NOT (sequence > 1 AND CAST(replace(job_id, 'job-', '') AS BIGINT) % 13 = 0) GROUP BY job_id)""")
def stream_job_states(spark, sf_dir):
    """Job events run through the state machine as a stream; illegal events are dropped."""
    return feeds.run_jobs(spark, _job_events(spark, sf_dir))


@query("SELECT CAST(strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_change_feed(spark, sf_dir):
    return feeds.daily(spark, f"{sf_dir}/events.parquet")


@query("SELECT count(*) AS n_responses, count(*) FILTER (WHERE page_id % 4 = 0) AS n_redirects, CAST(sum(octet_length(encode(html))) AS BIGINT) AS n_bytes FROM pages")
def fetch_log(spark, sf_dir):
    """A fetch log written as JSON lines and read through the fetch-log data source."""
    log = fetchlog.write_sample(spark, table(spark, sf_dir, "pages"))
    return log.agg(F.count("*").alias("n_responses"), F.count_if(F.col("status") == 301).alias("n_redirects"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))
