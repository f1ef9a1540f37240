"""Queries over evidence: exploded results, stored chains, redirect authority, skill proofs, governed exploration.

Inputs come from what the tables hold; the SQL states each rule again over the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import identity, safety, urls
from spindrift.operators import constraints, evidence, flows, jobs, ledger, policy, records, robots, store, tools
from spindrift.plans.audit import EXPLORED
from spindrift.plans.inputs import ATTEMPTS, OBSERVED, attempts, table
from spindrift.plans.runs import ELIGIBLE, JOB, SNAPSHOTS, TOOLS, _diff, _edges, _job_events, _observed, _requirements, _snapshots, _tools
from spindrift.plans.web import CANON, accepted, robots_files
from spindrift.streaming import feeds

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


# ---- functions over whole columns


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_''-]*[\\p{L}\\p{N}_][\\p{L}\\p{N}\\p{M}_''-]*')) AS BIGINT) AS words FROM documents")
def visible_word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", safety.visible_words(F.col("text")).alias("words"))


@query("SELECT doc_id, coalesce(regexp_full_match(lang || '/' || source || CASE WHEN n_chars % 2 = 0 THEN ';q' ELSE '' END, '[a-z0-9][a-z0-9!#$%&''*+.^_`|~-]*/[a-z0-9][a-z0-9!#$%&''*+.^_`|~-]*'), false) AS valid FROM documents")
def mime_forms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    mime = F.concat("lang", F.lit("/"), "source", F.when(F.col("n_chars") % 2 == 0, ";q").otherwise(""))
    return d.select("doc_id", identity.mime_valid(mime).alias("valid"))


IPS = "ip AS (SELECT event_id, event_type, event_id % 230 AS a, user_id % 256 AS b, (event_id * 7) % 256 AS c, user_id % 200 AS d FROM events)"


@query(f"""WITH {IPS} SELECT event_id, CASE WHEN event_type = 'error' THEN 'gateway.peer_mismatch' WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) THEN 'gateway.peer_not_public' END AS code FROM ip""")
def peer_check(spark, sf_dir):
    """The peer of each event among its resolved addresses; errors were answered by another."""
    e = events(spark, sf_dir)
    ip = F.concat_ws(".", *[x.cast("string") for x in (F.col("event_id") % 230, F.col("user_id") % 256, F.col("event_id") * 7 % 256, F.col("user_id") % 200)])
    peer = F.when(F.col("event_type") == "error", "8.8.4.4").otherwise(ip)
    return e.select("event_id", policy.peer_code(peer, F.array(ip, F.lit("1.1.1.1")), evidence.public_ip(peer)).alias("code"))


@query(f"""WITH {IPS}, r AS (SELECT user_id, event_type, bool_or(a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113)) FILTER (WHERE NOT event_type = 'view') AS bad, count(*) FILTER (WHERE NOT event_type = 'view') AS n FROM (SELECT ip.*, user_id FROM ip JOIN events USING (event_id)) GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN n = 0 THEN 'gateway.dns_failed' WHEN bad THEN 'gateway.dns_not_public' END AS code FROM r""")
def resolved_names(spark, sf_dir):
    """A user's events of a kind as the addresses that a name resolves to; views resolve to none."""
    e = events(spark, sf_dir)
    ip = F.concat_ws(".", *[x.cast("string") for x in (F.col("event_id") % 230, F.col("user_id") % 256, F.col("event_id") * 7 % 256, F.col("user_id") % 200)])
    kept = F.when(F.col("event_type") != "view", ip)
    g = e.withColumns({"ip": kept, "public": evidence.public_ip(kept)}).groupBy("user_id", "event_type").agg(F.collect_list("ip").alias("ips"), F.collect_list(F.when(F.col("ip").isNotNull(), F.col("public"))).alias("publics"))
    return g.select("user_id", "event_type", evidence.resolution_code(F.col("ips"), F.col("publics")).alias("code"))


@query("SELECT doc_id, CASE WHEN lang = 'de' OR source LIKE '%1' THEN 'result.sensitive_data' WHEN n_chars % 5 = 0 THEN 'result.absolute_path' END AS code FROM documents")
def payload_safety(spark, sf_dir):
    """A nested payload a document: secret keys in an encoded spelling for one language and for sources ending in 1, local paths by length."""
    c = F.col
    key = F.when((c("lang") == "de") | c("source").endswith("1"), "pass%77ord").otherwise("note")
    value = F.when(c("n_chars") % 5 == 0, "/home/me/x").otherwise("plain")
    body = F.to_json(F.struct(c("doc_id").alias("id"), F.array(F.struct(F.create_map(key, value).alias("more"))).alias("list")))
    return table(spark, sf_dir, "documents").select("doc_id", safety.unsafe_payload(body).alias("code"))


@query("SELECT event_id, CASE WHEN value IS NULL OR value < 0 THEN 'budget.invalid_amount' WHEN value > 50 THEN 'budget.exceeded' ELSE 'policy.allowed' END AS code, user_id > 0 AND event_id > 0 AND value > 0 AS valid FROM events")
def budget_decisions(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "value", F.col("user_id").alias("max_requests"), F.col("event_id").alias("max_bytes"), F.lit(1).alias("max_runtime_seconds"), F.col("value").alias("max_tool_attempts_per_target"))
    return e.select("event_id", policy.decide_budget(F.col("value"), F.lit(50)).alias("code"), policy.budgets_valid().alias("valid"))


# ---- exploded results

def _results(spark, sf_dir):
    """Runs as nested results: attempts in order, an artifact and an edge for each success, a redirect for each attempt after a failure."""
    a = attempts(spark, sf_dir)
    ok = F.col("outcome") == "succeeded"
    edge = F.struct(F.concat(F.lit("lineage-"), "attempt_id").alias("lineage_id"), F.lit("derived_from").alias("relation"))
    art = F.struct(F.concat(F.lit("artifact-"), "url").alias("artifact_id"), F.lit("source").alias("role"), F.array(edge).alias("lineage"))
    listed = lambda when, x: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", x.alias("x"))))), lambda y: y["x"])
    return a.groupBy("run_id").agg(
        listed(F.lit(True), F.struct("attempt_id", "tool_id", "outcome")).alias("attempts"), listed(ok, art).alias("artifacts"),
        listed(F.col("outcome") == "failed", F.struct(F.lit("target").alias("kind"), F.col("url").alias("source_url"), F.col("tool_id").alias("target_url"), F.lit(301).alias("status_code"))).alias("redirects"),
        F.concat(F.lit("caller-"), (F.first("run_id") % 3).cast("string")).alias("caller_id"),
    )


@query(f"WITH {ATTEMPTS} SELECT run_id, ord, attempt_id, tool_id, outcome FROM attempts")
def result_attempts(spark, sf_dir):
    return evidence.attempt_rows(_results(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT run_id, 'artifact-' || url AS artifact_id, 'source' AS role FROM attempts WHERE outcome = 'succeeded'")
def result_artifacts(spark, sf_dir):
    return evidence.artifact_rows(_results(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT run_id, 'lineage-' || attempt_id AS lineage_id, 'derived_from' AS relation FROM attempts WHERE outcome = 'succeeded'")
def result_lineage(spark, sf_dir):
    return evidence.lineage_rows(_results(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS ordinal, 'target' AS kind, url AS source_url, tool_id AS target_url, 301 AS status_code FROM attempts WHERE outcome = 'failed'")
def result_redirects(spark, sf_dir):
    return evidence.redirect_rows(_results(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT DISTINCT 'caller-' || (run_id % 3) AS caller_id, 'artifact-' || url AS artifact_id FROM attempts WHERE outcome = 'succeeded'")
def artifact_grants(spark, sf_dir):
    return evidence.grants(_results(spark, sf_dir))


# ---- stored evidence


@query(f"""WITH {OBSERVED} SELECT doc_id, CASE WHEN size_bytes <> n THEN 'blob.size_mismatch' WHEN length(source_url) % 3 = 0 AND mime = 'text/html' THEN 'lineage.forbidden' WHEN n < 300 AND mime <> 'text/html' THEN 'lineage.required' WHEN mime <> 'text/html' THEN 'observation.id_invalid' WHEN n % 7 = 0 THEN 'observation.source_invalid' END AS code
FROM (SELECT observed.*, d.n_chars AS n FROM observed JOIN documents d USING (doc_id))""")
def proposal_check(spark, sf_dir):
    """Bodies proposed with their length in characters for that in bytes; the parents and locators depend on the rows."""
    c = F.col
    o = _observed(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    html = c("mime") == "text/html"
    p = o.select(
        "doc_id", c("body").alias("content"), "sha256", c("n_chars").alias("size_bytes"), c("mime").alias("mime_type"), F.when(html, "source").otherwise("derived").alias("role"),
        F.when(html & (F.length("source_url") % 3 == 0), "observation-x").when(~html & (c("n_chars") >= 300), "observation-x").alias("derived_from"),
        F.when(c("n_chars") % 7 == 0, F.concat("source_url", F.lit("\t"))).otherwise(c("source_url")).alias("source_url"), "observed_at",
    )
    return p.select("doc_id", evidence.proposal_code().alias("code"))


DERIVED_EDGES = OBSERVED + """, made AS (SELECT *, '# ' || doc_id AS derived FROM observed WHERE mime = 'text/html'),
edges AS (SELECT doc_id, observation_id AS so, artifact_id AS sa, 'artifact-' || sha256('{"blob_sha256":"' || sha256(derived) || '","mime_type":"text/markdown","role":"derived"}') AS a,
 'observation-' || substr(sha256(run_id || chr(10) || 'urn:spindrift:transform:transform.simple:1.0.0' || chr(10) || observation_id), 1, 32) AS o FROM made)"""


@query(f"WITH {DERIVED_EDGES} SELECT o AS observation_id, CASE WHEN substr(o, 13, 1) = '0' THEN 'lineage.invalid' WHEN substr(o, 13, 1) = '1' THEN 'lineage.self_reference' WHEN substr(o, 13, 1) = '2' THEN 'lineage.invalid' END AS code FROM edges")
def lineage_check(spark, sf_dir):
    """Edges of derived texts; by the first digit of their id another relation, themselves as source, or an id of other facts."""
    e = _edges(spark, sf_dir)
    digit = F.substring("observation_id", 13, 1)
    e = e.select("observation_id", "artifact_id", F.when(digit == "0", "copied_from").otherwise("derived_from").alias("relation"), F.when(digit == "1", F.col("observation_id")).otherwise(F.col("source_observation_id")).alias("source_observation_id"), F.when(digit == "2", F.col("artifact_id")).otherwise(F.col("source_artifact_id")).alias("source_artifact_id"), "lineage_id")
    return e.select("observation_id", evidence.lineage_code().alias("code"))


@query(f"""WITH {OBSERVED} SELECT doc_id, CASE WHEN substr(sha256, 1, 1) = 'a' THEN 'blob.sha256_mismatch' WHEN substr(sha256, 1, 1) = 'b' THEN 'blob.path_invalid' WHEN mime <> 'text/html' THEN 'artifact.invalid' WHEN substr(sha256, 1, 1) = 'c' THEN 'observation.invalid' END AS code FROM observed""")
def chain_check(spark, sf_dir):
    """Stored observations re-verified link by link: by the first digit of the digest other bytes, another path or another artifact, and types other than stored."""
    c = F.col
    digit = F.substring("sha256", 1, 1)
    o = _observed(spark, sf_dir).select(
        "doc_id", F.when(digit == "a", F.concat("body", F.lit("!"))).otherwise(c("body")).alias("content"), "sha256", (c("size_bytes") + F.when(digit == "a", 1).otherwise(0)).alias("size_bytes"), F.when(digit == "b", F.concat(F.lit("blobs/"), "sha256")).otherwise(identity.blob_path(c("sha256"))).alias("relative_path"),
        "artifact_id", c("sha256").alias("blob_sha256"), F.lit("text/html").alias("mime_type"), "role", "observation_id", F.when(digit == "c", F.lit("artifact-0")).otherwise(c("artifact_id")).alias("observed_artifact_id"), "source_url", "observed_at",
        F.lit(None).cast("array<struct<lineage_id:string,observation_id:string,artifact_id:string,relation:string,source_observation_id:string,source_artifact_id:string>>").alias("lineage"),
    )
    return o.select("doc_id", evidence.chain_code().alias("code"))


@query(f"""WITH {DERIVED_EDGES}, held AS (SELECT DISTINCT run_id, observation_id, artifact_id, mime FROM observed WHERE source_url NOT LIKE '%7') SELECT e.o AS observation_id, CASE WHEN h.mime IS NULL THEN 'lineage.dangling' ELSE 'lineage.source_role_invalid' END AS code
FROM (SELECT edges.*, observed.run_id FROM edges JOIN observed USING (doc_id)) e LEFT JOIN held h ON h.run_id = e.run_id AND h.observation_id = e.so AND h.artifact_id = e.sa WHERE h.mime IS NULL OR substr(e.so, 13, 1) = 'f'""")
def lineage_sources(spark, sf_dir):
    """Edges whose source is missing from its run (URLs ending in 7), or is no source there (ids that begin with f)."""
    o = _observed(spark, sf_dir)
    role = F.when(F.substring("observation_id", 13, 1) == "f", "derived").otherwise("source")
    held = o.where("source_url not like '%7'").select("run_id", "observation_id", "artifact_id", role.alias("role"))
    e = _edges(spark, sf_dir).join(o.select("run_id", F.col("observation_id").alias("source_observation_id")), "source_observation_id")
    return evidence.collection_lineage(held, e).select("observation_id", "code")


@query(f"WITH {OBSERVED} SELECT observation_id, CASE WHEN mime <> 'text/html' THEN 'artifact.missing' ELSE 'blob.missing' END AS code FROM observed WHERE mime <> 'text/html' OR size_bytes > 2000")
def observation_unreadable(spark, sf_dir):
    """Observations that a read fails on, where only HTML artifacts and blobs of up to 2,000 bytes are held."""
    o = _observed(spark, sf_dir)
    return evidence.unreadable(store.observations(o), store.artifacts(o.where("mime = 'text/html'")), store.blobs(o.where("size_bytes <= 2000")))


@query(f"WITH {OBSERVED} SELECT observation_id, 'handoff.artifact_mismatch' AS code FROM observed WHERE size_bytes <> length(body) OR mime <> 'text/html'")
def handoff_reconciled(spark, sf_dir):
    """Handed-off facts against the store: lengths given in characters, and only HTML stored."""
    o = _observed(spark, sf_dir)
    facts = lambda size: [F.col("observation_id"), F.col("artifact_id"), F.col("source_url"), F.col("observed_at"), F.col("mime").alias("mime_type"), size.cast("bigint").alias("size_bytes"), F.col("sha256")]
    return evidence.reconciled(o.select(*facts(F.length("body"))), o.where("mime = 'text/html'").select(*facts(F.col("size_bytes"))))


@query(f"WITH {OBSERVED} SELECT observation_id FROM observed WHERE run_id = 'run-1' AND size_bytes > 1000")
def observation_reuse(spark, sf_dir):
    """Observations of a second snapshot that claims the large ones of the first as its own."""
    o = _observed(spark, sf_dir)
    previous = o.where("run_id = 'run-1'")
    return constraints.reused(previous, o.where("run_id = 'run-2' or (run_id = 'run-1' and size_bytes > 1000)"))


@query(f"WITH {SNAPSHOTS.format(rest='missing')}, q AS (SELECT url, CASE WHEN substr(d, 8, 1) = '0' THEN 'sha256:0' ELSE d END AS d FROM c WHERE substr(d, 8, 1) <> '1') SELECT coalesce(x.url, q.url) AS canonical_url FROM (SELECT url, current_digest AS d FROM diff WHERE current_digest IS NOT NULL) x FULL OUTER JOIN q ON q.url = x.url WHERE x.d IS DISTINCT FROM q.d")
def change_evidence(spark, sf_dir):
    """Changes against a state that lost some pages and holds others with another digest, by their digests' first digit."""
    _, cur, _ = _snapshots(spark, sf_dir)
    digit = F.substring("content_digest", 8, 1)
    held = cur.where(digit != "1").withColumn("content_digest", F.when(digit == "0", "sha256:0").otherwise(F.col("content_digest")))
    return constraints.unmatched_changes(_diff(spark, sf_dir, True), held)


@query(f"WITH {JOB} SELECT job_id FROM (SELECT job_id, arg_max(status, sequence) AS final, max(CASE WHEN sequence = 2 THEN status END) AS kept FROM job_events GROUP BY job_id) WHERE final IS DISTINCT FROM kept")
def job_snapshots(spark, sf_dir):
    """Jobs whose row was written at their second event and not since."""
    e = _job_events(spark, sf_dir)
    return constraints.snapshot_mismatch(e.where("sequence = 2").select("job_id", "status"), jobs.final_states(e))


@query("""WITH k AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), h AS (SELECT user_id, event_type, event_id AS job, value > 20 AS print FROM events WHERE event_id IN (SELECT first FROM k WHERE user_id % 2 = 0)),
f AS (SELECT e.user_id, e.event_type, arg_min(value > 20, event_id) AS print, min(event_id) AS job FROM events e WHERE event_id NOT IN (SELECT job FROM h) GROUP BY ALL)
SELECT e.event_id AS submission_id, CASE WHEN (value > 20) = coalesce(h.print, f.print) THEN coalesce(h.job, f.job) END AS job_id, h.job IS NULL AND e.event_id = f.job AS created, CASE WHEN (value > 20) <> coalesce(h.print, f.print) THEN 'idempotency.conflict' END AS code
FROM events e JOIN f USING (user_id, event_type) LEFT JOIN h USING (user_id, event_type) WHERE e.event_id NOT IN (SELECT job FROM h)""")
def job_submit(spark, sf_dir):
    """Events as submissions under a key of their user and kind; the first of even users is held already."""
    c = F.col
    e = events(spark, sf_dir).select(c("user_id").alias("caller_id"), c("event_type").alias("idempotency_key"), (c("value") > 20).alias("fingerprint"), c("event_id").alias("job_id"), c("event_id").alias("at"), c("event_id").alias("submission_id"))
    first = e.groupBy("caller_id", "idempotency_key").agg(F.min("job_id").alias("job_id")).where("caller_id % 2 = 0").select("job_id")
    return jobs.submit(e.join(first, "job_id", "left_semi"), e.join(first, "job_id", "left_anti"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), held AS (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING sum(length(text)) % 4 <> 0),
done AS (SELECT conv_id, count(*) AS n FROM held a WHERE a.turn = (SELECT count(*) FROM held b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) GROUP BY conv_id)
SELECT conv_id AS batch_id, turn AS pos, 's' || turn AS site_key FROM t LEFT JOIN done USING (conv_id) WHERE turn >= coalesce(n, 0)""")
def batch_resume(spark, sf_dir):
    """Conversations as batches, turns as sites; turns whose text has a length divisible by four have no checkpoint."""
    c = table(spark, sf_dir, "conversations")
    slots = c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), F.concat(F.lit("s"), "turn").alias("site_key")).distinct()
    held = c.groupBy(F.col("conv_id").alias("batch_id"), F.col("turn").alias("ordinal")).agg(F.sum(F.length("text")).alias("n")).where("n % 4 <> 0")
    return jobs.resume(slots, held)


# ---- decisions and redirects

_DECIDED = """CASE length(origin) % 6 WHEN 0 THEN CASE WHEN starts_with(path, '/en/') AND NOT starts_with(path, '/en/7') THEN 'denied' ELSE 'allowed' END WHEN 2 THEN 'denied' WHEN 3 THEN 'absent' ELSE 'unknown_allow' END"""


@query(f"WITH {CANON} SELECT page_id, CASE WHEN contains(url, '?') THEN 'robots.url_invalid' WHEN length(origin) % 6 = 5 THEN 'robots.status_invalid' WHEN {_DECIDED} = 'absent' THEN 'robots.decision_invalid' END AS code FROM ok")
def robots_evidence(spark, sf_dir):
    """Decisions written down with raw URLs, no status of a robots file as 0, and an absent one under another name."""
    c = F.col
    targets = accepted(spark, sf_dir).select("page_id", urls.origin(c("url")).alias("origin"), "url")
    d = robots.decide(targets, robots.policies(robots_files(spark, sf_dir)), "spindrift/1.0").withColumn("reason_code", c("code"))
    rows = d.select("page_id", "origin", F.concat("origin", F.lit("/robots.txt")).alias("robots_url"), c("url").alias("target_url"), F.coalesce("status", F.lit(0)).alias("status_code"), F.when(c("decision") == "absent", "none").otherwise(c("decision")).alias("decision"), "reason_code", F.lit(evidence.ROBOTS_POLICY).alias("policy_id"))
    return rows.select("page_id", evidence.robots_code().alias("code"))


@query(f"""WITH {CANON}, h AS (SELECT page_id, url, origin, path, length(html) % 6 AS k FROM ok) SELECT page_id, CASE WHEN k = 1 THEN 'gateway.redirect_missing' WHEN k = 2 AND starts_with(url, 'https') THEN 'gateway.https_downgrade' WHEN k = 2 THEN 'scope.origin_not_allowed' WHEN k = 3 THEN 'robots.redirect_origin' WHEN k = 4 THEN 'policy.allowed'
WHEN k = 5 THEN 'gateway.redirect_invalid' ELSE 'scope.path_not_included' END AS code, CASE WHEN k = 2 THEN 'http://far.example.test/' WHEN k = 3 THEN 'https://far.example.test/robots.txt' WHEN k = 4 THEN origin || '/in/x' WHEN k = 0 THEN origin || '/out/y' END AS target_url FROM h""")
def redirect_decisions(spark, sf_dir):
    """One redirect a page, by the length of its body: out of scope, without a target, to plain HTTP, of a robots file to another origin, in scope, to no URL."""
    c = F.col
    k = F.length("html") % 6
    hops = accepted(spark, sf_dir).select(
        "page_id", c("url").alias("current_url"), urls.origin(c("url")).alias("origin"), F.when(k == 3, "robots").otherwise("target").alias("kind"), F.lit(302).alias("status_code"),
        F.when(k == 0, "/out/./y").when(k == 2, "http://far.example.test").when(k == 3, "https://far.example.test/robots.txt").when(k == 4, "/in/x").when(k == 5, "ftp://x/").otherwise(" ").alias("location"),
    )
    return evidence.redirect_authority(hops, F.array("origin"), F.array(F.lit("/in/**"))).select("page_id", "code", "target_url")


@query(f"WITH {ATTEMPTS} SELECT run_id || '/' || (ord // 3) AS job, NOT coalesce(bool_or(starts_with(code, 'scope.') OR starts_with(code, 'runner.') OR code = 'acquisition.auth_required'), false) AS alternates, CASE WHEN count(*) FILTER (WHERE outcome = 'succeeded') > 0 THEN 'partial' ELSE 'failed' END AS status FROM attempts GROUP BY ALL")
def alternates_allowed(spark, sf_dir):
    """Each run's attempts in jobs of three: whether another source may be tried, and the status if an exception ends it."""
    a = attempts(spark, sf_dir).withColumn("job", F.concat_ws("/", "run_id", F.floor(F.col("ord") / 3)))
    codes = F.transform(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("ord", "code")))), lambda x: x["code"])
    g = a.groupBy("job").agg(codes.alias("codes"), F.count_if(F.col("outcome") == "succeeded").alias("n"))
    return g.select("job", evidence.may_use_alternates(F.col("codes")).alias("alternates"), evidence.failure_projection(F.lit("failed"), F.col("n"), F.lit(False)).alias("status"))


# ---- refreshes and batches


@query(f"WITH {ATTEMPTS}, g AS (SELECT run_id, ord // 5 AS part, bool_or(code = 'gateway.timeout') AS cancelled, sum(requests) > 4 AS spent, bool_or(code = 'scope.origin_not_allowed') AS no, bool_and(outcome <> 'failed') AS ok FROM attempts GROUP BY ALL), s AS (SELECT *, CASE WHEN coalesce(cancelled, false) THEN 'cancelled' WHEN spent THEN 'budget_exhausted' WHEN coalesce(no, false) THEN 'rejected' WHEN ok THEN 'source_exhausted' ELSE 'acquisition_failed' END AS stop FROM g) SELECT run_id || '/' || part AS refresh, stop = 'source_exhausted' AS complete, CASE stop WHEN 'source_exhausted' THEN 'completed' WHEN 'rejected' THEN 'rejected' ELSE 'partial' END AS status, stop AS stop_reason FROM s")
def refresh_outcome(spark, sf_dir):
    """Five attempts a refresh: timeouts stand for cancels, more than four requests exhaust the budget."""
    a = attempts(spark, sf_dir).withColumn("refresh", F.concat_ws("/", "run_id", F.floor(F.col("ord") / 5)))
    has = lambda when: F.coalesce(F.bool_or(when), F.lit(False))
    g = a.groupBy("refresh").agg(has(F.col("code") == "gateway.timeout").alias("cancelled"), (F.sum("requests") > 4).alias("spent"), has(F.col("code") == "scope.origin_not_allowed").alias("no"), F.bool_and(F.col("outcome") != "failed").alias("ok"))
    codes = F.array_compact(F.array(F.when(F.col("cancelled"), "runtime.cancelled"), F.when(F.col("spent"), "budget.exhausted")))
    return g.withColumn("o", evidence.refresh_assembly(F.col("ok"), codes, F.col("no"))).select("refresh", "o.complete", "o.status", "o.stop_reason")


@query(f"""WITH {SNAPSHOTS.format(rest='missing')}, t AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS run_id, change_type, url, length(url) AS l FROM diff),
o AS (SELECT run_id, change_type, string_agg(url, ' ' ORDER BY l, url) <> string_agg(url, ' ' ORDER BY url) AS bad FROM t GROUP BY ALL) SELECT run_id, 'site_refresh.change_order_invalid' AS code FROM o GROUP BY run_id HAVING bool_or(bad)""")
def refresh_collections(spark, sf_dir):
    """Changes of a site listed by the length of their URLs, which is mostly not their order."""
    from pyspark.sql import Window

    d = _diff(spark, sf_dir, True).select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("run_id"), F.col("change_type").alias("collection"), "url", "change_type")
    pos = F.row_number().over(Window.partitionBy("run_id", "collection").orderBy(F.length("url"), "url"))
    return evidence.collection_code(d.withColumn("pos", pos))


@query("""WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, value FROM events)
SELECT event_id, CASE WHEN prev IS DISTINCT FROM event_type THEN 'site_refresh.state_mismatch' WHEN event_type = 'purchase' AND value <= 20 THEN 'site_refresh.skill_update_invalid' WHEN event_type <> 'purchase' AND value > 50 THEN 'site_refresh.state_mismatch' END AS code FROM e""")
def refresh_skill_state(spark, sf_dir):
    """A refresh an event: its kind is the skill's digest, the kind before is the last state's; purchases update the skill, of the site's own only above 20; above 50 the new state names another skill."""
    from pyspark.sql import Window

    c = F.col
    e = events(spark, sf_dir).withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    updated = c("event_type") == "purchase"
    r = e.select(
        "event_id", c("user_id").alias("previous_site"), c("user_id").alias("current_site"), c("prev").alias("previous_digest"), F.when(updated, F.lit("new")).when(c("value") > 50, "other").otherwise(c("event_type")).alias("current_digest"), c("event_type").alias("used_digest"),
        F.when(updated, c("event_type")).alias("update_previous"), F.when(updated, "new").alias("update_digest"), F.when(c("value") > 20, c("user_id")).otherwise(-1).alias("update_site"), F.lit(True).alias("complete"),
    )
    return r.select("event_id", evidence.refresh_state_code().alias("code"))


@query(f"""WITH {OBSERVED}, s AS (SELECT *, regexp_extract(source_url, '^https?://([^/?#]*)', 1) AS site_key FROM observed), last AS (SELECT source_url, arg_max(observation_id, observed_at) AS o FROM observed GROUP BY source_url)
SELECT DISTINCT site_key FROM s JOIN last ON last.o = s.observation_id WHERE mime <> 'text/html' AND size_bytes > 100 AND site_key NOT IN (SELECT site_key FROM s WHERE size_bytes = 0)""")
def file_goals(spark, sf_dir):
    """Sites whose state holds, as the latest observation of its URL, a file of more than 100 bytes that a candidate run acquired; sites with an empty body were rejected."""
    c = F.col
    o = _observed(spark, sf_dir).withColumn("site_key", urls.site_key(c("source_url")))
    arts = o.select("site_key", F.concat("run_id", F.when(c("size_bytes") > 100, "-candidate-1").otherwise("-seed")).alias("run_id"), "role", c("mime").alias("mime_type"), "source_url", "observation_id", "artifact_id", "sha256")
    pages = o.groupBy("site_key", c("source_url").alias("canonical_url")).agg(F.max_by(F.struct("observation_id", "artifact_id", F.concat(F.lit("sha256:"), "sha256").alias("content_digest")), "observed_at").alias("p")).select("site_key", "canonical_url", "p.*")
    return evidence.file_goal(arts, pages, o.where("size_bytes = 0"))


@query("SELECT source AS site_key, bool_and(lang IS NOT NULL AND (lang <> 'en' OR regexp_matches(coalesce(text, ''), '[^\\s]'))) AS passed FROM documents GROUP BY source")
def success_check(spark, sf_dir):
    """English documents as HTML sources, others as files, those without a language as missing."""
    d = table(spark, sf_dir, "documents")
    return evidence.success_checks(d.select(F.col("source").alias("site_key"), F.when(F.col("lang") == "en", "text/html").when(F.col("lang").isNotNull(), "application/pdf").alias("mime_type"), "text"))


# ---- tools and skills


@query(f"""WITH {ELIGIBLE} SELECT req_id, arg_min(tool_id, (CASE WHEN tool_id = 'acquisition.web_http' THEN 1 ELSE 0 END, length(tool_id))) AS tool_id, arg_min(version, (CASE WHEN tool_id = 'acquisition.web_http' THEN 1 ELSE 0 END, length(tool_id))) AS version FROM e WHERE reasons = '' GROUP BY req_id""")
def transform_choice(spark, sf_dir):
    """Of the eligible tools the installed ones first, in the order of their names' lengths, then the built-in."""
    d = tools.eligibility(_tools(spark), _requirements(spark, sf_dir))
    return evidence.preferred_transform(d.withColumns({"external": F.col("tool_id") != "acquisition.web_http", "position": F.length("tool_id")}))


@query(f"""WITH {ELIGIBLE} SELECT req_id, tool_id, eligible, reasons FROM (SELECT req_id, tool_id, reasons = '' AS eligible, reasons FROM e UNION ALL SELECT event_id, 'acquisition.lost', false, 'eligibility.disabled' FROM events)""")
def unavailable_tools(spark, sf_dir):
    """Decisions with a disabled tool beside the registered ones; a declaration of no known reason is none."""
    d = tools.eligibility(_tools(spark), _requirements(spark, sf_dir))
    declared = spark.createDataFrame([("acquisition.lost", "1.0.0", "eligibility.disabled"), ("acquisition.odd", "1.0.0", "eligibility.mood")], "tool_id string, version string, reason string")
    return evidence.with_unavailable(d, declared).select("req_id", "tool_id", "eligible", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH t AS (SELECT tool_id FROM {TOOLS}), d AS (SELECT 'acquisition.' || event_type AS tool_id, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'acquisition.web_http', 1)
SELECT tool_id, CASE WHEN n > 1 OR tool_id IN (SELECT tool_id FROM t) THEN 'registry.duplicate_id' ELSE 'eligibility.facts_invalid' END AS code FROM d WHERE n > 1 OR tool_id IN (SELECT tool_id FROM t)""")
def tool_declarations(spark, sf_dir):
    """Each event declares the tool of its kind, so ids repeat; one more is registered already."""
    e = events(spark, sf_dir).select(F.concat(F.lit("acquisition."), "event_type").alias("tool_id"), F.lit("eligibility.inactive").alias("reason"))
    one = spark.createDataFrame([("acquisition.web_http", "eligibility.inactive")], "tool_id string, reason string")
    return evidence.declaration_code(_tools(spark), e.unionByName(one))


PROOFS = f"""{ATTEMPTS}, seed AS (SELECT DISTINCT run_id AS site, tool_id FROM attempts WHERE ord < 2 AND outcome = 'succeeded'),
p AS (SELECT a.run_id AS site, a.tool_id, a.url, a.ord, ran.site IS NOT NULL AS replay FROM attempts a JOIN seed s ON s.site = a.run_id AND s.tool_id = a.tool_id
 LEFT JOIN (SELECT DISTINCT run_id AS site, url FROM attempts WHERE outcome = 'skipped') ran ON ran.site = a.run_id AND ran.url = a.url WHERE a.ord >= 2 AND a.outcome = 'succeeded'),
b AS (SELECT site, min(tool_id || ' ' || url) FILTER (WHERE replay) AS best FROM p GROUP BY site)"""


@query(f"""WITH {PROOFS}, s AS (SELECT DISTINCT run_id AS site FROM attempts) SELECT s.site AS site_key, split_part(best, ' ', 1) AS tool_id, split_part(best, ' ', 2) AS discovery_source, CASE WHEN b.site IS NULL THEN 'runtime.site_skill_tool_unverified' WHEN best IS NULL THEN 'runtime.site_skill_discovery_unverified' END AS code,
CASE WHEN best IS NOT NULL THEN 'application/pdf,text/html' END AS kinds FROM s LEFT JOIN b USING (site)""")
def skill_proofs(spark, sf_dir):
    """Runs as sites: the first two attempts are the seed's, each URL is a candidate found on itself, and the discovery of those with a skipped attempt ran."""
    c = F.col
    a = attempts(spark, sf_dir).select(c("run_id").alias("site_key"), c("attempt_id").alias("run_id"), (c("ord") < 2).alias("is_seed"), "tool_id", F.lit("1").alias("tool_version"), c("url").alias("requested_url"), c("url").alias("final_url"), "outcome")
    pages = a.select("site_key", c("requested_url").alias("url")).distinct()
    selected = pages.select("site_key", "url", c("url").alias("discovery_source"), F.lit("discovery.html_links").alias("discovery_tool"), F.lit("1").alias("discovery_version"))
    found = a.where("outcome = 'skipped'").select("site_key", F.lit("discovery.html_links").alias("tool_id"), F.lit("1").alias("tool_version"), c("requested_url").alias("source_url"), F.lit("succeeded").alias("outcome"))
    sources = a.select("site_key", "run_id", "is_seed", F.when(c("is_seed"), "text/html").otherwise("application/pdf").alias("mime_type"))
    got = evidence.skill_candidates(a, selected, found, sources)
    return got.select("site_key", "tool_id", "discovery_source", "code", F.array_join("mime_types", ",").alias("kinds"))


# ---- whole records


@query("""SELECT page_id, CASE WHEN contains(url, '#') OR k = 1 THEN 'site_state.page_invalid' WHEN k = 2 THEN 'site_state.sensitive_data' END AS code FROM (SELECT page_id, url, length(html) % 4 AS k FROM pages)""")
def state_urls(spark, sf_dir):
    """Page URLs as a state might hold them: by the length of the body with a default port, with a secret in the query, or as they are."""
    k = F.length("html") % 4
    base = F.regexp_extract("url", "^([^#]*)", 1)
    plain = F.when(k == 1, F.regexp_replace(F.regexp_replace(base, "^(https://[^/?]*)", "$1:443"), "^(http://[^/?]*)", "$1:80")).when(k == 2, F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("?api_key=1")))
    return table(spark, sf_dir, "pages").select("page_id", records.state_url_code(F.when(F.col("url").contains("#"), F.col("url")).otherwise(F.coalesce(plain, "url"))).alias("code"))


@query(f"""WITH {ATTEMPTS}, g AS (SELECT run_id || '/' || (ord // 4) AS id, sum(bytes_received) AS b, count(*) FILTER (WHERE outcome = 'failed') AS f, count(*) FILTER (WHERE outcome = 'skipped') AS s, min(ord) AS o FROM attempts GROUP BY id)
SELECT id, CASE WHEN f = 2 THEN 'attempt.order_invalid' WHEN f = 1 THEN 'result.attempts_mismatch' WHEN b > 100000 THEN 'result.usage_mismatch' WHEN s > 1 THEN 'result.site_skill_mismatch' END AS code FROM g WHERE f < 3""")
def result_manifests(spark, sf_dir):
    """Four attempts a result; the manifest of one with a failure lacks it, one with two is numbered from elsewhere, large ones have another usage, much skipped ones another skill."""
    c = F.col
    a = attempts(spark, sf_dir).withColumn("id", F.concat_ws("/", "run_id", F.floor(c("ord") / 4)))
    listed = F.array_sort(F.collect_list(F.struct("ord", "attempt_id", "outcome")))
    g = a.groupBy("id").agg(listed.alias("x"), F.sum("bytes_received").alias("b"), F.count_if(c("outcome") == "failed").alias("f"), F.count_if(c("outcome") == "skipped").alias("s")).where("f < 3")
    shift = F.when(c("f") == 2, 1).otherwise(0)
    rows = F.transform("x", lambda r, i: F.struct((i + shift).alias("ord"), r["attempt_id"].alias("attempt_id"), r["outcome"].alias("outcome")))
    g = g.withColumn("attempts", rows).withColumn("manifest_attempts", F.when(c("f") == 1, F.filter("attempts", lambda r: r["outcome"] != "failed")).otherwise(c("attempts")))
    g = g.withColumns({"usage": F.struct(c("b").alias("bytes")), "manifest_usage": F.struct(F.when(c("b") > 100_000, 0).otherwise(c("b")).cast("bigint").alias("bytes")), "skill": F.lit("s"), "manifest_skill": F.when(c("s") > 1, "t").otherwise("s")})
    return g.select("id", records.result_manifest_code().alias("code"))


@query(f"WITH {OBSERVED} SELECT doc_id, CASE WHEN size_bytes = 0 THEN 'manifest.http_status_invalid' WHEN mime = 'text/html' AND (size_bytes <> length(body) OR substr(sha256, 1, 1) IN ('0', '1')) THEN 'manifest.success_facts_invalid' WHEN mime <> 'text/html' AND substr(sha256, 1, 1) NOT IN ('0', '1') THEN 'manifest.artifact_required' END AS code FROM observed")
def manifest_facts(spark, sf_dir):
    """Manifests with lengths in characters, an empty body's status as 0, no final URL for some digests; only HTML has a source."""
    c = F.col
    o = _observed(spark, sf_dir)
    some = F.substring("sha256", 1, 1).isin("0", "1")
    html = c("mime") == "text/html"
    status = F.when(c("size_bytes") == 0, 0).when(html | ~some, 200)
    facts = F.struct(c("source_url").alias("requested_url"), F.when(~some, c("source_url")).alias("final_url"), status.alias("http_status"), F.lit("t").alias("tool_id"), F.lit("1").alias("tool_version"), F.when(html, c("mime")).alias("mime_type"), F.when(html, F.length("body")).cast("bigint").alias("size_bytes"), F.when(html, c("sha256")).alias("sha256"))
    source = F.when(html, F.struct(c("source_url"), c("mime").alias("mime_type"), c("size_bytes"), c("sha256")))
    success = F.struct(c("source_url").alias("requested_url"), c("source_url").alias("final_url"), status.alias("http_status"), F.lit("t").alias("tool_id"), F.lit("1").alias("tool_version"))
    return o.select("doc_id", facts.alias("facts"), source.alias("source"), success.alias("success")).select("doc_id", records.manifest_facts_code().alias("code"))


@query(f"""WITH {ATTEMPTS}, p AS (SELECT run_id || '/' || (ord // 3) AS fetch_id, *, max(ord) OVER (PARTITION BY run_id, ord // 3) = ord AS terminal FROM attempts),
g AS (SELECT fetch_id, sum(bytes_received) > 30000 AS much, count(code) > 1 AS many, bool_or(code = 'gateway.timeout') AS cancelled, arg_max(outcome, ord) AS last, arg_max(url, ord) AS url FROM p GROUP BY fetch_id)
SELECT fetch_id, CASE WHEN much THEN 'url_fetch.usage_mismatch' WHEN many THEN 'url_fetch.errors_mismatch' WHEN last = 'skipped' THEN 'url_fetch.terminal_artifact_invalid' WHEN last = 'succeeded' AND url LIKE '%h3.%' THEN 'url_fetch.content_type_mismatch' END AS code FROM g""")
def url_fetch_records(spark, sf_dir):
    """Three attempts a fetch: much traffic is left out of the usage, second errors are left out, skipped ends claim an artifact, one host's pages are claimed as files."""
    c = F.col
    a = attempts(spark, sf_dir).withColumn("fetch_id", F.concat_ws("/", "run_id", F.floor(c("ord") / 3)))
    errors = F.array_compact(F.array("code"))
    ends = a.groupBy("fetch_id").agg(F.max("ord").alias("_end"))
    use = [c("requests"), c("bytes_received"), c("runtime_ms"), F.when(c("outcome") != "skipped", 1).otherwise(0).alias("tool_attempts")]
    parts = a.join(ends, "fetch_id").select("fetch_id", c("ord").alias("pos"), (c("ord") == c("_end")).alias("terminal"), *use, errors.alias("errors"), F.when(c("outcome") == "succeeded", F.array("attempt_id")).otherwise(F.array().cast("array<string>")).alias("artifacts"))
    codes = F.transform(F.array_sort(F.collect_list(F.when(c("code").isNotNull(), F.struct("ord", "code")))), lambda x: x["code"])
    last = lambda x: F.max_by(x, "ord")
    g = a.groupBy("fetch_id").agg(
        *[F.sum(u).alias(n) for u, n in zip(use, records.USAGE, strict=True)], codes.alias("codes"), F.bool_or(F.coalesce(c("code") == "gateway.timeout", F.lit(False))).alias("timeout"), last("outcome").alias("last"), last("attempt_id").alias("attempt_id"), last("url").alias("url")
    )
    held = c("last") != "failed"
    cancel = F.when(c("timeout"), F.array(F.lit("runtime.cancelled"))).otherwise(F.array().cast("array<string>"))
    f = g.select(
        "fetch_id", "requests", F.when(c("bytes_received") > 30_000, 0).otherwise(c("bytes_received")).alias("bytes_received"), "runtime_ms", "tool_attempts", F.concat(F.slice("codes", 1, 1), cancel).alias("errors"), F.when(c("timeout"), "cancelled").otherwise("terminal").alias("stop_reason"),
        F.when(held, c("attempt_id")).alias("terminal_artifact"), F.lit("source").alias("terminal_role"), F.lit("text/html").alias("terminal_mime"), F.when(held, F.when(c("url").contains("h3."), "file").otherwise("html")).alias("content"),
    )
    return records.fetch_code(f, parts)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 'b' || user_id AS b FROM events), r AS (SELECT *, b || '-site-' || (pos + 1) AS root, value > 5 AS pages, event_type = 'purchase' AS updated FROM e),
c AS (SELECT b AS batch_id, pos, CASE WHEN event_type = 'signup' THEN 'site_batch.site_order_invalid' WHEN event_type = 'error' THEN 'site_batch.run_identity_mismatch' WHEN NOT pages AND value > 4 THEN 'site_batch.mode_mismatch' WHEN value > 90 THEN 'site_batch.file_discovery_status_mismatch' WHEN pages AND value < 10 THEN 'site_batch.usable_sites_mismatch' WHEN pages AND value > 60 THEN 'site_batch.next_context_mismatch' END AS code FROM r)
SELECT batch_id, pos, code FROM c WHERE code IS NOT NULL""")
def batch_records(spark, sf_dir):
    """Users as batches, events as their sites; the kind and value of an event decide what its record says wrongly."""
    from pyspark.sql import Window

    c = F.col
    v, kind = c("value"), c("event_type")
    e = events(spark, sf_dir).withColumns({"batch_id": F.concat(F.lit("b"), "user_id"), "pos": (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")})
    root = policy.child_run_id(c("batch_id"), c("pos") + 1)
    pages, updated = v > 5, kind == "purchase"
    mode = F.when(~pages, F.when(v > 4, "replayed").otherwise("failed")).when(updated, "recovered").otherwise("replayed")
    sites = e.select(
        "batch_id", "pos", F.when(kind == "signup", "other").otherwise(F.concat(F.lit("s"), "pos")).alias("site_key"), F.lit(False).alias("first_phase"), F.array(F.concat(root, F.when(kind == "error", "-seed").otherwise("-source"))).alias("run_ids"), F.array(F.concat(root, F.lit("-attempt-1"))).alias("attempt_ids"),
        pages.alias("has_pages"), updated.alias("updated"), F.lit(False).alias("has_candidate"), F.lit("source_exhausted").alias("stop_reason"), mode.alias("mode"), (v >= 10).alias("usable"), (pages & (v <= 60)).alias("continued"), F.when(v > 90, "satisfied").otherwise("not_requested").alias("file_status"), F.lit(False).alias("file_found"),
    )
    return records.batch_code(e.select("batch_id", "pos", F.concat(F.lit("s"), "pos").alias("site_key")), sites)


@query(f"""WITH {CANON}, k AS (SELECT page_id, url, site_key, origin, path, length(html) % 9 AS k, sha256(html) AS h FROM ok) SELECT page_id, CASE k WHEN 1 THEN 'site_skill.site_key_invalid' WHEN 2 THEN 'site_skill.previous_required' WHEN 3 THEN 'site_skill.discovery_invalid' WHEN 4 THEN 'scope.origin_not_allowed' WHEN 5 THEN 'site_skill.tool_capabilities_invalid'
WHEN 6 THEN 'site_skill.checks_invalid' WHEN 7 THEN 'site_skill.time_invalid' WHEN 8 THEN 'site_skill.digest_mismatch' END AS code FROM k""")
def skill_records(spark, sf_dir):
    """A skill a page; the length of its body decides which rule it breaks."""
    c = F.col
    k = F.length("html") % 9
    digest = F.concat(F.lit("sha256:"), F.sha2("html", 256))
    s = accepted(spark, sf_dir).select(
        "page_id", F.when(k == 1, "Bad Key").otherwise(urls.site_key(c("url"))).alias("site_key"), F.when(k == 2, 2).otherwise(1).alias("version"), F.lit(None).cast("string").alias("previous_digest"), F.lit("acquisition.web_http").alias("tool_id"), F.lit("1.0.0").alias("tool_version"),
        F.when(k == 5, F.array(F.lit("html"), F.lit("html"))).otherwise(F.array(F.lit("html"))).alias("capabilities"), F.when(k == 6, F.array(F.lit("Text/HTML"))).otherwise(F.array(F.lit("text/html"))).alias("mime_types"), F.lit(1).alias("minimum_words"), F.when(k == 3, "acquisition").otherwise("discovery").alias("discovery_category"),
        F.when(k == 4, "https://far.example.test/").otherwise(c("url")).alias("discovery_source"), F.array(urls.origin(c("url"))).alias("origins"), F.array(F.lit("/**")).alias("paths"), digest.alias("digest"), F.when(k == 8, "sha256:0").otherwise(digest).alias("body_digest"), F.when(k == 7, "2024-02-30T00:00:00Z").otherwise("2024-02-29T00:00:00Z").alias("verified_at"),
    )
    return records.skill_record_codes(s).select("page_id", "code")


@query(f"""WITH {CANON} SELECT page_id, CASE length(html) % 7 WHEN 1 THEN 'schema.duplicate_key' WHEN 2 THEN 'scope.unknown_field' WHEN 3 THEN 'scope.missing' WHEN 4 THEN 'scope.invalid' WHEN 5 THEN 'scope.content_type_invalid' WHEN 6 THEN 'scope.origin_not_allowed' END AS code FROM ok""")
def scope_texts(spark, sf_dir):
    """Scopes of pages as JSON texts, by the length of the body with a key twice, one too many, one too few, as a list, with an unknown kind, with another origin."""
    c = F.col
    k = F.length("html") % 7
    q = lambda x: F.concat(F.lit('["'), x, F.lit('"]'))
    seeds, origin = q(c("url")), q(F.when(k == 6, "https://far.example.test").otherwise(urls.origin(c("url"))))
    body = F.concat(F.lit('{"seeds":'), seeds, F.when(k == 1, F.concat(F.lit(',"seeds":'), seeds)).otherwise(""), F.when(k != 3, F.concat(F.lit(',"allowed_origins":'), origin)).otherwise(""), F.lit(',"include_paths":["/**"],"content_types":["'), F.when(k == 5, "pdf").otherwise("html"), F.lit('"]'), F.when(k == 2, ',"more":1').otherwise(""), F.lit("}"))
    t = accepted(spark, sf_dir).select(c("page_id").alias("scope_id"), F.when(k == 4, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("body"))
    return records.parsed_scopes(t).select(c("scope_id").alias("page_id"), "code")


# ---- governed flows

GOVERNED = EXPLORED + """, own AS (SELECT t.site_key, t.u, ok.url IS NOT NULL AS held, ok.html, 'https://' || t.site_key AS o FROM t LEFT JOIN ok ON ok.url = t.u),
asked AS (SELECT *, regexp_extract(u, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM own),
d AS (SELECT *, CASE WHEN (length(origin) % 6 = 0 AND starts_with(path, '/en/') AND NOT starts_with(path, '/en/7')) THEN 'robots.disallowed' WHEN length(origin) % 6 = 2 THEN 'robots.forbidden' END AS barred, coalesce(octet_length(encode(html)), 0) AS b FROM asked),
w AS (SELECT *, row_number() OVER o - 1 AS position, coalesce(sum(CASE WHEN barred IS NULL THEN 1 ELSE 0 END) OVER b4, 0) AS req, coalesce(sum(CASE WHEN barred IS NULL THEN b ELSE 0 END) OVER b4, 0) AS byt FROM d
 WINDOW o AS (PARTITION BY site_key ORDER BY NOT held, u), b4 AS (PARTITION BY site_key ORDER BY NOT held, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT site_key, u, position, held, CASE WHEN barred IS NOT NULL THEN barred WHEN req >= 12 OR byt >= 60000 THEN 'budget.exhausted' WHEN NOT held THEN 'gateway.not_logged' END AS code, barred IS NULL AND NOT (req >= 12 OR byt >= 60000) AS dispatched FROM w)"""


def _governed(spark, sf_dir):
    p = accepted(spark, sf_dir).select("url", "html", "mime")
    return flows.govern(flows.explore(p, p), robots.policies(robots_files(spark, sf_dir)), "spindrift/1.0", 12, 60_000)


@query(f"WITH {GOVERNED} SELECT site_key, u AS canonical_url, position, code, dispatched FROM g")
def site_governed(spark, sf_dir):
    """Exploration of every site under its robots file and a budget of twelve requests and 60,000 bytes."""
    return _governed(spark, sf_dir).select("site_key", "canonical_url", "position", "code", "dispatched")


@query(f"""WITH {GOVERNED}, s AS (SELECT site_key, count(*) FILTER (WHERE code IS NULL) AS n_pages, count(*) FILTER (WHERE dispatched) AS n_requests, bool_or(held AND starts_with(coalesce(code, ''), 'robots.')) AS rejected, bool_or(coalesce(code, '') = 'budget.exhausted') AS spent, bool_or(held AND code IS NULL) AS seed,
 count(*) FILTER (WHERE NOT held) AS n, count(*) FILTER (WHERE NOT held AND code IS NULL) AS got FROM g GROUP BY site_key),
r AS (SELECT *, CASE WHEN seed AND got = n AND n > 0 THEN 'source_exhausted' WHEN rejected THEN 'rejected' WHEN spent THEN 'budget_exhausted' WHEN n = 0 THEN 'discovery_failed' ELSE 'acquisition_failed' END AS stop_reason FROM s)
SELECT site_key, n_pages, n_requests, stop_reason, CASE stop_reason WHEN 'source_exhausted' THEN 'completed' WHEN 'rejected' THEN 'rejected' ELSE 'partial' END AS status FROM r""")
def site_outcomes(spark, sf_dir):
    return flows.explored_sites(_governed(spark, sf_dir)).select("site_key", "n_pages", "n_requests", "stop_reason", "status")


@query(f"""WITH {CANON}, x AS (SELECT site_key, url, 'sha256:' || sha256(html) AS d, substr(sha256(html), 1, 1) AS k FROM ok), failed AS (SELECT DISTINCT site_key FROM x WHERE k = '0'),
c AS (SELECT site_key, url, d, 0 AS rank FROM x WHERE k <> '0' UNION ALL SELECT site_key, url, d || '!', 1 FROM x JOIN failed USING (site_key) WHERE k < '8' UNION ALL SELECT site_key, url, d || '?', 2 FROM x JOIN failed USING (site_key))
SELECT site_key, url AS canonical_url, arg_min(d, rank) AS content_digest, CASE min(rank) WHEN 0 THEN 'replayed' WHEN 1 THEN 'recovered' ELSE 'kept' END AS way FROM c GROUP BY ALL""")
def site_recovered(spark, sf_dir):
    """Sites where a replayed page failed (digests beginning with 0) take in an exploration that saw only part, and keep the rest; of pages with one URL the first counts."""
    c = F.col
    sha = F.sha2("html", 256)
    p = accepted(spark, sf_dir).select("page_id", urls.site_key(c("url")).alias("site_key"), c("url").alias("canonical_url"), F.concat(F.lit("sha256:"), sha).alias("d"), F.substring(sha, 1, 1).alias("k"))
    replayed = p.select("page_id", "site_key", "canonical_url", c("d").alias("content_digest"), F.when(c("k") == "0", "gateway.timeout").alias("code"))
    explored = p.where("k < '8'").select("page_id", "site_key", "canonical_url", F.concat("d", F.lit("!")).alias("content_digest"), F.lit(None).cast("string").alias("code"))
    return flows.recovered(p.select("page_id", "site_key", "canonical_url", F.concat("d", F.lit("?")).alias("content_digest")), replayed, explored, ("page_id",))


@query(f"""WITH {CANON}, l AS (SELECT url, origin, path, length(html) % 8 AS k, length(origin) % 6 AS o FROM ok),
d AS (SELECT *, CASE WHEN o = 0 AND starts_with(path, '/en/') AND NOT starts_with(path, '/en/7') THEN 'robots.disallowed' WHEN o = 2 THEN 'robots.forbidden' END AS barred FROM l),
e AS (SELECT *, CASE WHEN o = 2 THEN 'robots.forbidden' WHEN k = 1 THEN 'policy.allowed' WHEN k = 2 THEN 'gateway.redirect_loop' WHEN k = 3 THEN 'scope.origin_not_allowed' WHEN k = 4 THEN 'gateway.not_logged' END AS after FROM d)
SELECT url AS start, coalesce(barred, CASE k WHEN 0 THEN 'policy.allowed' WHEN 5 THEN 'gateway.http_status' WHEN 6 THEN 'gateway.server_error' WHEN 7 THEN 'scope.content_type_not_allowed' WHEN 3 THEN 'scope.origin_not_allowed' ELSE after END) AS code,
CAST(CASE WHEN barred IS NULL AND k IN (1, 2, 4) THEN 1 ELSE 0 END AS BIGINT) AS hops FROM e""")
def governed_reads(spark, sf_dir):
    """Every page read from a log: by the length of its body it is there, moved, moved in a circle, moved to another site, moved to nowhere, missing, broken, or a file; of pages with one URL each has its own response."""
    c = F.col
    k = F.length("html") % 8
    p = accepted(spark, sf_dir)
    origin = urls.origin(c("url"))
    moved = F.concat(origin, F.lit("/moved/"), c("page_id").cast("string"))
    first = p.select("page_id", "url", F.when(k.isin(1, 2, 3, 4), 301).when(k == 5, 404).when(k == 6, 503).otherwise(200).alias("status"), F.when(k == 7, "application/pdf").otherwise("text/html").alias("mime"), F.when(k == 3, "https://far.example.test/").when(k.isin(1, 2, 4), moved).alias("location"))
    then = p.where(k.isin(1, 2)).select("page_id", moved.alias("url"), F.when(k == 2, 302).otherwise(200).alias("status"), F.lit("text/html").alias("mime"), F.when(k == 2, c("url")).alias("location"))
    starts = p.select("page_id", "url", F.array(origin).alias("origins"))
    got = flows.read(starts, first.unionByName(then), robots.policies(robots_files(spark, sf_dir)), F.array(F.lit("/**")), F.array(F.lit("html")), "spindrift/1.0", within=("page_id",))
    return got.select("start", "code", "hops")


@query(f"WITH {OBSERVED} SELECT 'blobs' AS name, count(DISTINCT sha256) AS n FROM observed UNION ALL SELECT 'artifacts', count(DISTINCT artifact_id) FROM observed UNION ALL SELECT 'observations', count(DISTINCT observation_id) FROM observed")
def stream_store_commit(spark, sf_dir):
    """Rows of the store's tables after a stream of all documents was committed."""
    out = None
    for name, rows in feeds.commit_observations(spark, f"{sf_dir}/documents.parquet").items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {ATTEMPTS}, j AS (SELECT run_id || '/' || (ord // 9) AS retrieval_id, (ord // 3) % 3 AS job, sum(requests) AS r, sum(bytes_received) AS b, sum(runtime_ms) AS m, bool_or(outcome = 'succeeded' AND bytes_received > 4000) AS got FROM attempts GROUP BY ALL),
l AS (SELECT *, 6 - coalesce(sum(r) OVER p, 0) AS lr, 40000 - coalesce(sum(b) OVER p, 0) AS lb, floor((4000 - coalesce(sum(m) OVER p, 0)) / 1000.0) AS ls, coalesce(bool_or(got) OVER p, false) AS done FROM j WINDOW p AS (PARTITION BY retrieval_id ORDER BY job ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT retrieval_id, CAST(job AS BIGINT) AS job, CAST(lr AS BIGINT) AS left_requests, CAST(lb AS BIGINT) AS left_bytes, CAST(ls AS BIGINT) AS left_seconds, NOT done AND bool_and(lr > 0 AND lb > 0 AND ls > 0) OVER (PARTITION BY retrieval_id ORDER BY job) AS runs FROM l""")
def retrieval_budgets(spark, sf_dir):
    """Nine attempts a retrieval, three a job; only what is larger than 4,000 bytes counts as fetched."""
    n = F.col("ord")
    a = attempts(spark, sf_dir).select(F.concat_ws("/", "run_id", F.floor(n / 9)).alias("retrieval_id"), (F.floor(n / 3) % 3).cast("bigint").alias("job"), F.when(F.col("bytes_received") > 4000, F.col("outcome")).otherwise("failed").alias("outcome"), "requests", "bytes_received", "runtime_ms")
    return ledger.alternates(a, 6, 40_000, 4)


@query(f"""WITH {EXPLORED}, x AS (SELECT site_key, min(url) AS src, min(origin) AS o, length(min(url)) % 4 = 0 AS gone FROM ok GROUP BY site_key),
c AS (SELECT DISTINCT x.site_key, x.o, h.origin || replace(replace(url_encode(h.h), '%2F', '/'), '%2C', ',') AS link FROM x JOIN hrefs h ON h.url = x.src WHERE NOT gone),
kept AS (SELECT site_key, link, regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM c WHERE regexp_extract(link, '^(https?://[^/?#]*)', 1) = o),
a AS (SELECT site_key, src AS url, 0 AS r, gone FROM x UNION ALL SELECT site_key, link, 1, false FROM kept WHERE path IN ('/the', '/en') OR path LIKE '/en/%'),
b AS (SELECT site_key, url, min(r) AS r, arg_min(gone, r) AS gone FROM a GROUP BY ALL), log AS (SELECT url FROM ok WHERE url NOT IN (SELECT src FROM x WHERE gone))
SELECT site_key, url AS canonical_url, CASE WHEN r = 1 THEN 'candidate' WHEN gone THEN 'missing' ELSE 'source' END AS role, CASE WHEN gone THEN 'runtime.discovery_unavailable' WHEN url NOT IN (SELECT url FROM log) THEN 'gateway.not_logged' END AS code FROM b""")
def site_replay(spark, sf_dir):
    """The first page of each site as its skill's discovery source, for pages in scope; some sources are not in the log any more."""
    c = F.col
    p = accepted(spark, sf_dir)
    s = p.groupBy(urls.site_key(c("url")).alias("site_key")).agg(F.min("url").alias("source_url"), F.min(urls.origin(c("url"))).alias("o"))
    recipes = s.select("site_key", "source_url", F.array("o").alias("origins"), F.array(F.lit("/the"), F.lit("/en/**")).alias("paths"))
    log = p.select("url", "html", "mime").join(s.where(F.length("source_url") % 4 == 0).select(c("source_url").alias("url")), "url", "left_anti")
    return flows.replay(recipes, log).select("site_key", "canonical_url", "role", "code")


@query(f"""WITH {OBSERVED}, k AS (SELECT doc_id, size_bytes % 17 AS k FROM observed) SELECT doc_id, CASE k WHEN 1 THEN 'handoff.id_invalid' WHEN 2 THEN 'handoff.run_id_mismatch' WHEN 3 THEN 'schema.time_invalid' WHEN 4 THEN 'handoff.source_id_mismatch' WHEN 5 THEN 'redirect.chain_invalid' WHEN 6 THEN 'handoff.content_ref_invalid' WHEN 7 THEN 'artifact.duplicate' WHEN 8 THEN 'job.time_invalid'
WHEN 9 THEN 'result.completed_requires_artifact' WHEN 10 THEN 'result.completed_has_failure' WHEN 11 THEN 'result.partial_requires_failure' WHEN 12 THEN 'result.failed_has_artifact' WHEN 13 THEN 'handoff.source_mismatch' WHEN 14 THEN 'manifest.transform_lineage_invalid' WHEN 15 THEN 'handoff.id_mismatch' WHEN 16 THEN 'handoff.source_invalid' END AS code FROM k""")
def handoff_records(spark, sf_dir):
    """A handoff a document with its source, a redirect and a derived text; the length of the body decides what contradicts it."""
    c, lit = F.col, F.lit
    k = c("size_bytes") % 17
    o = _observed(spark, sf_dir)
    moved = F.concat("source_url", lit("/m"))
    art = lambda ident, role, url, tool, at=c("observed_at"): F.struct(
        ident.alias("artifact_id"), F.concat(lit("o"), ident).alias("observation_id"), lit(role).alias("role"), url.alias("source_url"), at.alias("observed_at"), tool.alias("tool_id"), lit("1").alias("tool_version"), F.concat(F.when(k == 6, "/v2/").otherwise("/v1/artifacts/"), ident).alias("content_ref"))
    source = art(c("artifact_id"), "source", moved, F.when(k == 13, "other").otherwise("web"))
    text = art(F.when(k == 7, c("artifact_id")).otherwise("artifact-t"), "derived", F.when(k == 14, "urn:spindrift:transform:other:1").otherwise("urn:spindrift:transform:md:1"), lit("md"))
    tried = lambda outcome, asked, end, tool: F.struct(outcome.alias("outcome"), asked.alias("requested_url"), end.alias("final_url"), lit(tool).alias("tool_id"), lit("1").alias("tool_version"), F.when(k == 8, "2030-01-01T00:00:00Z").otherwise(c("observed_at")).alias("finished_at"))
    none = F.array().cast("array<struct<artifact_id:string,observation_id:string,role:string,source_url:string,observed_at:string,tool_id:string,tool_version:string,content_ref:string>>")
    rows = o.select(
        "doc_id", F.when(k == 1, "x").otherwise(c("sha256")).alias("handoff_id"), F.when(k == 15, F.sha2("sha256", 256)).otherwise(c("sha256")).alias("body_digest"), lit("j").alias("job_id"), F.when(k == 2, "r").otherwise("j").alias("run_id"),
        F.when(k == 11, "partial").when(k == 12, "failed").otherwise("completed").alias("status"), F.when(k == 3, "2025").otherwise("2029-01-01T00:00:00Z").alias("generated_at"), F.when(k.isin(10, 12), 1).otherwise(0).alias("n_errors"),
        F.struct(F.when(k == 4, "x").otherwise(c("source_url")).alias("source_id"), c("source_url").alias("requested_url"), F.when(k == 5, c("source_url")).otherwise(moved).alias("current_url"), moved.alias("final_url"), F.array(F.struct(c("source_url").alias("from_url"), moved.alias("to_url"), lit("allowed").alias("decision"))).alias("redirects")).alias("source"),
        F.when(k == 9, none).when(k == 16, F.array(text)).otherwise(F.array(source, text)).alias("artifacts"),
        F.array(tried(lit("succeeded"), c("source_url"), moved, "web"), tried(lit("succeeded"), moved, lit(None).cast("string"), "md")).alias("attempts"),
    )
    return rows.select("doc_id", records.handoff_record_code().alias("code"))
