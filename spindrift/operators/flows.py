"""Whole flows over logged responses: navigation to a terminal, one-hop exploration, refresh of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import identity, urls
from spindrift.functions.shared import cut
from spindrift.operators import catalog, discovery, evidence, policy, quality, results, robots, state

def navigate(starts: DataFrame, edges: DataFrame, most: int = 16) -> DataFrame:
    """(start, final_url, hops, stop_reason): each start followed along edges(url, n, target), n targets of a page and one of them.

    A page with no target ends the walk, with several or with one seen before it stops, and so it does
    after ``most`` hops, or fewer where starts(url, most) say so.  A join a hop for all starts together; walks that have stopped are spread over the
    tasks and match nothing.
    """
    c, stopped = F.col, F.col("stop").isNotNull()
    own = F.least(c("most"), F.lit(most)) if "most" in starts.columns else F.lit(most)
    walk = starts.select(c("url").alias("start"), own.alias("most")).distinct().withColumns({"at": c("start"), "seen": F.array("start"), "stop": F.lit(None).cast("string")})
    step = edges.select(c("url").alias("_key"), "n", "target")
    for hop in range(most + 1):
        stop = (
            F.when(c("n").isNull(), "terminal_html").when(c("n") > 1, "multiple_navigation_targets").when(F.array_contains("seen", c("target")), "navigation_loop")
            .when(F.lit(hop) >= c("most"), "navigation_hop_limit")
        )
        key = F.when(stopped, F.concat(F.lit("\u0000"), "start")).otherwise(c("at"))
        walk = walk.withColumn("_key", key).join(step, "_key", "left").withColumn("_stop", F.when(stopped, c("stop")).otherwise(stop))
        on = c("_stop").isNull()
        walk = walk.select("start", "most", F.when(on, c("target")).otherwise(c("at")).alias("at"), F.when(on, F.array_append("seen", c("target"))).otherwise(c("seen")).alias("seen"), c("_stop").alias("stop"))
    return walk.select("start", c("at").alias("final_url"), (F.size("seen") - 1).cast("bigint").alias("hops"), c("stop").alias("stop_reason"))


def read(starts: DataFrame, responses: DataFrame, policies: DataFrame, paths: Column, kinds: Column, agent: str, most: int = 5, within: tuple[str, ...] = ()) -> DataFrame:
    """(start, final_url, hops, status, code) of reading each of starts(url, origins) from a log of responses(url, status, mime, location), as an agent may.

    At each hop the URL must be in scope, then robots files must allow it, then the log must hold it; a
    redirect is followed, up to ``most`` times and nowhere twice, if ``evidence.redirect_authority`` allows
    it; the last response passes ``policy.response_gate``.  The code is 'policy.allowed' or the first that fails.
    A log holds a URL once, or once for each value of the columns ``within`` of starts and responses (such as
    a run): a start is then answered by its own responses only, and its row has those columns, too.
    """
    c = F.col
    walk = starts.select(c("url").alias("start"), "origins", c("url").alias("at"), *within).withColumn("seen", F.array("at"))
    logged = responses.select(c("url").alias("at"), c("status").alias("_status"), c("mime").alias("_mime"), c("location").alias("location"), F.lit(True).alias("_held"), *within)
    ended = None
    for hop in range(most + 1):
        here = urls.decide(F.struct(c("at").alias("url"), F.lit(None).cast("string").alias("code")), c("origins"), paths)
        asked = robots.decide(walk.withColumns({"url": c("at"), "origin": urls.origin(c("at")), "_here": here}), policies, agent).withColumnsRenamed({"code": "_robots", "status": "_fetched"})
        moved = asked.join(logged, ["at", *within], "left").withColumns({"kind": F.lit("target"), "current_url": c("at"), "status_code": c("_status")})
        turns = F.coalesce(c("_status").isin(*results.REDIRECTS), F.lit(False))
        moved = evidence.redirect_authority(moved.withColumn("location", F.when(turns, c("location"))), c("origins"), paths).withColumnsRenamed({"code": "_redirect", "target_url": "_next"})
        stop = (
            F.when(~c("_here.allowed"), c("_here.code")).when(c("decision") == "denied", c("_robots")).when(c("_held").isNull(), "gateway.not_logged")
            .when(turns & (c("_redirect") != "policy.allowed"), c("_redirect")).when(turns & F.array_contains("seen", c("_next")), "gateway.redirect_loop").when(turns & F.lit(hop >= most), "gateway.redirect_limit")
            .when(~turns, policy.response_gate(c("_status"), c("_mime"), kinds))
        )
        step = cut(moved.select("start", "origins", "at", "seen", "_next", c("_status").alias("status"), stop.alias("code"), *within))
        done = step.where("code is not null").select("start", c("at").alias("final_url"), (F.size("seen") - 1).cast("bigint").alias("hops"), "status", "code", *within)
        ended = done if ended is None else ended.unionByName(done)
        walk = step.where("code is null").select("start", "origins", c("_next").alias("at"), F.array_append("seen", c("_next")).alias("seen"), *within)
        if not walk.limit(1).count():
            break
    return ended


def _targets(responses: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(site_key, canonical_url, role): the seed pages, and the links of each that are on its own site or, as role 'other', on another."""
    seed = responses.join(seeds.select("url").distinct(), "url", "left_semi").withColumn("site_key", urls.site_key(F.col("url")))
    links = discovery.html_links(seed, limit).select("site_key", F.explode("found.candidates").alias("canonical_url"))
    own = urls.site_key(F.col("canonical_url")) == F.col("site_key")
    found = links.select("site_key", "canonical_url", F.when(own, "candidate").otherwise("other").alias("role"))
    mine = seed.select("site_key", F.col("url").alias("canonical_url"), F.lit("seed").alias("role"))
    rank = F.when(F.col("role") == "seed", 0).otherwise(1)
    return mine.unionByName(found).groupBy("site_key", "canonical_url").agg(F.min_by("role", rank).alias("role"))


def judged(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(canonical_url, code, content_digest, artifact_id, n_bytes) and the columns ``keep`` of responses(url, html, mime): each body is read once for its quality and its hash; only facts go on."""
    got = quality.quality(responses.withColumn("mime", F.coalesce("mime", F.lit("application/octet-stream"))))
    sha = F.sha2("html", 256)
    ok = F.col("code").isNull()
    return got.select(
        F.col("url").alias("canonical_url"), "code", F.when(ok, F.concat(F.lit("sha256:"), sha)).alias("content_digest"),
        F.when(ok, identity.artifact_id(sha, F.col("mime"), F.lit("source"))).alias("artifact_id"), F.octet_length("html").cast("bigint").alias("n_bytes"), *keep,
    )


def explore(responses: DataFrame, seeds: DataFrame, limit: int = discovery.LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One-hop exploration of sites over logged responses(url, html, mime): (site_key, canonical_url, role, code, artifact_id, content_digest, n_bytes) and the columns ``keep`` of the response.

    Links of each seed page are looked up in the log; what is there is judged for quality and becomes a page
    of the site's state, what is not is 'gateway.not_logged'; a link to another host is 'runtime.site_identity_mismatch'.
    A URL with several responses has a row for each.
    """
    got = _targets(responses, seeds, limit).join(judged(responses, keep).withColumn("_held", F.lit(True)), "canonical_url", "left")
    code = F.when(F.col("role") == "other", "runtime.site_identity_mismatch").when(F.col("_held").isNull(), "gateway.not_logged").otherwise(F.col("code"))
    ok = code.isNull()
    return got.select("site_key", "canonical_url", "role", code.alias("code"), F.when(ok, F.col("artifact_id")).alias("artifact_id"), F.when(ok, F.col("content_digest")).alias("content_digest"), "n_bytes", *keep)


def govern(explored: DataFrame, policies: DataFrame, agent: str, most_requests: int, most_bytes: int, most_targets: int = discovery.LIMIT) -> DataFrame:
    """explored(site_key, canonical_url, role, code, content_digest, n_bytes, ...) under robots policies and the budgets of a site: adds (position, code, dispatched).

    A site's targets are taken in order, seeds first, responses of one URL by digest and size.  One of another host or that robots files deny uses
    nothing; each of the others uses one request and the bytes of its response; when nothing is
    left of a budget, or ``most_targets`` candidates were taken, the rest is not dispatched, with the code
    'budget.exhausted' or 'explore.candidate_limit'.
    """
    c = F.col
    targets = explored.withColumnRenamed("code", "_own").withColumns({"origin": urls.origin(c("canonical_url")), "url": c("canonical_url")})
    asked = robots.decide(targets, policies, agent).withColumnRenamed("code", "_robots")
    barred = F.when(c("_own") == "runtime.site_identity_mismatch", c("_own")).when(c("decision") == "denied", c("_robots"))
    taken = barred.isNull().cast("bigint")
    order = Window.partitionBy("site_key").orderBy((c("role") != "seed").cast("int"), "canonical_url", "content_digest", "n_bytes")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    bytes_ = taken * F.coalesce(c("n_bytes"), F.lit(0))
    got = asked.withColumns({
        "position": (F.row_number().over(order) - 1).cast("bigint"), "_full": (spent(taken) >= most_requests) | (spent(bytes_) >= most_bytes),
        "_enough": spent(taken * (c("role") == "candidate").cast("bigint")) >= most_targets,
    })
    code = F.when(barred.isNotNull(), barred).when(c("_full"), "budget.exhausted").when(c("_enough") & (c("role") == "candidate"), "explore.candidate_limit").otherwise(c("_own"))
    return got.withColumns({"code": code, "dispatched": barred.isNull() & ~c("_full") & ~(c("_enough") & (c("role") == "candidate"))}).drop("_own", "_robots", "_full", "_enough", "origin", "url", "status", "decision")


def explored_sites(governed: DataFrame) -> DataFrame:
    """(site_key, status, stop_reason, complete, n_pages, n_requests, codes) of each site of ``govern``."""
    has = lambda code: F.bool_or(F.coalesce(F.col("code") == code, F.lit(False)))
    g = governed.groupBy("site_key").agg(
        F.count_if(F.col("code").isNull()).alias("n_pages"), F.count_if(F.col("dispatched")).alias("n_requests"), F.array_sort(F.collect_set("code")).alias("codes"),
        F.bool_or((F.col("role") == "seed") & F.col("code").isNull()).alias("_seed"), F.bool_or((F.col("role") == "seed") & F.coalesce(F.col("code").startswith("robots."), F.lit(False))).alias("rejected"),
        has("budget.exhausted").alias("budget_exhausted"), F.count_if(F.col("role") == "candidate").alias("n_selected"), F.count_if((F.col("role") == "candidate") & F.col("code").isNull()).alias("_got"),
    )
    facts = g.withColumns({"has_skill": F.col("_seed") & (F.col("_got") == F.col("n_selected")) & (F.col("n_selected") > 0), "cancelled": F.lit(False), "discovery_failed": F.lit(False)})
    said = facts.withColumn("o", catalog.explore_outcome())
    return said.select("site_key", "o.status", "o.stop_reason", (F.col("o.stop_reason") == "source_exhausted").alias("complete"), "n_pages", "n_requests", "codes")


def replay(recipes: DataFrame, responses: DataFrame, limit: int = discovery.LIMIT) -> DataFrame:
    """(site_key, canonical_url, role, code, artifact_id, content_digest) of running recipes(site_key, source_url, origins, paths) of skills again over logged responses.

    The discovery source is read first; without it a recipe yields one row with 'runtime.discovery_unavailable'.
    Its links in scope on the recipe's site are looked up and judged.
    """
    c = F.col
    src = recipes.join(responses.withColumnRenamed("url", "source_url"), "source_url", "left")
    links = discovery.html_links(src.where("html is not null").withColumn("url", c("source_url")), limit)
    links = links.select("site_key", "origins", "paths", F.explode("found.candidates").alias("canonical_url"))
    inside = urls.decide(F.struct(c("canonical_url").alias("url"), F.lit(None).cast("string").alias("code")), c("origins"), c("paths"))["allowed"]
    found = links.where(inside & (urls.site_key(c("canonical_url")) == c("site_key"))).select("site_key", "canonical_url", F.lit("candidate").alias("role"))
    own = src.select("site_key", c("source_url").alias("canonical_url"), F.when(c("html").isNull(), "missing").otherwise("source").alias("role"))
    rank = F.when(c("role") == "candidate", 1).otherwise(0)
    targets = own.unionByName(found).groupBy("site_key", "canonical_url").agg(F.min_by("role", rank).alias("role"))
    got = targets.join(judged(responses).withColumn("_held", F.lit(True)), "canonical_url", "left")
    code = F.when(c("role") == "missing", "runtime.discovery_unavailable").when(c("_held").isNull(), "gateway.not_logged").otherwise(c("code"))
    return got.select("site_key", "canonical_url", "role", code.alias("code"), F.when(code.isNull(), c("artifact_id")).alias("artifact_id"), F.when(code.isNull(), c("content_digest")).alias("content_digest"))


def recovered(previous: DataFrame, replayed: DataFrame, explored: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(site_key, canonical_url, content_digest, way): pages of a refresh, from the replay of the last state where it succeeded, else from a recovery exploration, else as they were.

    A site recovers as a whole: only where a replayed target failed is the exploration taken in.
    Of pages that are as good and share a URL the first by the columns ``order`` of all three counts, then by digest.
    """
    failed = replayed.where("code is not null").select("site_key").distinct()
    again = replayed.where("code is null").select("site_key", "canonical_url", "content_digest", F.lit(0).alias("_rank"), *order)
    fresh = explored.where("code is null").join(failed, "site_key", "left_semi").select("site_key", "canonical_url", "content_digest", F.lit(1).alias("_rank"), *order)
    old = previous.join(failed, "site_key", "left_semi").select("site_key", "canonical_url", "content_digest", F.lit(2).alias("_rank"), *order)
    best = F.min_by(F.struct("content_digest", "_rank"), F.struct("_rank", *order, "content_digest")).alias("b")
    way = F.element_at(F.array(F.lit("replayed"), F.lit("recovered"), F.lit("kept")), F.col("b._rank") + 1)
    return again.unionByName(fresh).unionByName(old).groupBy("site_key", "canonical_url").agg(best).select("site_key", "canonical_url", "b.content_digest", way.alias("way"))


def refresh(previous: DataFrame, explored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Six-way change of each URL of a site between its last state(site_key, canonical_url, content_digest) and a new exploration; sites with a failed target are incomplete.

    The columns ``by`` of both tell pages that share a URL apart: each has its own change, and is in the result.
    """
    explored = explored.where("role <> 'other'")
    current = explored.where("code is null").select("canonical_url", "content_digest", *by)
    failed = explored.where("code is not null").select(F.col("canonical_url").alias("url"))
    incomplete = explored.where("code is not null").select("site_key").distinct().withColumn("_part", F.lit(True))
    sites = previous.select(F.col("canonical_url").alias("url"), "site_key").unionByName(explored.select(F.col("canonical_url").alias("url"), "site_key")).distinct()
    diff = state.diff(previous.select("canonical_url", "content_digest", *by), current, failed, complete=True, by=by)
    tagged = diff.join(sites, "url").join(incomplete, "site_key", "left")
    kind = F.when((F.col("change_type") == "missing") & F.col("_part"), "unresolved").otherwise(F.col("change_type"))
    return tagged.select("site_key", "url", kind.alias("change_type"), *by)
