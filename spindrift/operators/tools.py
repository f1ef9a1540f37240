"""Tool eligibility, ranking, skill lineage and lifecycle state.

tools(tool_id, version, category, health, qualification, capabilities, max_runtime_seconds,
max_input_bytes, max_output_bytes) is a small dimension; requirements(req_id, category, capabilities,
input_bytes, output_bytes, runtime_seconds, installed, compliant, left_requests, left_bytes,
left_runtime_ms, left_attempts) carries one row a decision, null fact columns meaning no facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.shared import cut, small

# The order in which acquisition tools are tried.
ORDER = ("acquisition.web_http", "acquisition.playwright", "acquisition.cloakbrowser")


def eligibility(tools: DataFrame, requirements: DataFrame) -> DataFrame:
    """Every requirement with every tool (the tool dimension is broadcast behind a count): (req_id, tool_id, version, eligible, reasons, checks)."""
    r = requirements.alias("r")
    both = r.join(small(tools).alias("t"))
    c = F.col
    why = lambda bad, code: F.when(bad, F.lit(code))
    installed = c("r.installed").isNull() | F.array_contains(c("r.installed"), c("t.tool_id"))
    compliant = c("r.compliant").isNull() | F.array_contains(c("r.compliant"), c("t.tool_id"))
    missing = F.array_sort(F.array_except(c("r.capabilities"), c("t.capabilities")))
    limits = F.filter(F.array(
        why(c("r.input_bytes") > c("t.max_input_bytes"), "eligibility.input_limit"),
        why(c("r.output_bytes") > c("t.max_output_bytes"), "eligibility.output_limit"),
        why(c("r.runtime_seconds") > c("t.max_runtime_seconds"), "eligibility.runtime_limit"),
    ), lambda x: x.isNotNull())
    budgets = F.filter(F.array(
        why(c("r.left_requests") == 0, "eligibility.request_budget_exhausted"),
        why(c("r.left_bytes") == 0, "eligibility.byte_budget_exhausted"),
        why(c("r.left_runtime_ms") < 1000, "eligibility.runtime_budget_exhausted"),
        why(c("r.left_attempts") == 0, "eligibility.attempt_budget_exhausted"),
    ), lambda x: x.isNotNull())
    category, healthy, qualified = c("t.category") == c("r.category"), c("t.health") == "healthy", c("t.qualification") == "qualified"
    present = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    reasons = F.concat(
        present(why(~category, "eligibility.category_mismatch"), why(~installed, "eligibility.not_installed"), why(~healthy, "eligibility.unhealthy"), why(~qualified, "eligibility.unqualified")),
        F.transform(missing, lambda m: F.concat(F.lit("eligibility.capability_missing:"), m)),
        present(why(~compliant, "eligibility.policy_noncompliant")), limits, budgets,
    )
    checks = present(
        F.lit("eligibility.registered"), why(installed, "eligibility.installed"), why(qualified, "eligibility.qualified"), why(healthy, "eligibility.healthy"),
        why(category & (F.size(missing) == 0), "eligibility.capability_compatible"), why(compliant, "eligibility.policy_compliant"),
        why((F.size(limits) == 0) & (F.size(budgets) == 0), "eligibility.within_budget"),
    )
    return both.select("r.req_id", "t.tool_id", "t.version", reasons.alias("reasons"), checks.alias("checks")).withColumn("eligible", F.size("reasons") == 0)


def order_rank(tool: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(t) for t in ORDER]), tool)
    return F.when(at == 0, len(ORDER)).otherwise(at - 1)


def ranking(decisions: DataFrame, preferred: DataFrame) -> DataFrame:
    """(req_id, tool_id, version, rank) of the eligible tools: the preferred first, then the default order.

    preferred(req_id, preferred, attempted, alternates): attempted tools are out; without alternates only
    the preferred tool is in; a preferred tool that is neither attempted nor eligible leaves nothing.
    """
    d = decisions.join(preferred, "req_id").where(~F.array_contains("attempted", F.col("tool_id")) & (F.col("alternates") | (F.col("tool_id") == F.col("preferred"))))
    ok = d.where("eligible")
    w = Window.partitionBy("req_id")
    usable = F.array_contains("attempted", F.col("preferred")) | (F.max((F.col("tool_id") == F.col("preferred")).cast("int")).over(w) == 1)
    rank = F.row_number().over(w.orderBy((F.col("tool_id") != F.col("preferred")).cast("int"), order_rank(F.col("tool_id")), "tool_id", "version"))
    return ok.withColumns({"_usable": usable, "rank": rank.cast("bigint")}).where("_usable").select("req_id", "tool_id", "version", "rank")


def followups(failures: DataFrame, tools: DataFrame) -> DataFrame:
    """Tools that may follow failures(run_id, code, tool_id): after a block of plain HTTP only the ordinary browser, else all."""
    narrowed = (F.col("f.code") == "acquisition.cloudflare_blocked") & (F.col("f.tool_id") == "acquisition.web_http")
    both = failures.alias("f").join(small(tools).alias("t"))
    return both.where(~narrowed | (F.col("t.tool_id") == "acquisition.playwright")).select("f.run_id", F.col("t.tool_id").alias("next_tool_id"))


def active_skills(events: DataFrame) -> DataFrame:
    """(site_key, digest, sequence) after the last activate or rollback of events(site_key, sequence, action, to_digest)."""
    return events.where(F.col("action").isin("activate", "rollback")).groupBy("site_key").agg(F.max_by("to_digest", "sequence").alias("digest"), F.max("sequence").alias("sequence"))


def lineage_breaks(skills: DataFrame) -> DataFrame:
    """Skill versions of skills(site_key, version, digest, previous_digest) that do not follow their predecessor by one."""
    prev = skills.select("site_key", (F.col("version") + 1).alias("version"), F.col("digest").alias("_before"))
    first = (F.col("version") == 1) & F.col("previous_digest").isNull()
    return skills.join(prev, ["site_key", "version"], "left").where(~first & ~F.coalesce(F.col("previous_digest") == F.col("_before"), F.lit(False))).select("site_key", "version")


def ancestors(skills: DataFrame) -> DataFrame:
    """(site_key, digest, ancestor, depth): each skill version with itself and all before it, by doubling.

    After k rounds all ancestors nearer than 2**k are known, and the one that many versions back, from which
    the next round goes on; the rounds grow with the logarithm of the longest line.  Lines that come back
    on themselves end after as many versions as their site has.
    """
    c = F.col
    own = skills.select("site_key", "digest")
    jump = cut(skills.where("previous_digest is not null").select("site_key", "digest", c("previous_digest").alias("far")).distinct())
    known = cut(own.unionByName(jump.select("site_key", c("far").alias("digest"))).distinct().select("site_key", "digest", c("digest").alias("ancestor"), F.lit(0).cast("bigint").alias("depth")))
    sizes = cut(known.groupBy("site_key").agg(F.count("*").alias("_size")))
    most = sizes.agg(F.max("_size")).first()[0] or 0
    reach = 1
    while reach < 2 * most and jump.limit(1).count():
        hop = jump.withColumnRenamed("digest", "start").withColumnRenamed("far", "digest")
        further = hop.join(known, ["site_key", "digest"]).join(sizes, "site_key").where(c("depth") + reach < c("_size")).select("site_key", c("start").alias("digest"), "ancestor", (c("depth") + reach).alias("depth"))
        on = jump.select("site_key", c("digest").alias("far"), c("far").alias("next"))
        known, jump = cut(known.unionByName(further)), cut(jump.join(on, ["site_key", "far"]).select("site_key", "digest", c("next").alias("far")))
        reach *= 2
    return known.join(own.distinct(), ["site_key", "digest"], "left_semi").select("site_key", "digest", "ancestor", "depth")


def tool_states(events: DataFrame) -> DataFrame:
    """(tool_id, version, status, active) from lifecycle events(sequence, tool_id, version, event): the last event names the status;
    a tool's active version is its last activated one unless that was disabled or broken since."""
    last = events.groupBy("tool_id", "version").agg(F.max_by("event", "sequence").alias("status"))
    live = events.where("event = 'activate'").groupBy("tool_id").agg(F.max_by("version", "sequence").alias("_live"))
    return last.join(live, "tool_id", "left").select("tool_id", "version", "status", ((F.col("version") == F.col("_live")) & (F.col("status") == "activate")).alias("active")).fillna(False, ["active"])
