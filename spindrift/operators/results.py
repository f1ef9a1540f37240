"""Projections of results: resolution kinds, retrieval states, handoffs, redirect chains, framing and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.identity import canonical_json
from spindrift.operators.quality import operational

# Acquisition tools and the method names callers know them by.
METHODS = {"acquisition.web_http": "HTTP", "acquisition.playwright": "BROWSER", "acquisition.cloakbrowser": "CLOAK"}
# Failure codes and the reasons callers are given.
REASONS = {"acquisition.cloudflare_blocked": "CLOUDFLARE_BLOCKED", "acquisition.auth_required": "AUTH_REQUIRED", "acquisition.permission_denied": "PERMISSION_DENIED", "acquisition.script_only": "BROWSER_REQUIRED"}
REDIRECTS = (301, 302, 303, 307, 308)


def resolution_kind(kind: Column, hops: Column, redirects: Column) -> Column:
    """direct, redirect or html_navigation, and html or file; unresolved without a terminal artifact."""
    how = F.when(hops > 1, "html_navigation").when(redirects > 0, "redirect").otherwise("direct")
    return F.when(kind.isNull(), "unresolved").otherwise(F.concat(how, F.lit("_"), kind))


def _mapped(x: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def retrieval(last: DataFrame) -> DataFrame:
    """(run_id, outcome, reason, method, switched, actions) of last(run_id, tool_id, code, n_called, n_artifacts, n_jobs, file_source, browser_eligible)."""
    code = F.coalesce("code", F.lit(""))
    fetched = F.col("n_artifacts") > 0
    reason = F.when(fetched, "HTTP_OK").otherwise(F.coalesce(_mapped(code, REASONS), F.when(code.startswith("acquisition.") | code.startswith("runtime.quality"), "QUALITY_REJECTED").otherwise("METHODS_EXHAUSTED")))
    method = F.when(F.col("n_jobs") > 1, "OFFICIAL_ALTERNATE").when(F.col("file_source"), "FILE").otherwise(_mapped(F.col("tool_id"), METHODS))
    more = ~fetched & ~reason.isin("AUTH_REQUIRED", "PERMISSION_DENIED")
    browser = more & F.coalesce(method == "HTTP", F.lit(False)) & reason.isin("BROWSER_REQUIRED", "CLOUDFLARE_BLOCKED") & F.col("browser_eligible")
    actions = F.concat(F.when(browser, F.array(F.lit("retrieve-browser"))).otherwise(F.array().cast("array<string>")), F.when(more, F.array(F.lit("discover_official_alternates"), F.lit("retrieve-alternate"))).otherwise(F.array().cast("array<string>")))
    return last.select("run_id", F.when(fetched, "FETCHED").otherwise("UNRESOLVED").alias("outcome"), reason.alias("reason"), method.alias("method"), ((F.col("n_called") > 1) | (F.col("n_jobs") > 1)).alias("switched"), actions.alias("actions"))


# Failure codes that end a retrieval whatever else could be tried.
FINAL = ("runtime.workflow_failed", "gateway.closed", "gateway.private_address", "gateway.dns_failed", "gateway.dns_not_public", "gateway.peer_not_public", "gateway.https_downgrade", "gateway.transport_contract", "browser.read_only")


def retrieval_error(codes: Column, fetched: Column) -> Column:
    """The code that makes a retrieval fail, null if none does: a cancellation, broken machinery, or without an artifact the first final code."""
    first = lambda a: F.get(a, F.lit(0))
    cancel = first(F.filter(codes, lambda c: c.contains("cancel")))
    broken = first(F.filter(codes, operational))

    def final(c):
        out = c.isin(*FINAL) | c.contains("budget") | c.contains("boundary")
        for p in ("robots.", "policy.", "scope.", "protocol.", "artifact."):
            out = out | c.startswith(p)
        return out

    return F.coalesce(cancel, broken, F.when(~fetched, first(F.filter(codes, final))))


def handoff(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds (body, handoff_id): canonical JSON of the named columns and its content hash."""
    body = canonical_json(*[(c, F.col(c)) for c in columns])
    return rows.withColumn("body", body).withColumn("handoff_id", F.concat(F.lit("handoff-"), F.sha2(F.col("body"), 256)))


def redirect_chains(hops: DataFrame) -> DataFrame:
    """(run_id, n_hops, final_url, code) of hops(run_id, ord, from_url, to_url, status): first code in hop order.

    Redirects must have a status and a target, join each other, come back nowhere and not leave https.
    """
    arr = F.array_sort(F.collect_list(F.struct("ord", "from_url", "to_url", "status")))
    got = hops.groupBy("run_id").agg(arr.alias("h"))

    def step(acc, x):
        code = (
            F.when(acc["code"].isNotNull(), acc["code"])
            .when(~x["status"].isin(*REDIRECTS), "gateway.redirect_status")
            .when(x["to_url"].isNull(), "gateway.redirect_missing")
            .when(acc["at"].isNotNull() & (acc["at"] != x["from_url"]), "redirect.chain_broken")
            .when(F.array_contains(acc["seen"], x["to_url"]) | (x["to_url"] == x["from_url"]), "gateway.redirect_loop")
            .when(x["from_url"].startswith("https://") & x["to_url"].startswith("http://"), "gateway.https_downgrade")
        )
        return F.struct(code.alias("code"), x["to_url"].alias("at"), F.array_append(acc["seen"], x["from_url"]).alias("seen"))

    start = F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("at"), F.array().cast("array<string>").alias("seen"))
    end = F.aggregate("h", start, step)
    return got.select("run_id", F.size("h").cast("bigint").alias("n_hops"), end["at"].alias("final_url"), end["code"].alias("code"))


def framing(responses: DataFrame) -> DataFrame:
    """Adds ``code`` to responses(headers, body, remaining): the first rule of response framing that fails.

    A chunked body may state no length; a length must be decimal, within the remaining budget and met; a
    body of unknown length must leave some of the budget.
    """
    named = F.transform_keys("headers", lambda k, v: F.lower(k))
    length, chunked = F.trim(F.coalesce(F.try_element_at(named, F.lit("content-length")), F.lit(""))), F.try_element_at(named, F.lit("transfer-encoding")).isNotNull()
    n, size = length.try_cast("decimal(38,0)"), F.octet_length("body")
    code = (
        F.when(chunked & (length != ""), "gateway.framing_invalid")
        .when((length != "") & (~length.rlike("^[0-9]{1,19}$") | (n > (1 << 63) - 1)), "gateway.framing_invalid")
        .when((length != "") & (n > F.col("remaining")), "budget.bytes")
        .when((length != "") & (size < n), "gateway.body_incomplete")
        .when((length == "") & (size >= F.col("remaining")), "budget.bytes")
    )
    return responses.withColumn("code", code)


def public_address(ip: Column) -> Column:
    """Whether a dotted IPv4 address is global: no private, loopback, link-local, shared, reserved or multicast range."""
    p = F.split(ip, r"\.")
    a, b, c = (p.getItem(i).try_cast("int") for i in range(3))
    bad = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)))) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$") & ~bad, F.lit(False))


def violations(**checks: DataFrame) -> DataFrame:
    """(constraint, violations): one row a named check, counting the rows it finds."""
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
