"""Robots rules: parsing files into rule rows, first-match decisions, and the decision table."""

from __future__ import annotations

import re
import sys
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.arrow import struct_udf

# Directives that make a line count as robots text.
DIRECTIVES = ("user-agent", "allow", "disallow", "sitemap", "crawl-delay", "request-rate")
# Codes of a robots file that could not be fetched, by the gateway's code.
NETWORK_CODES = {
    "gateway.body_incomplete": "robots.network_error",
    "gateway.dns": "robots.dns_error",
    "gateway.timeout": "robots.timeout",
    "gateway.tls": "robots.network_error",
    "gateway.tls_certificate_invalid": "gateway.tls_certificate_invalid",
    "gateway.transport": "robots.network_error",
}
_LETTER = {"user-agent": "a", "allow": "r", "disallow": "r", "crawl-delay": "o", "request-rate": "o"}
_HTML = re.compile(r"^\s*<(?:!doctype\s+html\b|html(?:\s|>))", re.I | re.M)


def rules(text: str | None, mime: str | None) -> tuple:
    """([(group, agents, order, allow, path)], code): rules in order of their file; groups end at blank lines.

    A file without a recognised line but with some text, or one that is HTML, has no rules and a code.
    """
    if text is None:
        return [], None
    if isinstance(text, bytes):
        text = text.decode("utf-16" if text[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", errors="replace")
    if mime in ("text/html", "application/xhtml+xml") or _HTML.search(text):
        return [], "robots.parse_error"
    lines = [(raw, *(p.strip() for p in raw.partition("#")[0].partition(":"))) for raw in text.removeprefix("\ufeff").splitlines()]
    known = [(key.lower(), unquote(value)) if colon and key.lower() in DIRECTIVES and not {"<", ">"} & set(key + value) else None for _, key, colon, value in lines]
    if not any(known) and any(key or colon for _, key, colon, _ in lines):
        return [], "robots.parse_error"
    # one letter a line: agents, what follows them, blank lines that end a group; other lines are none
    seen = [(" ", "", "") if not raw.strip() else (_LETTER.get(found[0], ""), *found) if found else ("", "", "") for (raw, *_), found in zip(lines, known, strict=True)]
    seen = [x for x in seen if x[0]]
    groups = []
    for m in re.finditer("(a+)([ro]+)", "".join(x[0] for x in seen)):
        agents, asked = seen[m.start(1) : m.end(1)], seen[m.start(2) : m.end(2)]
        groups.append(([value.lower() for *_, value in agents], [(key == "allow" or not value, quote(value)) for letter, key, value in asked if letter == "r"]))
    # the catch-all group is asked last, the first of its kind counts
    named = [g for g in groups if "*" not in g[0]] + [g for g in groups if "*" in g[0]][:1]
    # a group without rules still answers for its agents: all is allowed
    return [{"grp": i, "agents": a, "ord": j, "allow": ok, "path": p} for i, (a, ls) in enumerate(named) for j, (ok, p) in enumerate(ls or [(True, "")])], None


@struct_udf("rules array<struct<grp:int,agents:array<string>,ord:int,allow:boolean,path:string>>, code string")
def rules_udf(text: pd.Series, mime: pd.Series) -> list:
    return [rules(t, m) for t, m in zip(text, mime, strict=True)]


def policies(files: DataFrame) -> DataFrame:
    """(origin, status, code, rules) of files(origin, status, error, mime, body): one policy an origin.  Bodies are texts, or bytes in UTF-8 or, by their mark, UTF-16."""
    mapped = F.lit(None).cast("string")
    for code, out in NETWORK_CODES.items():
        mapped = F.when(F.col("error") == code, out).otherwise(mapped)
    status = F.col("status")
    early = (
        F.when(mapped.isNotNull(), mapped)
        .when(status == 401, "robots.auth_required").when(status == 403, "robots.forbidden")
        .when(status.isin(404, 410), "robots.absent").when(status.isNull() | (status != 200), "robots.http_status")
    )
    got = files.withColumn("_r", rules_udf(F.when(early.isNull(), F.coalesce("body", F.lit("").cast(files.schema["body"].dataType))), F.col("mime")))
    return got.select("origin", "status", F.coalesce(early, F.col("_r.code"), F.lit("robots.allowed")).alias("code"), F.coalesce("_r.rules", F.array().cast("array<struct<grp:int,agents:array<string>,ord:int,allow:boolean,path:string>>")).alias("rules"))


def _target(url: Column) -> Column:
    """Path and query of a canonical URL as rules spell them."""
    rest = F.regexp_extract(url, r"^https?://[^/?#]*([^#]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    coded = F.url_encode(plain)
    for raw, out in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(raw), F.lit(out))
    return F.when(rest == "", "/").otherwise(coded)


def decide(targets: DataFrame, policy: DataFrame, agent: str) -> DataFrame:
    """Adds (status, code, decision) to targets(origin, url, ...): the first rule of the agent's group that starts the path decides.

    Rules are kept with their origin as one array, so an origin of any number of targets is a plain
    equi-join.  An origin without a policy row is undecided and allowed.
    """
    name = agent.split("/")[0].lower()
    joined = targets.join(policy, "origin", "left")
    mine = F.filter("rules", lambda r: F.exists(r["agents"], lambda a: (a == "*") | F.lit(name).contains(a)))
    group = F.array_min(F.transform(mine, lambda r: r["grp"]))
    path = _target(F.col("url"))
    hit = F.filter(mine, lambda r: (r["grp"] == group) & path.startswith(r["path"]))
    denied = F.coalesce(~F.get(hit, F.lit(0))["allow"], F.lit(False))
    code = F.when(F.col("code").isin("robots.auth_required", "robots.forbidden"), F.col("code")).when(denied, "robots.disallowed").otherwise(F.coalesce("code", F.lit("robots.network_error")))
    decision = (
        F.when(code.isin("robots.auth_required", "robots.forbidden", "robots.disallowed"), "denied")
        .when(code == "robots.absent", "absent").when(code == "robots.allowed", "allowed").otherwise("unknown_allow")
    )
    return joined.select(*targets.columns, "status", code.alias("code"), decision.alias("decision"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
