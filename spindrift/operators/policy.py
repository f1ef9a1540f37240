"""Requests and authority: scopes, budgets, admission, narrowing, response gates and identifiers.

All of it is built-in expressions over columns, so it can stand in a filter before any parsing.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import identity, urls
from spindrift.functions.arrow import struct_udf

BUDGETS = ("max_requests", "max_bytes", "max_runtime_seconds", "max_tool_attempts_per_target")
# The most that any request is admitted.
ADMISSION = {"max_requests": 100, "max_bytes": 104_857_600, "max_runtime_seconds": 600, "max_tool_attempts_per_target": 4}
# The forms of identifiers.
TOOL_ID = r"^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*$"
VERSION = r"^(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)$"
SAFE_CODE = r"^[a-z][a-z0-9_]*(?:[.-][a-z0-9_]+)*$"
OBSERVATION_ID = r"^observation-[0-9a-f]{32}$"
DIGEST = r"^sha256:[0-9a-f]{64}$"


def matches(value: Column, form: str, longest: int = 1 << 30) -> Column:
    return F.coalesce(value.rlike(form) & (F.length(value) <= longest), F.lit(False))


@struct_udf("pattern string, code string")
def _pattern_udf(text: pd.Series) -> list:
    return [urls.canonical_pattern(t) if t is not None else (None, "scope.path_invalid") for t in text]


def origin_of(url: Column) -> Column:
    """struct<origin, code> of a text that should be a bare origin."""
    c = urls.canonical(url)
    bare = F.coalesce(url.rlike(r"^[^/?#]*://[^/?#]*/?$"), F.lit(False))
    own = c["code"].isin("scope.url_userinfo", "scope.url_fragment")
    code = F.when(url.contains("#") | ~bare, "scope.origin_invalid").when(own, c["code"]).when(c["url"].isNull(), "scope.origin_invalid")
    return F.struct(F.when(code.isNull(), urls.origin(c["url"])).alias("origin"), code.alias("code"))


def validate_scopes(scopes: DataFrame) -> DataFrame:
    """(scope_id, code, seeds, origins, paths) of scopes(scope_id, seeds, origins, paths, kinds): canonical lists, or the first failing rule's code.

    Lists are taken apart, judged by row and put together again in their order.
    """
    def judged(name: str, column, value: str):
        rows = scopes.select("scope_id", F.posexplode(name).alias("i", "x")).withColumn("c", column(F.col("x")))
        listed = F.array_sort(F.collect_list(F.struct("i", F.col(f"c.{value}").alias("v"), F.col("c.code").alias("e"))))
        return rows.groupBy("scope_id").agg(listed.alias(f"_{name}"))

    got = scopes.select("scope_id", "kinds")
    for name, column, value in (("seeds", urls.canonical, "url"), ("origins", origin_of, "origin"), ("paths", _pattern_udf, "pattern")):
        got = got.join(judged(name, column, value), "scope_id", "left")
    values = lambda n: F.transform(f"_{n}", lambda x: x["v"])
    first_error = lambda n: F.get(F.filter(F.transform(f"_{n}", lambda x: x["e"]), lambda e: e.isNotNull()), F.lit(0))
    twice = lambda a: F.size(a) != F.size(F.array_distinct(a))
    seeds, origins, paths = values("seeds"), values("origins"), values("paths")
    code = (
        F.when(F.col("_seeds").isNull(), "scope.empty_seeds").when(first_error("seeds").isNotNull(), first_error("seeds"))
        .when(F.col("_origins").isNull(), "scope.empty_allowed_origins").when(first_error("origins").isNotNull(), first_error("origins"))
        .when(F.col("_paths").isNull(), "scope.empty_include_paths").when(first_error("paths").isNotNull(), first_error("paths"))
        .when(F.coalesce(F.size("kinds"), F.lit(0)) <= 0, "scope.empty_content_types").when(~F.forall("kinds", lambda k: F.coalesce(k.isin("html", "file"), F.lit(False))), "scope.content_type_invalid")
        .when(twice(seeds) | twice(origins) | twice(paths) | twice(F.col("kinds")), "scope.duplicate")
        .when(~F.forall(seeds, lambda s: F.array_contains(origins, urls.origin(s))), "scope.origin_not_allowed")
        .when(~F.forall(seeds, lambda s: urls.included(urls.path_of(s), paths)), "scope.path_not_included")
    )
    return got.select("scope_id", code.alias("code"), seeds.alias("seeds"), origins.alias("origins"), paths.alias("paths"))


def budgets_valid(prefix: str = "") -> Column:
    out = F.lit(True)
    for b in BUDGETS:
        out = out & F.coalesce(F.col(prefix + b) > 0, F.lit(False))
    return out


def budgets_within(narrow: str, wide: str) -> Column:
    out = F.lit(True)
    for b in BUDGETS:
        out = out & (F.col(narrow + b) <= F.col(wide + b))
    return out


def admitted(requests: DataFrame, maxima: dict[str, int] | None = None) -> DataFrame:
    """Requests with each budget clamped to the admission maxima."""
    return requests.withColumns({b: F.least(F.col(b), F.lit(most)) for b, most in (maxima or ADMISSION).items()})


def policy_code(narrower_scope: Column, narrower_budgets: Column) -> Column:
    return F.when(~narrower_scope, "policy.scope_expansion").when(~narrower_budgets, "policy.budget_expansion")


def decide_budget(amount: Column, limit: Column) -> Column:
    return F.when(amount.isNull() | (amount < 0), "budget.invalid_amount").when(amount > limit, "budget.exceeded").otherwise("policy.allowed")


def decide_kind(kind: Column, allowed: Column) -> Column:
    return F.when(~F.coalesce(kind.isin("html", "file"), F.lit(False)), "scope.content_type_invalid").when(~F.array_contains(allowed, kind), "scope.content_type_not_allowed").otherwise("policy.allowed")


def child_origins(origins: Column, seeds: Column, seed: Column) -> Column:
    """A batch's origins for one of its seeds: those of sibling sites are left out, aliases of none stay."""
    host = lambda u: F.regexp_extract(u, r"^https?://([^/?#:]*)", 1)
    siblings = F.transform(F.filter(seeds, lambda s: host(s) != host(seed)), host)
    return F.filter(origins, lambda o: ~F.array_contains(siblings, host(o)))


def child_run_id(run: Column, index: Column) -> Column:
    """run-site-index while that is at most 96 characters long, else a hash of both."""
    direct = F.concat(run, F.lit("-site-"), index.cast("string"))
    hashed = F.concat(F.lit("batch-"), F.sha2(F.concat(F.length(run).cast("string"), F.lit(":"), run, F.lit(":"), index.cast("string")), 256))
    return F.when(F.length(direct) <= 96, direct).otherwise(hashed)


def fetch_scope(url: Column) -> Column:
    """The scope that fetching one URL compiles to."""
    return F.struct(F.array(url).alias("seeds"), F.array(urls.origin(url)).alias("origins"), F.array(F.lit("/**")).alias("paths"), F.array(F.lit("html"), F.lit("file")).alias("kinds"))


def response_gate(status: Column, header: Column, kinds: Column) -> Column:
    """The code of a response that is not a redirect: status, then media type, then kind; policy.allowed if it may be read."""
    m = identity.media_type(header)
    return F.when(status.between(200, 299), F.coalesce(m["code"], decide_kind(identity.content_kind(m["mime"]), kinds))).when(status.between(500, 599), "gateway.server_error").otherwise("gateway.http_status")


def peer_code(peer: Column, resolved: Column, public: Column) -> Column:
    """Whether the connected peer is one of the resolved addresses and public."""
    return F.when(~F.coalesce(F.array_contains(resolved, peer), F.lit(False)), "gateway.peer_mismatch").when(~public, "gateway.peer_not_public")


def output_rejection(outputs: DataFrame, origins: Column, paths: Column, kinds: Column) -> DataFrame:
    """Adds ``code`` to outputs(urls, downgrade, kind, requests, bytes_received, runtime_ms, max_*): what makes a finished read exceed its authority.

    A downgrade of https first, then the first URL out of scope, the kind, and the budgets; a started second counts whole.
    """
    out = F.get(F.filter("urls", lambda u: ~F.array_contains(origins, urls.origin(u)) | ~urls.included(urls.path_of(u), paths)), F.lit(0))
    scope = F.when(out.isNotNull(), F.when(~F.array_contains(origins, urls.origin(out)), "scope.origin_not_allowed").otherwise("scope.path_not_included"))
    kind = decide_kind(F.col("kind"), kinds)
    code = (
        F.when(F.col("downgrade"), "gateway.https_downgrade").when(scope.isNotNull(), scope).when(kind != "policy.allowed", kind)
        .when(F.col("requests") > F.col("max_requests"), "budget.requests").when(F.col("bytes_received") > F.col("max_bytes"), "budget.bytes")
        .when(F.ceil(F.col("runtime_ms") / 1000) > F.col("max_runtime_seconds"), "budget.runtime")
    )
    return outputs.withColumn("code", code)


def duplicate_keys(text: str | None) -> str | None:
    """'json.invalid' for a text that is no JSON object, 'json.duplicate_key' for one that repeats a key anywhere, else None."""
    import json

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise KeyError
        return dict(pairs)

    try:
        return None if isinstance(json.loads(text or "", object_pairs_hook=once, parse_constant=int), dict) else "json.invalid"
    except KeyError:
        return "json.duplicate_key"
    except ValueError:
        return "json.invalid"


def strict_json(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([duplicate_keys(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def select_candidates(found: DataFrame, most: int) -> DataFrame:
    """(page_id, pos, candidate, source) of found(page_id, candidates, sources): the two lists zipped, sorted, one source a candidate, the first ``most``."""
    pairs = F.array_sort(F.arrays_zip(F.col("candidates").alias("candidate"), F.col("sources").alias("source")))
    kept = F.filter(pairs, lambda p, i: (i == 0) | (F.get(pairs, i - 1)["candidate"] != p["candidate"]))
    rows = found.select("page_id", F.posexplode(F.slice(kept, 1, most)).alias("pos", "p"))
    return rows.select("page_id", (F.col("pos") + 1).alias("pos"), F.col("p.candidate").alias("candidate"), F.col("p.source").alias("source"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
