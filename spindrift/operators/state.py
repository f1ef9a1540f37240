"""Site state snapshots and their six-way comparison."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_state(observed: DataFrame, order: Column) -> DataFrame:
    """(site_key, canonical_url, observation_id, artifact_id, content_digest): the first page by ``order`` of each URL on its own site."""
    first = F.min_by(F.struct("observation_id", "artifact_id", "content_digest"), order).alias("p")
    return observed.groupBy("site_key", "canonical_url").agg(first).select("site_key", "canonical_url", "p.*")


def failed_urls(attempts: DataFrame) -> DataFrame:
    """(url, attempt_ids, codes) of attempts(url, attempt_id, outcome, code): URLs that failed with an error and never succeeded."""
    ok = attempts.where("outcome = 'succeeded'").select("url").distinct()
    bad = attempts.where("outcome = 'failed' and code is not null").join(ok, "url", "left_anti")
    return bad.groupBy("url").agg(F.array_sort(F.collect_set("attempt_id")).alias("attempt_ids"), F.array_sort(F.collect_set("code")).alias("codes"))


def diff(previous: DataFrame, current: DataFrame, failed: DataFrame, complete: bool, key: str = "canonical_url", by: tuple[str, ...] = ()) -> DataFrame:
    """(url, change_type, previous_digest, current_digest) over previous and current (key, content_digest) and failed(url).

    The columns ``by`` of previous and current tell pages with the same key apart and are in the result, null where unknown.

    added, changed, unchanged by the current page; else failed if its attempts failed; else missing after
    a complete refresh, unresolved after an incomplete one.  One full outer and one full outer join.
    """
    p = previous.select(F.col(key).alias("url"), F.col("content_digest").alias("previous_digest"), *by)
    c = current.select(F.col(key).alias("_url"), F.col("content_digest").alias("current_digest"), *[F.col(b).alias(f"_{b}") for b in by])
    f = failed.select("url").distinct().withColumn("_failed", F.lit(True))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.col("url") == F.col("_url"))
    pages = p.join(c, same, "full_outer").select("previous_digest", "current_digest", *[F.coalesce(b, f"_{b}").alias(b) for b in ("url", *by)])
    both = pages.join(f, "url", "full_outer")
    kind = (
        F.when(F.col("current_digest").isNotNull() & F.col("previous_digest").isNull(), "added")
        .when(F.col("current_digest") == F.col("previous_digest"), "unchanged")
        .when(F.col("current_digest").isNotNull(), "changed")
        .when(F.col("_failed"), "failed")
        .otherwise("missing" if complete else "unresolved")
    )
    return both.select("url", kind.alias("change_type"), "previous_digest", "current_digest", *by)


def state_digest(state: DataFrame) -> DataFrame:
    """(site_key, n_pages, digest): the sha256 of each site's sorted pages."""
    page = F.to_json(F.struct("artifact_id", "canonical_url", "content_digest", "observation_id"))
    pages = F.array_sort(F.collect_list(F.struct("canonical_url", page.alias("j"))))
    body = F.concat(F.lit("["), F.array_join(F.transform(pages, lambda x: x["j"]), ","), F.lit("]"))
    return state.groupBy("site_key").agg(F.count("*").alias("n_pages"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("digest"))


def merge_recovered(recovered: DataFrame, prior: DataFrame) -> DataFrame:
    """Pages of both states (canonical_url, ...); a recovered page wins over the prior one."""
    rest = prior.join(recovered.select("canonical_url"), "canonical_url", "left_anti")
    return recovered.unionByName(rest)


def coverage_gaps(expected: DataFrame, terminal: DataFrame, discovered: DataFrame) -> DataFrame:
    """(url, gap): expected URLs without a terminal attempt, discovered ones that nobody expected."""
    a = expected.join(terminal, "url", "left_anti").select("url", F.lit("not_attempted").alias("gap"))
    return a.unionByName(discovered.join(expected, "url", "left_anti").select("url", F.lit("not_expected").alias("gap")))
