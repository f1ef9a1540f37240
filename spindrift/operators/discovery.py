"""Link, navigation, feed and sitemap discovery over columns of page bodies.

HTML and XML need real parsers, so each page is parsed once in an Arrow UDF that returns arrays; all
ordering, cutting, merging and routing is done with array functions on the result.  A discovery is
``struct<candidates, total, coverage, code>``: candidates are distinct and sorted, cut at the limit;
coverage is told from the number before the cut; code is set when there are none.
"""

from __future__ import annotations

import re
import sys
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import page as pg
from spindrift.functions import urls
from spindrift.functions.arrow import struct_udf
from spindrift.functions.identity import HTML_TYPES

LIMIT = 100
# MIME types that may hold a feed, and those that may hold a sitemap.
FEED_TYPES = ("application/atom+xml", "application/rss+xml", "application/xml", "text/xml")
SITEMAP_TYPES = ("application/xml", "text/xml")
_REFRESH = re.compile(r"(?:^|;)\s*url\s*=\s*(['\"]?)(.*?)\1\s*$", re.I)


def _resolve(base: str, href: str, keep_fragment: bool) -> str | None:
    full = urls.join(base, href.strip())
    if full is None:
        return None
    return urls.valid_candidate(full if keep_fragment else full.split("#", 1)[0])


def page_links(url: str | None, html: str | None) -> tuple:
    """([(candidate, download)] sorted, refresh targets, download targets) of one page; the last two keep fragments, and so lose URLs that have one."""
    if url is None or html is None:
        return [], [], [], False, False
    tape = pg.events(html)
    first = next((a["href"] for _, a in pg.opened(tape, "base") if a.get("href")), None)
    base = urls.join(url, first) or url if first else url
    links = [(a["href"], tag == "a" and "download" in a) for tag, a in pg.opened(tape, "a", "area", "link") if a.get("href")]
    targets = (_REFRESH.search(a.get("content") or "") for _, a in pg.opened(tape, "meta") if (a.get("http-equiv") or "").casefold() == "refresh")
    refresh = [m[2] for m in targets if m and m[2]]
    downloads = [href for href, saved_mark in links if saved_mark]
    saved: dict[str, bool] = {}
    for href, download in links:
        found = _resolve(base, href, keep_fragment=False)
        if found:
            saved[found] = saved.get(found, False) or download
    def explicit(hrefs):
        return sorted({c for c in (_resolve(base, h, keep_fragment=True) for h in hrefs) if c})

    return [{"url": u, "download": d} for u, d in sorted(saved.items())], explicit(refresh), explicit(downloads), bool(refresh), bool(downloads)


@struct_udf("links array<struct<url:string,download:boolean>>, refresh array<string>, downloads array<string>, has_refresh boolean, has_downloads boolean")
def links_udf(url: pd.Series, html: pd.Series) -> list:
    return [page_links(u, h) for u, h in zip(url, html, strict=True)]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].casefold()


def _tree(text: str):
    """The root of an XML text without declarations of any kind, None if it is malformed or has some."""
    body = text.encode()
    guard = expat.ParserCreate()

    def refuse(*_):
        raise ValueError

    guard.StartDoctypeDeclHandler = guard.EntityDeclHandler = refuse
    try:
        guard.Parse(body, True)
        return ElementTree.fromstring(body)
    except (expat.ExpatError, ElementTree.ParseError, ValueError):
        return None


def feed_links(url: str | None, text: str | None) -> tuple:
    """(sorted entry URLs, code) of an RSS, RDF or Atom text."""
    root = _tree(text) if text is not None and url is not None else None
    if root is None or _local(root.tag) not in ("feed", "rss", "rdf"):
        return [], "discovery.feed_malformed"
    found = set()
    for node in root.iter():
        kind = _local(node.tag)
        for link in node if kind in ("entry", "item") else ():
            if _local(link.tag) != "link" or kind == "entry" and link.get("rel", "alternate") not in ("", "alternate"):
                continue
            raw = ((link.get("href") if kind == "entry" else link.text) or "").strip()
            full = urls.join(url, raw) if raw else None
            found.add(urls.valid_candidate(full) if full else None)
    return sorted(found - {None}), None


def sitemap_links(url: str | None, text: str | None) -> tuple:
    """(sorted locations, code) of a urlset or sitemapindex text; each row's first non-empty location."""
    root = _tree(text) if text is not None and url is not None else None
    row = {"urlset": "url", "sitemapindex": "sitemap"}.get(_local(root.tag)) if root is not None else None
    if row is None:
        return [], "discovery.feed_malformed"
    found = set()
    for node in root:
        texts = [(c.text or "").strip() for c in node if _local(c.tag) == "loc"] if _local(node.tag) == row else []
        full = urls.join(url, next((t for t in texts if t), "")) if any(texts) else None
        found.add(urls.valid_candidate(full) if full else None)
    return sorted(found - {None}), None


@struct_udf("links array<string>, code string")
def feed_udf(url: pd.Series, text: pd.Series) -> list:
    return [feed_links(u, t) for u, t in zip(url, text, strict=True)]


@struct_udf("links array<string>, code string")
def sitemap_udf(url: pd.Series, text: pd.Series) -> list:
    return [sitemap_links(u, t) for u, t in zip(url, text, strict=True)]


def discovery(candidates: Column, limit: int = LIMIT, code: Column | None = None) -> Column:
    """The discovery struct of an ordered array of distinct candidates."""
    total = F.size(candidates)
    failed = F.coalesce(code, F.when(total == 0, F.lit("discovery.no_candidates"))) if code is not None else F.when(total == 0, F.lit("discovery.no_candidates"))
    return F.struct(
        F.slice(candidates, 1, limit).alias("candidates"),
        total.alias("total"),
        F.when(failed.isNotNull(), None).when(total > limit, "truncated").otherwise("complete").alias("coverage"),
        failed.alias("code"),
    )


def html_links(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``found``, the discovery of ordinary links, to pages(url, html, mime, ...); links off the page's origin stay."""
    got = pages.withColumn("_l", links_udf("url", F.when(F.col("mime").isin(*HTML_TYPES), F.col("html"))))
    unsupported = F.when(~F.col("mime").isin(*HTML_TYPES), "discovery.mime_unsupported")
    return got.withColumn("found", discovery(F.transform("_l.links", lambda x: x["url"]), limit, unsupported)).drop("_l")


def html_file_links(pages: DataFrame, origins: Column, paths: Column, limit: int = LIMIT) -> DataFrame:
    """As ``html_links``, but in-scope links of the page's host that are marked for download or end in .pdf come first."""
    got = pages.withColumn("_l", links_udf("url", F.when(F.col("mime").isin(*HTML_TYPES), F.col("html"))))
    host = urls.site_key(F.col("url"))

    def preferred(x):
        u = x["url"]
        hint = x["download"] | F.lower(urls.path_of(u)).endswith(".pdf")
        return hint & (urls.site_key(u) == host) & F.array_contains(origins, urls.origin(u)) & urls.included(urls.path_of(u), paths)

    links = F.col("_l.links")
    ordered = F.concat(F.filter(links, preferred), F.filter(links, lambda x: ~preferred(x)))
    return got.withColumn("found", discovery(F.transform(ordered, lambda x: x["url"]), limit)).drop("_l")


def html_navigation(pages: DataFrame, origins: Column, paths: Column) -> DataFrame:
    """Adds ``found``: in-scope refresh targets, else in-scope download targets, else the one in-scope link of a complete page that has neither mark."""
    got = pages.withColumn("_l", links_udf("url", F.when(F.col("mime").isin(*HTML_TYPES), F.col("html"))))
    scoped = lambda a: F.filter(a, lambda u: F.array_contains(origins, urls.origin(u)) & urls.included(urls.path_of(u), paths))
    ordinary = F.transform("_l.links", lambda x: x["url"])
    single = F.when((F.size(ordinary) <= LIMIT) & (F.size(scoped(ordinary)) == 1), scoped(ordinary)).otherwise(F.array().cast("array<string>"))
    chosen = F.when(F.col("_l.has_refresh"), scoped(F.col("_l.refresh"))).when(F.col("_l.has_downloads"), scoped(F.col("_l.downloads"))).otherwise(single)
    unsupported = F.when(~F.col("mime").isin(*HTML_TYPES), "discovery.mime_unsupported")
    return got.withColumn("found", discovery(chosen, 1 << 30, unsupported)).drop("_l")


def feed_entries(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``found``, the discovery of feed entries, to pages(url, html, mime, ...)."""
    ok = F.col("mime").isin(*FEED_TYPES)
    got = pages.withColumn("_l", feed_udf("url", F.when(ok, F.col("html"))))
    return got.withColumn("found", discovery(F.col("_l.links"), limit, F.when(~ok, "discovery.mime_unsupported").otherwise(F.col("_l.code")))).drop("_l")


def sitemap_entries(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``found``, the discovery of sitemap locations, to pages(url, html, mime, ...)."""
    ok = F.col("mime").isin(*SITEMAP_TYPES)
    got = pages.withColumn("_l", sitemap_udf("url", F.when(ok, F.col("html"))))
    return got.withColumn("found", discovery(F.col("_l.links"), limit, F.when(~ok, "discovery.mime_unsupported").otherwise(F.col("_l.code")))).drop("_l")


def tools_for(mime: Column, files: Column) -> Column:
    """The discovery tools that a stored body of a MIME type is given to, in order; ``files`` asks for file links first."""
    html = F.when(files, F.array(F.lit("discovery.html_file_links"), F.lit("discovery.html_links"))).otherwise(F.array(F.lit("discovery.html_links")))
    return (
        F.when(mime.isin(*HTML_TYPES), html)
        .when(mime.isin("application/rss+xml", "application/atom+xml"), F.array(F.lit("discovery.rss")))
        .when(mime.isin("application/xml", "text/xml"), F.array(F.lit("discovery.rss"), F.lit("discovery.sitemap")))
        .otherwise(F.array().cast("array<string>"))
    )


def merge_candidates(found: DataFrame) -> DataFrame:
    """One row a (site, candidate) of found(site, candidate, tool_id, tool_version, source): its least recipe; a source is no candidate of itself."""
    recipe = F.struct("tool_id", "tool_version", "source")
    best = found.where(~F.col("candidate").eqNullSafe(F.col("source"))).groupBy("site", "candidate").agg(F.min(recipe).alias("r"))
    return best.select("site", "candidate", "r.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
