"""Operators on hand-made rows: URL rules, discovery, robots, quality, Markdown, framing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import identity, safety, urls
from spindrift.operators import discovery, evidence, flows, markdown, quality, robots

URLS = [
    ("HTTPS://EXAMPLE.TEST:443/a/%7e", "https://example.test/a/~", None),
    ("http://example.test", "http://example.test/", None),
    ("http://example.test:8080/x?q=a%2fb", "http://example.test:8080/x?q=a%2Fb", None),
    ("http://example.test:80/", "http://example.test/", None),
    ("https://bücher.test/ü", "https://xn--bcher-kva.test/%C3%BC", None),
    ("https://[2001:DB8::1]/", "https://[2001:db8::1]/", None),
    ("https://e.test/#x", None, "scope.url_fragment"),
    ("https://u:p@e.test/", None, "scope.url_userinfo"),
    ("ftp://e.test/", None, "scope.url_invalid"),
    ("https://e.test/a b", None, "scope.url_invalid"),
    (" https://e.test/", None, "scope.url_invalid"),
    ("https://e.test/../x", None, "scope.path_escape"),
    ("https://e.test/%252e%252e/x", None, "scope.path_escape"),
    ("https://e.test/%zz", None, "scope.path_invalid"),
    ("https://e.test/?q=ü", None, "scope.query_invalid"),
    ("https://e.test:0/", None, "scope.url_invalid"),
    ("https://-bad.test/", None, "scope.url_invalid"),
    ("", None, "scope.url_invalid"),
    (None, None, None),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)], "i int, u string")
    got = {r.i: (r.c.url, r.c.code) for r in df.select("i", urls.canonical(F.col("u")).alias("c")).collect()}
    assert [got[i] for i in range(len(URLS))] == [(u, c) for _, u, c in URLS]


def test_fast_and_general_form_agree(spark):
    df = spark.createDataFrame([(u,) for u in ("http://a.test/x/", "https://b.c.test/q?x=1&y=2", "https://a.test/./x", "https://1.2.3/", "http://a.test#f", "https://a.test/?")], "u string")
    rows = df.select("u", urls.canonical(F.col("u")).alias("c")).collect()
    assert {r.u: (r.c.url, r.c.code) for r in rows} == {r.u: urls.canonical_parts(r.u) for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB/.%?=#&:@ 0279[]üß\\\\-~+,*", max_size=24), st.sampled_from(["http://", "https://e.test", "HTTP://E.test:80/", "https://e.test/?"]))
def test_canonical_form_is_canonical(tail, head):
    url, code = urls.canonical_parts(head + tail)
    assert (url is None) != (code is None)
    if url is not None:
        assert urls.canonical_parts(url) == (url, None)
        assert "#" not in url and all(32 < ord(c) < 127 for c in url)


def test_include_patterns():
    assert urls.canonical_pattern("/a/**") == ("/a/**", None)
    assert urls.canonical_pattern("/**") == ("/**", None)
    assert urls.canonical_pattern("/a*") == (None, "scope.path_invalid")
    assert urls.canonical_pattern("/a/../b") == (None, "scope.path_escape")


def test_redaction(spark):
    rows = [("https://e.test/a?x=1", "https://e.test/a?query-sha256="), ("https://u@e.test/", "[redacted-url]"), ("no url", "[invalid-url]"), (None, "[invalid-url]"), ("https://e.test/a#f", "https://e.test/a")]
    df = spark.createDataFrame([(u,) for u, _ in rows], "u string").select(urls.redacted(F.col("u")).alias("r"))
    for r, (_, start) in zip(df.collect(), rows, strict=True):
        assert r.r.startswith(start)


def test_artifact_id_is_the_published_one(spark):
    got = spark.range(1).select(identity.artifact_id(F.lit("a" * 64), F.lit("text/html"), F.lit("source")).alias("x")).first().x
    assert got == "artifact-5812af58b8c7fcda8129803e00b509c79c011f554a3bdabb4681948053ba85d8"


def test_times_paths_versions(spark):
    r = spark.range(1).select(
        identity.utc_valid(F.lit("2024-02-29T00:00:00Z")).alias("a"), identity.utc_valid(F.lit("2024-02-30T00:00:00Z")).alias("b"), identity.utc_valid(F.lit("2024-02-29T00:00:00+00:00")).alias("c"),
        identity.portable_path(F.lit("blobs/aa/x.blob")).alias("d"), identity.portable_path(F.lit("../x")).alias("e"), (identity.version_key(F.lit("1.10.0")) > identity.version_key(F.lit("1.9.9"))).alias("f"),
    ).first()
    assert tuple(r) == (True, False, False, True, False, True)


def page(spark, html, url="https://e.test/d/p", mime="text/html"):
    return spark.createDataFrame([(url, html, mime, "source")], "url string, html string, mime string, role string")


def test_links_are_sorted_distinct_and_cut(spark):
    html = '<base href="/b/"><a href="z#f">z</a><a href="z">z</a><area href="/a?x=1&amp;y=2"><a href="mailto:x@y">m</a><a href="">e</a><a href="//o.test/q">o</a>'
    r = discovery.html_links(page(spark, html), limit=2).first().found
    assert r.candidates == ["https://e.test/a?x=1&y=2", "https://e.test/b/z"] and r.total == 3 and r.coverage == "truncated"
    r = discovery.html_links(page(spark, html), limit=3).first().found
    assert len(r.candidates) == 3 and r.coverage == "complete"


def test_links_without_candidates_or_html(spark):
    assert discovery.html_links(page(spark, "<script>var x='<a href=\"/q\">';</script><!-- <a href='/c'> -->")).first().found.code == "discovery.no_candidates"
    assert discovery.html_links(page(spark, "<a href='/q'>", mime="text/plain")).first().found.code == "discovery.mime_unsupported"
    assert discovery.html_links(page(spark, None)).first().found.code == "discovery.no_candidates"


def test_sitemap_counts_before_the_cut(spark):
    xml = "<urlset>" + "".join(f"<url><loc>https://e.test/{i:03d}</loc></url>" for i in [*range(102), 0]) + "</urlset>"
    r = discovery.sitemap_entries(page(spark, xml, mime="application/xml")).first().found
    assert len(r.candidates) == 100 and r.total == 102 and r.coverage == "truncated"


def test_feeds_refuse_declarations(spark):
    r = discovery.feed_entries(page(spark, '<!DOCTYPE rss [<!ENTITY x "y">]><rss/>', mime="text/xml")).first().found
    assert r.code == "discovery.feed_malformed"
    assert discovery.feed_entries(page(spark, "<rss><channel/></rss>", mime="text/xml")).first().found.code == "discovery.no_candidates"


ROBOTS = [
    (200, None, "User-agent: *\nDisallow: /p\n", "denied", "robots.disallowed"),
    (200, None, "User-agent: *\nDisallow: /p\nAllow: /p\n", "denied", "robots.disallowed"),
    (200, None, "User-agent: *\nAllow: /p\nDisallow: /\n", "allowed", "robots.allowed"),
    (200, None, "User-agent: spindrift\nDisallow:\n\nUser-agent: *\nDisallow: /\n", "allowed", "robots.allowed"),
    (200, None, "User-agent: other\nDisallow: /\n", "allowed", "robots.allowed"),
    (200, None, "User-agent: *\nDisallow: /p?x=1\n", "allowed", "robots.allowed"),
    (200, None, "User-agent: *\nDisallow: /*\n", "allowed", "robots.allowed"),
    (200, None, "", "allowed", "robots.allowed"),
    (200, None, "nothing here", "unknown_allow", "robots.parse_error"),
    (200, None, "<!DOCTYPE html><html>", "unknown_allow", "robots.parse_error"),
    (401, None, None, "denied", "robots.auth_required"),
    (403, None, None, "denied", "robots.forbidden"),
    (404, None, None, "absent", "robots.absent"),
    (410, None, None, "absent", "robots.absent"),
    (503, None, None, "unknown_allow", "robots.http_status"),
    (None, "gateway.dns", None, "unknown_allow", "robots.dns_error"),
]


def test_robots_matrix(spark):
    files = spark.createDataFrame([(f"https://h{i}.test", s, e, "text/plain", b) for i, (s, e, b, _, _) in enumerate(ROBOTS)], "origin string, status int, error string, mime string, body string")
    targets = files.select("origin", F.concat("origin", F.lit("/p")).alias("url"))
    got = {r.origin: (r.decision, r.code) for r in robots.decide(targets, robots.policies(files), "spindrift/1.0").collect()}
    assert [got[f"https://h{i}.test"] for i in range(len(ROBOTS))] == [(d, c) for *_, d, c in ROBOTS]


BODIES = [
    (" ", "acquisition.empty"),
    ("<div class='g-recaptcha'>", "acquisition.interaction_required"),
    ("<input type='password'>", "acquisition.auth_required"),
    ("<INPUT TYPE=PASSWORD>", "acquisition.auth_required"),
    ("<i id='cf-chl-x'>", "acquisition.cloudflare_blocked"),
    ("<title>Checking your browser</title>", "acquisition.challenge"),
    ("<p>Authentication\n required</p>", "acquisition.auth_required"),
    ("<p>Permission denied</p>", "acquisition.permission_denied"),
    ("<p>Internal Server Error</p>", "acquisition.error_page"),
    ("<script>x</script>", "acquisition.script_only"),
    ("<head><title>t</title></head>", "acquisition.empty"),
    ('<meta http-equiv="refresh" content="0;url=/x">', "runtime.quality_minimum_words"),
    ("<p>one two</p>", "runtime.quality_minimum_words"),
    ("<p>one two three</p>", None),
]


def test_quality_cascade(spark):
    df = spark.createDataFrame([(i, b, "text/html") for i, (b, _) in enumerate(BODIES)], "i int, html string, mime string")
    got = {r.i: r.code for r in quality.quality(df, minimum_words=3).collect()}
    assert [got[i] for i in range(len(BODIES))] == [c for _, c in BODIES]
    off = quality.quality(df.limit(1), allowed=F.array(F.lit("text/plain"))).first()
    assert off.code == "runtime.quality_mime_mismatch"


MARKDOWN = [
    ("<h1>A</h1><p>one <b>two</b> three four five</p>", "# A\n\none **two** three four five\n", None),
    ("<p>a b c d e <i>f</p>", None, "transform.html_invalid"),
    ("<p>one two</p>", None, "transform.ineligible_quality"),
    ("<div>" * 65 + "a b c d e", None, "transform.ineligible_complex"),
    ("<blockquote><p>a b c d e</p></blockquote><pre>x  y</pre>", "> a b c d e\n\n```\nx  y\n```\n", None),
    ("<nav>no</nav><p style='display: none'>no</p><p>a b c d e</p>", "a b c d e\n", None),
    ("<p>a b c d <a href='x'>e</a> <img src='i.png' alt='I'></p>", "a b c d [e](https://e.test/d/x)![I](https://e.test/d/i.png)\n", None),
]


def test_markdown(spark):
    df = spark.createDataFrame([(i, "https://e.test/d/p", h, "text/html", "source") for i, (h, _, _) in enumerate(MARKDOWN)], "i int, url string, html string, mime string, role string")
    got = {r.i: (r.markdown, r.code) for r in markdown.markdown(df).collect()}
    assert [got[i] for i in range(len(MARKDOWN))] == [(m, c) for _, m, c in MARKDOWN]


@pytest.mark.parametrize("text, code", [("password = x", "result.sensitive_data"), ("%70assword%3Dx", "result.sensitive_data"), ("see /home/me", "result.absolute_path"), ("C:\\x", "result.absolute_path"), ("a​b", "result.sensitive_data"), ("fine", None), ("", None), (None, None)])
def test_safety(text, code):
    assert safety.safety_code(text) == code


@pytest.mark.parametrize("text, code", [("https://e.test/a", None), ("https://e.test:99999/", "url.invalid"), ("https://u%40e.test/", "result.sensitive_data"), ("https://e.test/%zz", "url.invalid"), ("http://-e.test/", "url.invalid"), ("https://1.2.3.999/", "url.invalid"), ("https://[::1]:8/", None), ("https://e.test/\\\\x", "url.invalid")])
def test_urls_in_texts(text, code):
    assert safety.safety_code(text) == code


@pytest.mark.parametrize("name, secret", [("pass%77ord", True), ("%74oken", True), ("%2574oken", True), ("%252574oken", True), ("ｐａｓｓｗｏｒｄ", True), ("pa%ﬀ", False), ("%zz%61pi-key", True), ("monkey", False), ("mon%6bey", False), (None, False), ("𝐭oken", True)])
def test_secret_keys_in_other_spellings(spark, name, secret):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(safety.secret_key(F.col("name")).alias("s")).first().s == secret
    assert name is None or safety._secret_name(name) == secret


def test_payloads_are_searched_at_any_depth():
    assert safety.payload_code('{"a": [{"b": {"api-key": 1}}]}') == "result.sensitive_data"
    assert safety.payload_code('{"a": [[["/home/me"]]]}') == "result.absolute_path"
    assert safety.payload_code('{"a": 1.5}') == safety.payload_code("{") == "schema.invalid"
    assert safety.payload_code('{"a": [null, true, 3, "x"]}') is None and safety.payload_code(None) is None


def test_paths_are_decoded_until_nothing_changes(spark):
    deep = "/a/" + "%" + "25" * 9 + "62"
    rows = [(deep, True), ("/a%2Fb", True), ("/a/c", False), ("/a+b", False)]
    got = spark.createDataFrame(rows, "p string, ok boolean").select("ok", urls.included(F.col("p"), F.array(F.lit("/a/b"))).alias("x")).collect()
    assert [r.x for r in got] == [r.ok for r in got]


def test_references_are_resolved_like_the_parser_does(spark):
    base = "https://e.test/d/p?x=1"
    refs = ["https://f.test/x", "/a/b", "//g.test/", "c", "../c", "?q", "#f", "", "/a/../b", "http:/x", "https://[", None]
    got = spark.createDataFrame([(r,) for r in refs], "r string").select(urls.resolved(F.lit(base), F.col("r")).alias("u")).collect()
    assert [r.u for r in got] == [None if r is None else urls.join(base, r) for r in refs]


@pytest.mark.parametrize("ip, public", [("2606:4700::1111", True), ("::1", False), ("fe80::1", False), ("ff02::1", False), ("2001:db8::1", False), ("8.8.8.8", True), ("::ffff:10.0.0.1", False), ("x:y", False), (None, False)])
def test_addresses_of_both_versions(spark, ip, public):
    assert bool(spark.createDataFrame([(ip,)], "ip string").select(evidence.public_ip(F.col("ip")).alias("p")).first().p) == public


def test_robots_bytes_are_decoded_by_their_mark(spark):
    text = "User-agent: *\nDisallow: /é\n"
    files = spark.createDataFrame([(f"https://h{i}.test", 200, None, "text/plain", b) for i, b in enumerate([text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16")])], "origin string, status int, error string, mime string, body binary")
    assert [[r["path"] for r in p.rules] for p in robots.policies(files).orderBy("origin").collect()] == [["/%C3%A9"]] * 3


def test_navigation_of_many_starts_and_endings(spark):
    starts = spark.range(40_000).select(F.concat(F.lit("s"), "id").alias("url"))
    edges = starts.select("url", F.lit(1).alias("n"), F.lit("hub").alias("target")).unionByName(spark.createDataFrame([("hub", 1, "end"), ("l0", 1, "l1"), ("l1", 1, "l0"), ("m", 2, "x")], "url string, n int, target string"))
    more = spark.createDataFrame([("l0",), ("m",), ("end",)], "url string")
    got = flows.navigate(starts.unionByName(more), edges)
    assert {(r.stop_reason, r.final_url, r.hops): r.n for r in got.groupBy("stop_reason", "final_url", "hops").agg(F.count("*").alias("n")).collect()} == {("terminal_html", "end", 2): 40_000, ("terminal_html", "end", 0): 1, ("navigation_loop", "l1", 1): 1, ("multiple_navigation_targets", "m", 0): 1}
