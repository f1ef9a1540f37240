"""Operators on hand-made rows: store, snapshots, ledgers, tools, jobs, results, streams."""

from pyspark.sql import functions as F

from spindrift.operators import jobs, ledger, results, state, store, tools
from spindrift.sources import fetchlog
from spindrift.streaming import feeds


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_same_bytes_are_one_blob_and_two_observations(spark):
    df = spark.createDataFrame([("r", "https://e.test/a", "2024-01-01T00:00:00Z", "text/html", "source", "x"), ("r", "https://e.test/b", "2024-01-01T00:00:00Z", "text/html", "source", "x"), ("r", "https://e.test/c", "2024-01-01T00:00:00Z", "text/html", "source", None)], "run_id string, source_url string, observed_at string, mime string, role string, body string")
    o = store.observe(df)
    assert store.blobs(o.where("body is not null")).count() == 1
    assert store.artifacts(o.where("body is not null")).count() == 1
    assert o.select("observation_id").distinct().count() == 3
    assert store.blobs(o.limit(0)).count() == 0


def test_verification_codes(spark):
    df = spark.sql("select sha2('x', 256) as sha256, 1L as size_bytes, 'x' as body union all select sha2('x', 256), 1L, 'y' union all select sha2('x', 256), 1L, null")
    assert [r.code for r in store.verified(df).collect()] == [None, "blob.corrupt", "blob.missing"]


STATE = "canonical_url string, content_digest string"


def test_six_way_diff(spark):
    prev = spark.createDataFrame([("same", "1"), ("other", "1"), ("gone", "1"), ("broke", "1"), ("back", "1")], STATE)
    cur = spark.createDataFrame([("same", "1"), ("other", "2"), ("new", "1"), ("back", "1")], STATE)
    failed = spark.createDataFrame([("broke",), ("back",), ("never",)], "url string")
    want = {"same": "unchanged", "other": "changed", "new": "added", "broke": "failed", "never": "failed", "back": "unchanged"}
    for complete, rest in ((True, "missing"), (False, "unresolved")):
        got = {r.url: r.change_type for r in state.diff(prev, cur, failed, complete).collect()}
        assert got == want | {"gone": rest}
    assert state.diff(prev.limit(0), cur.limit(0), failed.limit(0), True).count() == 0


ATTEMPT = "run_id string, ord long, attempt_id string, url string, tool_id string, outcome string, code string, requests long, bytes_received long, runtime_ms long"


def attempts(spark, *spec):
    return spark.createDataFrame([("r", i, f"a{i}", url, tool, outcome, code, *use) for i, (url, tool, outcome, code, use) in enumerate(spec)], ATTEMPT)


OK = ("u", "acquisition.web_http", "succeeded", None, (1, 10, 1000))
SKIP = ("u", "acquisition.web_http", "skipped", None, (0, 0, 0))


def test_exactly_at_the_limit_exhausts_only_an_exploration(spark):
    a = attempts(spark, OK, OK)
    assert rows(ledger.exhausted(a, 2, 100, 10), "explore_exhausted", "refresh_exhausted") == [(True, False)]
    assert rows(ledger.exhausted(a, 1, 100, 10), "explore_exhausted", "refresh_exhausted") == [(True, True)]
    assert rows(ledger.exhausted(a, 3, 100, 10), "explore_exhausted", "refresh_exhausted") == [(False, False)]


def test_dispatch_stops_at_the_first_refusal(spark):
    a = attempts(spark, OK, OK, OK)
    got = ledger.ledger(a, 10, 100, 2)
    assert [r.left_seconds for r in got.orderBy("ord").collect()] == [2, 1, 0]
    assert rows(ledger.dispatched(got), "ord") == [(0,), (1,)]


def test_skipped_attempts_never_count(spark):
    a = attempts(spark, SKIP, OK, SKIP, OK)
    assert rows(ledger.usage(a, "run_id"), "tool_attempts", "requests") == [(2, 2)]
    assert [r.within for r in ledger.capped(a, 1, "url").orderBy("ord").collect()] == [True, True, True, False]
    assert ledger.not_contiguous(a).count() == 0


def test_switching_stops_at_success_and_final_failures(spark):
    bad = ("u", "acquisition.web_http", "failed", "gateway.timeout", (1, 0, 1))
    block = ("u", "acquisition.playwright", "failed", "acquisition.cloudflare_blocked", (1, 0, 1))
    assert rows(ledger.switching(attempts(spark, bad, OK, OK)), "ord") == [(0,), (1,)]
    assert rows(ledger.switching(attempts(spark, bad, block, OK)), "ord") == [(0,), (1,)]


def test_stop_reasons_in_order(spark):
    df = spark.sql("select array('scope.x', 'budget.exhausted', 'runtime.cancelled') as c union all select array('scope.x', 'budget.exhausted') union all select array('scope.x') union all select array('gateway.dns')")
    assert [r.s for r in df.select(ledger.stop_reason(F.col("c"), F.lit(False)).alias("s")).collect()] == ["cancelled", "budget_exhausted", "rejected", "acquisition_failed"]


def test_rollback_and_lineage(spark):
    ev = spark.createDataFrame([("s", 1, "candidate", "a"), ("s", 2, "activate", "a"), ("s", 3, "activate", "b"), ("s", 4, "rollback", "a")], "site_key string, sequence int, action string, to_digest string")
    assert rows(tools.active_skills(ev), "digest", "sequence") == [("a", 4)]
    sk = spark.createDataFrame([("s", 1, "a", None), ("s", 2, "b", "a"), ("s", 3, "c", "x")], "site_key string, version int, digest string, previous_digest string")
    assert rows(tools.lineage_breaks(sk), "version") == [(3,)]
    assert rows(tools.ancestors(sk), "digest", "ancestor", "depth") == [("a", "a", 0), ("b", "a", 1), ("b", "b", 0), ("c", "c", 0), ("c", "x", 1)]


def test_ancestors_of_long_and_circular_lines(spark):
    line = [("s", f"v{i}", f"v{i - 1}" if i else None) for i in range(100)]
    ring = [("r", f"v{i}", f"v{(i + 1) % 3}") for i in range(3)]
    got = tools.ancestors(spark.createDataFrame(line + ring, "site_key string, digest string, previous_digest string")).collect()
    assert sorted((r.digest, r.ancestor, r.depth) for r in got if r.site_key == "s") == sorted((f"v{i}", f"v{j}", i - j) for i in range(100) for j in range(i + 1))
    assert sorted((r.digest, r.ancestor, r.depth) for r in got if r.site_key == "r") == sorted((f"v{i}", f"v{(i + d) % 3}", d) for i in range(3) for d in range(3))


def test_states_go_on_from_batch_to_batch(spark, tmp_path):
    rows = [(i % 3, i, ["submit", "claim", "cancel", "finish"][i // 3 % 4], i * 10, 1) for i in range(12)]
    cols = "job_id long, ord long, op string, at long, token long"
    whole = jobs.claims(spark.createDataFrame(rows, cols)).orderBy("job_id").collect()
    assert [(r.job_id, r.status, r.token, r.n_applied, r.n_stale) for r in whole] == [(j, "failed", 1, 4, 0) for j in range(3)]
    first = jobs.claims(spark.createDataFrame(rows[:5], cols))
    assert jobs.claims(spark.createDataFrame(rows[5:], cols), held=first).orderBy("job_id").collect() == whole

    log = str(tmp_path / "log")
    for part in (rows[:5], rows[5:8], rows[8:]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(log)
    read = feeds._read
    feeds._read = lambda s, path: s.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path)
    try:
        got = feeds._folded(spark, log, "claims", lambda r, held: jobs.claims(r, held=held))
    finally:
        feeds._read = read
    assert got.select(whole[0].__fields__).orderBy("job_id").collect() == whole


def test_transitions(spark):
    ev = spark.createDataFrame([("a", 1, "submitted", "1"), ("a", 2, "running", "2"), ("a", 3, "completed", "3"), ("b", 1, "running", "1"), ("c", 1, "submitted", "2"), ("c", 3, "running", "3"), ("d", 1, "submitted", "2"), ("d", 2, "running", "1")], "job_id string, sequence int, status string, at string")
    assert rows(jobs.illegal_transitions(ev), "job_id", "sequence") == [("b", 1), ("c", 3), ("d", 2)]


def test_batch_completion(spark):
    spec = {"ok": [("completed", False, True)] * 2, "file": [("completed", False, False)] * 2, "no": [("rejected", False, True)] * 2, "mid": [("completed", True, True), ("completed", False, True)], "end": [("completed", False, True), ("partial", True, True)]}
    df = spark.createDataFrame([(b, i, *r) for b, rs in spec.items() for i, r in enumerate(rs)], "batch_id string, pos int, status string, cancelled boolean, file_found boolean")
    exp = spark.createDataFrame([(b, 2) for b in spec], "batch_id string, n_sites int")
    got = {r.batch_id: (r.status, r.stop_reason) for r in jobs.batch_completion(df, exp).collect()}
    assert got == {"ok": ("completed", "source_exhausted"), "file": ("partial", "partial"), "no": ("rejected", "rejected"), "mid": ("invalid", "site_batch.cancellation_order_invalid"), "end": ("partial", "cancelled")}


def test_violations_count_rows(spark):
    got = {r.constraint: r.violations for r in results.violations(none=spark.range(0), two=spark.range(2)).collect()}
    assert got == {"none": 0, "two": 2}


def test_fetch_log_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"url":"HTTP://E.test","hop":0,"status":200,"headers":{"content-type":"text/html"},"body":"x"}\n{broken\n')
    got = fetchlog.read(spark, str(tmp_path)).orderBy("corrupt").collect()
    assert (got[0].url, got[0].mime, got[0].corrupt) == ("http://e.test/", "text/html", False) and got[1].corrupt
