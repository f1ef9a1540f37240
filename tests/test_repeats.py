"""Queries against their SQL on hand-made tables: URLs that several pages have, and where the tables end."""

import duckdb
import pandas as pd
import pytest
from test_queries import plain

from spindrift.plans import registry

HTML = '<html><body><article><h1>one two three four five</h1><a href="/en/x">x</a>{}</article></body></html>'
#: The hosts' origins have lengths with all remainders by 6, which decide about their robots files.
SITES = [f"https://{'h' * n}.example.test" for n in range(1, 7)]


@pytest.fixture()
def both(spark, tmp_path):
    def run(name, table, rows, columns):
        pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / f"{table}.parquet", index=False)
        df = registry.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.sql("set threads = 1")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        rel = con.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        mine = [repr(tuple(plain(r[k]) for k in rel.columns)) for r in df.collect()]
        return sorted(mine), sorted(repr(tuple(plain(x) for x in r)) for r in rel.fetchall())

    return run


def repeated(n):
    """``n`` pages a site, three to a URL, with bodies of growing length."""
    urls = [f"{site}/en/{i // 3}" for site in SITES for i in range(n)]
    return [(i, u, HTML.format("y" * i)) for i, u in enumerate(urls)]


PAGES = ["page_id", "url", "html"]


def test_reads_of_pages_with_one_url(both):
    mine, theirs = both("governed_reads", "pages", repeated(24), PAGES)
    assert mine == theirs and len(mine) == 6 * 24


def test_markdown_of_pages_with_many_open_paragraphs(both):
    page = "<html><body><article><h1>one two three four five</h1>" + "<p><b>six.<br>" * 90 + "{}</article></body></html>"
    mine, theirs = both("markdown_status", "pages", [(i, f"https://e.test/{i}", page.format("y" * i)) for i in range(6)], PAGES)
    assert mine == theirs


@pytest.mark.parametrize("name", ["site_governed", "site_outcomes"])
def test_budgets_of_pages_with_one_url(both, name):
    mine, theirs = both(name, "pages", repeated(24), PAGES)
    assert mine == theirs


def test_pages_with_one_url_spend_their_own_bytes(both):
    """A site's first two pages share a URL; only both together leave the budget spent."""
    rows = [(0, "https://h.example.test/en/a", HTML.format("y" * 20_000)), (1, "https://h.example.test/en/a", HTML.format("z" * 41_000)), (2, "https://h.example.test/en/b", HTML.format(""))]
    mine, theirs = both("site_governed", "pages", rows, PAGES)
    assert mine == theirs and sum("budget.exhausted" in r for r in mine) == 2


def test_of_recovered_pages_with_one_url_the_first_counts(both):
    """The SQL leaves the order of such pages open; in one thread it takes them in that of the table."""
    mine, theirs = both("site_recovered", "pages", repeated(24), PAGES)
    assert mine == theirs and len(mine) == 6 * 8


def test_changes_of_pages_with_one_url(both):
    mine, theirs = both("site_refresh", "pages", repeated(24), PAGES)
    assert mine == theirs and len(mine) == 6 * (24 + 1 + 1)


@pytest.mark.parametrize("last", [0, 7, 42, 81, 83, 120])
def test_walks_end_with_the_last_document(both, last):
    mine, theirs = both("url_navigation", "documents", [(i,) for i in range(last + 1)], ["doc_id"])
    assert mine == theirs and len(mine) == last // 40 + 1
