"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from spindrift.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    mine = sorted(repr(tuple(plain(r[k]) for k in sorted(df.columns))) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    cols = rel.columns
    theirs = sorted(repr(tuple(plain(r[cols.index(k)]) for k in sorted(cols))) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert mine == theirs


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


@pytest.mark.parametrize("gone", ["corpus_pipeline", "spindrift.llm", "zstandard"])
def test_entry_imports_without_the_corpus_package(monkeypatch, gone):
    import importlib
    import sys

    for name in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or m.startswith("spindrift.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    with pytest.warns(UserWarning, match="no corpus queries"):
        entry = importlib.import_module("__spark_entry__")
    assert set(registry.QUERIES) == set(entry.queries())
