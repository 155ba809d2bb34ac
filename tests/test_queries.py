"""Registered queries against their SQL in DuckDB."""

import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__
from tessera.plans import core_queries, geo_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v
    return sorted(repr([plain(r[k]) for k in order]) for r in records)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.collect(), got.columns) == rows(found.fetchall(), columns)


def test_every_core_query_has_sql():
    assert set(core_queries.QUERIES) == set(core_queries.ORACLES) and set(geo_queries.QUERIES) == set(geo_queries.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["left_id", "right_id"]


def test_import_without_the_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tessera.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    bare = importlib.reload(__spark_entry__)
    assert not [q for q in bare.queries() if q.startswith("op") or q == "pipeline"] and bare.queries()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
