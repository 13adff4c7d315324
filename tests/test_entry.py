"""Every query against its SQL, on the smallest tables."""

import math
import sys

import duckdb
import pandas as pd
import pytest

from finscan import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    return int(x) if isinstance(x, float) and abs(x) < 1e15 and x == int(x) else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(repr(plain(v)) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_llm_package_is_optional(monkeypatch):
    import importlib

    for name in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or m.startswith("finscan.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "finscan.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "screen_basic" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
