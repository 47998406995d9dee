"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from skein import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return None
        if isinstance(x, float):
            return float(f"{x:.9g}")
        return x if isinstance(x, (str, bool)) else int(x) if hasattr(x, "__int__") else str(x)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("skein.llm", "corpus_pipeline")) else real(n, *a))
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(registry.queries())
    monkeypatch.undo()
    importlib.reload(entry)
