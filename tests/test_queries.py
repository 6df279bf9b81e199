"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from paperloom.plans import registry

ORACLE = registry.oracle_sql()


def plain(v):
    """A value in a form that both engines share."""
    if not isinstance(v, (list, tuple, np.ndarray)) and pd.isna(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, (int, float, np.number)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.VECTORS))
def test_worked_out_cases(spark, duck, sf, name):
    run, sql = registry.VECTORS[name]
    assert rows(run(spark, sf).toPandas()) == rows(duck.execute(sql).fetchdf())


def test_entry_gives_rows(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0


def test_process_documents(spark, sf):
    out = registry.queries()["evl23_process_documents"](spark, sf).toPandas()
    assert len(out) == 200 and out.overall.between(0, 1).all()


def test_every_query_with_sql_is_registered():
    assert set(ORACLE) <= set(registry.queries())
