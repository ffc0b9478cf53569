"""The driver's contract: every core query runs, and equals its SQL where it has any."""

import datetime
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidegauge.plans import registry


def rows(df):
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (datetime.date, pd.Timestamp)):
            return str(pd.Timestamp(x))
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.integer, np.floating)):
            return float(x)
        return x if isinstance(x, str) else str(x)

    return sorted((tuple(map(one, r)) for r in df.astype(object).values.tolist()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf01):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf01).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf01, duck, name):
    got = registry.QUERIES[name](spark, sf01).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 * max(1, abs(p))) for p, q in zip(x, y)), (x, y)


def test_oracles_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
