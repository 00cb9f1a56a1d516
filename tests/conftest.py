from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session("local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def _cell(v):
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return f"{v:.6g}" if v != int(v) else str(int(v))
    return str(v)


def rows(frame) -> list[tuple]:
    """Rows of a pandas frame, columns by name, in one order."""
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture
def same_as_sql(spark, duck, data):
    def check(name: str, query, sql: str) -> None:
        ours, theirs = query(spark, data).toPandas(), duck.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs), name

    return check
