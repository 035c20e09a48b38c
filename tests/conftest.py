"""One local session for all tests, and helpers to compare frames."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("PAIRLENS_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pairlens.session import local_session

    session = local_session(cpus=4, driver_memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


@pytest.fixture(scope="session")
def duck(data_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    return round(x, 6) if isinstance(x, float) else x


def rows_of(pdf) -> list[tuple]:
    """Rows with columns and rows in a fixed order, nulls and NaN as None."""
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same_rows(spark, data_dir, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        got, want = query(spark, data_dir).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.astype(object).where(got.notna(), None)) == rows_of(want.astype(object).where(want.notna(), None))

    return check
