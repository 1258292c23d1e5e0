import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same(duck):
    """Compares a frame with the rows of a SQL text, columns by name, rows in any order."""

    def check(df, sql):
        columns = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        out = duck.execute(sql)
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(tuple(_plain(r[i]) for i in at) for r in out.fetchall())
        assert got == want

    return check
