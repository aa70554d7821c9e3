import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    """A value that compares equal across engines."""
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows_of(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(pd.notna(frame), None)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture
def same_as_sql(spark, data, duck):
    def check(query, sql):
        ours, theirs = query(spark, data).toPandas(), duck.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows_of(ours) == rows_of(theirs)

    return check
