import glob
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment["PYTHONPATH"] = ROOT
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with a DuckDB result by column name, order aside."""

    def compare(df, result):
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        cols = sorted(names)
        ours = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
        theirs = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
        assert len(ours) == len(theirs)
        assert ours == theirs

    return compare
