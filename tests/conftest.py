import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def compare(df, con, sql):
    """Rows of a Spark result and of SQL, as sorted lists of values by column name; doubles to 12 digits."""

    def norm(v):
        return float(f"{v:.12g}") if isinstance(v, float) else v

    names = sorted(df.columns)
    ours = sorted(repr([norm(r[c]) for c in names]) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    theirs = sorted(repr([norm(r[k]) for k in at]) for r in rel.fetchall())
    assert ours == theirs
