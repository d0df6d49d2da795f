import glob
import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = f"{HOME}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Compares a DataFrame with a DuckDB relation: column names, and rows in any order."""

    def compare(df, relation):
        a, b = df.toPandas(), relation.df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
        assert rows(a) == rows(b)

    return compare
