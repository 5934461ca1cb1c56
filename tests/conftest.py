import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.warehouse.dir", f"file://{base}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def norm(value):
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "tolist"):
        return str(value.tolist())
    return str(value)


@pytest.fixture(scope="session")
def same(spark):
    """Compares a query with its SQL over the small tables, columns by name and rows in any order."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")

    def check(query, sql):
        a, b = query(spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda d: sorted(tuple(norm(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
        assert rows(a) == rows(b)

    return check
