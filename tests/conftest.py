"""One local session for all tests."""

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", f"{scratch}/local")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return repr([_value(x) for x in v])
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame has the rows and columns of a SQL text."""

    def check(df, sql):
        names = sorted(df.columns)
        relation = duck.sql(sql)
        assert sorted(relation.columns) == names
        place = [relation.columns.index(c) for c in names]
        expected = sorted(tuple(_value(r[i]) for i in place) for r in relation.fetchall())
        assert sorted(tuple(_value(r[c]) for c in names) for r in df.collect()) == expected

    return check
