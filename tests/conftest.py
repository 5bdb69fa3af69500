import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with SQL on the same tables: columns and rows, whatever their order."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")

    def check(df, sql):
        want, got = con.sql(sql).df(), df.toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        rows = lambda d: sorted(str(r) for r in d[columns].astype(object).where(d[columns].notna(), None).values.tolist())
        assert rows(got) == rows(want)

    return check
