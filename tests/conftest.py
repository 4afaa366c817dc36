import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Checks a registered query against its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")

    def run(query, sql):
        df = query(spark, sf)
        cols = sorted(df.columns)
        got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
        want = sorted(map(tuple, con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()), key=repr)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a == b or all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b)), (a, b)

    return run
