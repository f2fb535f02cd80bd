import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    builder = SparkSession.builder.master("local[8]").appName("tests")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{shared}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a DataFrame with DuckDB SQL over a folder of tables, rows in any order."""
    import duckdb

    def rounded(row):
        return tuple(round(x, 9) if isinstance(x, float) else x for x in row)

    def check(df, sql, folder):
        con = duckdb.connect()
        for name in TABLES:
            if os.path.exists(path := f"{folder}/{name}.parquet"):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        expected = sorted((rounded(r) for r in found.fetchall()), key=repr)
        got = sorted((rounded(r) for r in df.select(*names).collect()), key=repr)
        assert got == expected

    return check
