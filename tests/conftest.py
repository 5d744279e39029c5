import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = ROOT
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Compare a query with its SQL at a scale; returns the number of rows."""
    import duckdb

    import __spark_entry__ as entry

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def compare(spark, name, sf_dir="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in tables:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        df = entry.queries()[name](spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
        rel = con.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == names
        want = sorted(repr(tuple(r)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall())
        assert got == want
        return len(got)

    return compare
