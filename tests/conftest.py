import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def plain(value):
    """A value in a form that is equal for equal results of either engine."""
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")

    def check(query, sql):
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
        assert ours == theirs
        return ours

    return check
