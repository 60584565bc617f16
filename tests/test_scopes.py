import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from plumbline.operators import scopes
from plumbline.tables import ROWS, dealt


def test_what_a_task_sorts_does_not_grow_with_the_table(spark):
    """Partitions follow the number of rows, not that of shuffle partitions, which merging by size makes fewer still."""
    tokens = spark.createDataFrame([("f", 1, "open", "a", "x"), ("f", 2, "declare", "b", "y"), ("f", 3, "open", "c", "z"), ("f", 4, "close", "d", "y"), ("f", 5, "use", "b", "y")], "rel string, at long, kind string, block string, name string")
    made = scopes.scopes(tokens, ["block"], rows=9 * ROWS)
    there = scopes.declared(tokens, made, F.col("kind") == "declare", [], rows=9 * ROWS)
    used = scopes.bound(there, tokens.where("kind = 'use'").select("rel", "at", "name"), [], rows=9 * ROWS)
    assert sorted((r.start, r.until, r.depth, r.parent, r.block) for r in made.collect()) == [(1, 5, 1, None, "a"), (3, 4, 2, 1, "c")]
    assert [r.binding.start for r in used.collect()] == [2]
    assert [df.rdd.getNumPartitions() for df in (made, used)] == [9, 9]
    assert dealt(tokens, 10, "rel", most=1).rdd.getNumPartitions() == 10


@pytest.fixture
def no_broadcast(spark):
    """Files too many to broadcast a row each."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_join_to_a_files_end_keeps_the_partitions_of_the_pass(spark, no_broadcast):
    tokens = spark.createDataFrame([("f", 1, "open", "a"), ("f", 2, "declare", "b"), ("f", 3, "close", "c"), ("g", 1, "declare", "b"), ("g", 7, "use", "b")], "rel string, at long, kind string, name string")
    there = scopes.declared(tokens, scopes.scopes(tokens), F.col("kind") == "declare", [], rows=9 * ROWS)
    assert sorted((r.rel, r.name, r.start, r.until, r.scope) for r in there.collect()) == [("f", "b", 2, 3, 1), ("g", "b", 1, 7, None)]
    assert there.rdd.getNumPartitions() == 9


def test_spread_origins_is_dealt_by_the_rows_of_the_table(spark, small, no_broadcast, monkeypatch):
    monkeypatch.setitem(dealt.__kwdefaults__, "most", 10_000)
    rows = 2 * spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert driver.queries()["spread_origins"](spark, small).rdd.getNumPartitions() == -(-rows // 10_000)
