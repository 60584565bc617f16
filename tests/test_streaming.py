import pytest
from pyspark.sql import functions as F

from plumbline.operators import sessions
from plumbline.streaming import sessions as stateful
from plumbline.streaming import windows


def test_a_stream_gives_the_batch_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = windows.windowed_counts(stream, "event_type", F.col("value") <= 20, "6 hours", late="60 days")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windows.windowed_counts(events, "event_type", F.col("value") <= 20, "6 hours")
    assert sorted(map(tuple, spark.table("slots").collect())) == sorted(map(tuple, batch.collect()))


@pytest.fixture
def stateful_session(spark):
    """One partition, for each holds a state store, and the store that maps take."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", stateful.STORE[0])}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set(*stateful.STORE)
    yield spark
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_of(spark, events, parts, tmp_path):
    for i in range(parts):  # one file a trigger, in order of events
        events.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(repeats, name, tmp_path):
    query = repeats.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return query


COLUMNS = ["session", "ord", "path", "compacts", "seen_before", "after_compact"]


def test_repeats_over_a_stream_are_those_of_the_batch(stateful_session, small, tmp_path):
    spark, kind = stateful_session, F.when(F.col("event_type") == "error", "compact").otherwise("delivery")
    events = spark.read.parquet(f"{small}/events.parquet").where("event_id < 900").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), kind.alias("kind"), (F.col("event_id") % 7).cast("string").alias("path"), F.expr("event_id DIV 300").alias("part"))
    run(stateful.repeats(stream_of(spark, events, 3, tmp_path), idle=None), "repeats", tmp_path)
    found = lambda df: sorted(map(tuple, df.select(COLUMNS).collect()))
    assert found(spark.table("repeats")) == found(sessions.repeats(events.drop("part")))


def test_a_trigger_writes_state_of_its_own_events_only(stateful_session, tmp_path):
    """A long history first, then triggers of one event each: what they write does not grow with it."""
    spark = stateful_session
    rows = [(1, i, "delivery", f"p{i}", 0) for i in range(3000)] + [(1, 3000 + i, "delivery", f"p{i}", 1 + i) for i in range(3)]
    events = spark.createDataFrame(rows, "session long, ord long, kind string, path string, part int")
    query = run(stateful.repeats(stream_of(spark, events, 4, tmp_path), idle=None), "history", tmp_path)
    puts = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert puts[0] >= 3000 and all(n <= 4 for n in puts[1:]), puts
    assert spark.table("history").where("seen_before").count() == 3
