"""Persisted records and event logs as JSON lines, and the plan of what a run writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
#: Columns by the version that brought them; older records have nulls there.
FACTS = "schema int, area string, files long, dimensions array<struct<key:string,states:string,candidates:long,conforming:long,learned:string>>"
EVENT = "type string, session string, uuid long, path string, scoped boolean, sidechain boolean"


def write_facts(slots: DataFrame, path: str) -> None:
    """One JSON line an area, with its slots; the committer makes the folder whole or leaves it out."""
    slot = F.struct("key", "states", "candidates", "conforming", "learned")
    rows = slots.groupBy("area").agg(F.max("area_files").alias("files"), F.array_sort(F.collect_list(slot)).alias("dimensions"))
    rows.select(F.lit(SCHEMA_VERSION).alias("schema"), "area", "files", "dimensions").write.json(path)


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records of this version or an older one, one row of counts: readable, unreadable). Newer or broken lines are
    counted, never guessed at."""
    lines = spark.read.text(path).select(F.from_json("value", FACTS).alias("r"))
    good = F.coalesce(F.col("r.schema").between(1, SCHEMA_VERSION) & F.col("r.area").isNotNull(), F.lit(False))
    counts = lines.agg(F.count_if(good).alias("readable"), F.count_if(~good).alias("unreadable"))
    return lines.where(good).select("r.*"), counts


def events(spark: SparkSession, path: str) -> DataFrame:
    """session, ord, kind (delivery or compact), path, scoped, sidechain of logs below `path`.

    Lines without a mark of either kind are passed over before they are parsed; lines that do not parse are dropped.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    marked = lines.where(F.col("value").contains('"delivery"') | F.col("value").contains('"compact"'))
    parsed = marked.select(F.from_json("value", EVENT).alias("e")).select("e.*").where("type IN ('delivery', 'compact')")
    return parsed.select("session", F.col("uuid").alias("ord"), F.col("type").alias("kind"), "path", F.coalesce("scoped", F.lit(False)).alias("scoped"), F.coalesce("sidechain", F.lit(False)).alias("sidechain"))


def write_plan(planned: DataFrame, existing: DataFrame, blind: Column) -> DataFrame:
    """path, action: create, update, keep or remove for planned (path, text) against existing (path, text, owned).

    Only files of our own are removed or replaced; a run that saw nothing (`blind`) keeps everything.
    """
    both = planned.select("path", F.col("text").alias("new")).join(existing.select("path", F.col("text").alias("old"), "owned"), "path", "full_outer")
    foreign = F.col("old").isNotNull() & ~F.coalesce("owned", F.lit(False))
    action = F.when(blind | foreign | (F.col("new") == F.col("old")), "keep").when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "remove").otherwise("update")
    return both.where(~(blind & F.col("old").isNull())).select("path", action.alias("action"))
