"""Tables in the folder that driver and executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Rows that one task sorts at a time, whatever a table holds.
ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, the warehouse, or a folder of our own if all of Spark runs in this process."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, rows: int, *by: str, most: int = ROWS) -> DataFrame:
    """`df` in partitions by `by`, so many that each has some `most` of `rows` at most, and every core has one.

    The number is given, so that neither a fixed number of shuffle partitions nor their merging makes a task's part grow
    with the table, nor a table of few splits leaves cores idle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *by)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
