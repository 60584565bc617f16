"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; `bytes.split()` splits on exactly these characters.
ASCII_SPACE = r"[\x20\x09-\x0D]"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where that is unset, the warehouse, or a folder
    of our own if all of Spark runs in this one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own_dirs[app]


def unused(names: list[str], wanted: str) -> str:
    """`wanted`, with as many underscores behind it as make it none of `names`."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, lost executors lose nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """As `stored`, with the table's path, for `removed`."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 if null."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(flat), F.lit(0)) == 0, 0).otherwise(F.size(F.split(flat, " +"))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give back the memory that this process's allocators keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, giving back at its end the memory that its allocators keep: workers stay for later tasks,
    beside a JVM that may need the room then."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return held
