"""Orders over whole tables that no single task holds: ranks, and what comes next."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.tables import stored

_ROWS = 1 << 33  # a partition's places in monotonically_increasing_id


def numbered(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """`rows` with `name`: their place from 1 in a total order.

    They are sorted by range and stored with their place within a partition; a partition's first place is then the sum of
    what the partitions before it hold, a row a partition.
    """
    made = stored(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.floor(F.col("_place") / _ROWS))
    sizes = made.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return made.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") % _ROWS + 1).drop("_part", "_place", "_before")


def next_after(rows: DataFrame, targets: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """`rows` with `name`: the least `at` of `targets` beyond their own among those of the same `by`; null without one.

    `at` is a whole number. It is dealt to as many buckets as the root of the number of rows, so that a `by` that most rows
    share is ordered by many tasks: the next one is in a row's own bucket, or the first of the next bucket that has any.
    """
    kept = rows.select(by, at, F.struct("*").alias("_row"), F.lit(None).cast("long").alias("_to"))
    both = kept.unionByName(targets.select(by, at, F.lit(None).cast(kept.schema["_row"].dataType).alias("_row"), F.col(at).cast("long").alias("_to")))
    n, low, high = both.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    width = -(-(high - low + 1) // isqrt(n)) if n else 1
    both = both.withColumn("_bucket", F.floor((F.col(at) - F.lit(low or 0)) / width))
    beyond = F.min("_to").over(Window.partitionBy(by, "_bucket").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1))
    firsts = both.groupBy(by, "_bucket").agg(F.min("_to").alias("_first"))
    later = firsts.select(by, "_bucket", F.min("_first").over(Window.partitionBy(by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    placed = both.withColumn("_beyond", beyond).where("_row IS NOT NULL").join(later, [by, "_bucket"], "left")
    return placed.select("_row.*", F.coalesce("_beyond", "_later").alias(name))
