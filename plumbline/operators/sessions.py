"""Sequences of events by session: deliveries, repeats and what lay between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeats(events: DataFrame) -> DataFrame:
    """Deliveries (session, ord, path) with compacts (compactions before it), seen_before and after_compact.

    `events` has session, ord, kind (delivery or compact) and path. Compactions are a running count by session; the
    count at the same path's last delivery tells whether one lay between.
    """
    by_session = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("compacts", F.sum(F.when(F.col("kind") == "compact", 1).otherwise(0)).over(by_session))
    before = F.lag("compacts").over(Window.partitionBy("session", "path").orderBy("ord"))
    there = counted.where("kind = 'delivery'").withColumn("_before", before)
    return there.select("session", "ord", "path", "compacts", F.col("_before").isNotNull().alias("seen_before"), F.coalesce(F.col("compacts") > F.col("_before"), F.lit(False)).alias("after_compact"))


def summary(events: DataFrame) -> DataFrame:
    """One row over all sessions."""
    delivered = repeats(events)
    by_session = delivered.groupBy("session").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if("seen_before").alias("repeats"), F.count_if("after_compact").alias("after_compact"), F.min("compacts").alias("first_compacts"))
    all_ = events.groupBy("session").agg(F.count_if(F.col("kind") == "compact").alias("compacts")).join(by_session, "session", "left")
    return all_.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count("deliveries").alias("sessions_with_delivery"),
        F.coalesce(F.sum("deliveries"), F.lit(0)).alias("deliveries"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeats"),
        F.coalesce(F.sum("after_compact"), F.lit(0)).alias("repeats_after_compact"),
        F.count_if(F.col("compacts") > F.col("first_compacts")).alias("sessions_compacted_after_delivery"),
        F.count_if(F.col("after_compact") > 0).alias("sessions_reloaded_after_compact"),
    )
