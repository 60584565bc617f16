"""Slot counts by event time, the same plan for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(sites: DataFrame, late: str | None) -> DataFrame:
    """A stream's watermark needs times with a zone: local ones are read in the session's."""
    return sites.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else sites


def windowed_counts(sites: DataFrame, key: str, conforming: Column, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, key, candidates, conforming by tumbling windows, or sliding ones with `slide`; `late` sets the
    watermark of a stream, beyond which windows are final."""
    rows = _timed(sites, late)
    counted = rows.groupBy(F.window("ts", length, slide or length), key).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(conforming).alias("conforming"))
    return counted.select(F.col("window.start").alias("window_start"), key, "candidates", "conforming")


def session_counts(sites: DataFrame, key: str, conforming: Column, gap: str, late: str | None = None) -> DataFrame:
    """window_start, window_end, key, candidates, conforming by sessions that end after `gap` without a site."""
    rows = _timed(sites, late)
    counted = rows.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(conforming).alias("conforming"))
    return counted.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), key, "candidates", "conforming")
