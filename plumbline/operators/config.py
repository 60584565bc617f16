"""Configurations that extend one another, followed without leaving their tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import directory, imported_path

MAX_CHAIN = 64

_WALK = f"""
WITH RECURSIVE walk(root, path, at, target, hops, seen, status) MAX RECURSION LEVEL {MAX_CHAIN + 2} AS (
  SELECT root, path, path, target, 0, array(path), status FROM {{links}}
  UNION ALL
  SELECT w.root, w.path, w.target, l.target, w.hops + 1, array_append(w.seen, w.target),
    CASE WHEN array_contains(w.seen, w.target) THEN 'cycle' WHEN l.path IS NULL THEN 'missing' WHEN w.hops >= {MAX_CHAIN} THEN 'too-long' ELSE l.status END
  FROM walk w LEFT JOIN {{links}} l ON l.root = w.root AND l.path = w.target
  WHERE w.status IS NULL)
SELECT root, path, at AS last, hops, status FROM walk WHERE status IS NOT NULL"""


def resolved(configs: DataFrame) -> DataFrame:
    """root, path, last, hops, status of configurations (root, path, extends): where each one's chain ends, and how.

    `ok` ends with one that extends nothing, `escaped` with one whose `extends` leaves its root on the way, whatever it comes
    back to; `missing`, `cycle` and `too-long` (over MAX_CHAIN hops) are errors. A name without an extension means a
    `.json`. Paths are unique within a root. A hop is one join of the chains that are still open, which are at most as
    many as there are configurations; Spark holds the sum of all hops to `spark.sql.cteRecursionRowLimit` rows, which is lifted here.
    """
    spark = configs.sparkSession
    named = F.when(F.regexp_extract("extends", "([^/]*)$", 1).contains("."), F.col("extends")).otherwise(F.concat("extends", F.lit(".json")))
    target = imported_path(directory(F.col("path"), ""), named)
    absolute = F.coalesce(F.col("extends").startswith("/"), F.lit(False))
    status = F.when(F.col("extends").isNull(), "ok").when(absolute | target.isNull(), "escaped")
    links = configs.select("root", "path", F.when(~absolute, target).alias("target"), status.alias("status"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(_WALK, links=links)


def used(configs: DataFrame, roots: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """root, status, reason of each of `roots` (root): what its own configuration gives a reader. Anything but `ok` is
    degraded: defaults are used instead."""
    own = resolved(configs).where(F.col("path") == name).select("root", F.col("status").alias("_end"))
    reason = F.when(F.col("_end").isNull(), "no-config").when(F.col("_end") == "escaped", "extends-escaped").when(F.col("_end") != "ok", "config-errors")
    there = roots.select("root").distinct().join(own, "root", "left")
    return there.select("root", F.when(reason.isNull(), "ok").otherwise("degraded").alias("status"), reason.alias("reason"))
