"""Verdicts of slots: which counts the gates read, model defaults, and two arms of a trial compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.gates import blocked_by, judged

SIDES, METHODS = ("claim", "counter", "none"), ("measured", "literature", "seed")
COUNTS = ("candidates", "conforming", "squares", "top_candidates", "top_conforming", "applicability", "lang_files", "area_files", "area_dirs", "dirs")


def read_counts(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """`current` slots with the counts that the gates read: the baseline's where it has the slot, else their own.

    `now_candidates` and `now_conforming` keep today's, which are printed and judge nothing; `has_base` and `learned_moved`
    say whether the baseline has the slot, and another class for it, or one of the other `kind` of files, if they have it.
    """
    kind = F.col("kind") if "kind" in baseline.columns else F.lit(None).cast("string")
    there = baseline.select("area", "key", F.col("learned").alias("_learned"), kind.alias("_kind"), *[F.col(c).alias(f"_{c}") for c in COUNTS], F.lit(True).alias("_there"))
    both = current.withColumns({"now_candidates": F.col("candidates"), "now_conforming": F.col("conforming")}).join(there, ["area", "key"], "left")
    has = F.coalesce("_there", F.lit(False))
    moved = has & ~F.col("learned").eqNullSafe(F.col("_learned"))
    if "kind" in current.columns:
        moved = has & ~(F.col("learned").eqNullSafe(F.col("_learned")) & F.col("kind").eqNullSafe(F.col("_kind")))
    return both.withColumns({c: F.when(has, F.col(f"_{c}")).otherwise(F.col(c)) for c in COUNTS} | {"has_base": has, "learned_moved": moved}).drop("_learned", "_kind", "_there", *[f"_{c}" for c in COUNTS])


def verdicts(slots: DataFrame, defaults: DataFrame, truncated: Column, degraded: Column, area_gate: Column, history_read: Column | None = None) -> DataFrame:
    """`slots` with block, failed, states, borrowed and matches_default: gates on the counts that `read_counts` chose, nothing
    stated where something stands in the way, and whether what is stated is what a model writes unasked.

    `defaults` has key, default_side and default_class.
    """
    block = blocked_by(truncated, degraded, area_gate, F.col("learned_moved"))
    there = judged(slots.withColumn("block", block), history_read).withColumn("states", F.when(F.col("block").isNull(), F.col("states")))
    there = there.withColumn("failed", F.coalesce("block", "failed")).join(defaults.select("key", "default_side", "default_class"), "key", "left")
    same = F.when(F.col("learned").isNotNull(), F.col("learned") == F.col("default_class")).otherwise(F.col("states") == F.col("default_side"))
    return there.withColumn("matches_default", F.col("states").isNotNull() & F.coalesce(same, F.lit(False))).drop("default_side", "default_class")


def faulty_defaults(defaults: DataFrame, keys: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """key, fault of entries (key, default_side, default_class, method, source) that cannot be held: the first fault of each."""
    known = keys.select("key", F.lit(True).alias("_known")).distinct()
    rules = (
        ("unknown-key", F.col("_known").isNull()),
        ("side", ~F.coalesce(F.col("default_side").isin(*SIDES), F.lit(False))),
        ("class", F.col("default_class").isNotNull() & ~F.col("default_class").isin(*classes, "none")),
        ("method", ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False))),
        ("source", (F.col("method") == "literature") & F.col("source").isNull()),
    )
    fault = F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in rules])
    return defaults.join(known, "key", "left").select("key", fault.alias("fault")).where("fault IS NOT NULL")


def seeded(defaults: DataFrame, keys: DataFrame) -> DataFrame:
    """`defaults` (key, default_side, default_class, method, source) with an entry of no side for each key that has none."""
    none = F.lit(None).cast("string")
    missing = keys.select("key").distinct().join(defaults.select("key"), "key", "left_anti")
    return defaults.select("key", "default_side", "default_class", "method", "source").unionByName(missing.select("key", F.lit("none").alias("default_side"), none.alias("default_class"), F.lit("seed").alias("method"), none.alias("source")))


def decided_sides(counts: DataFrame, least: int = 20, share: float = 0.8) -> DataFrame:
    """key, samples, side: the side that `share` of at least `least` samples took; counts (key, side, n) of parts add up."""
    summed = counts.groupBy("key", "side").agg(F.sum("n").alias("n"))
    best = summed.groupBy("key").agg(F.sum("n").alias("samples"), F.max("n").alias("_most"), F.min(F.struct((-F.col("n")).alias("minus"), "side")).alias("_first"))
    sure = (F.col("samples") >= least) & (F.col("_most") >= share * F.col("samples"))
    return best.select("key", "samples", F.when(sure, F.col("_first.side")).otherwise("none").alias("side"))


def arms(with_map: DataFrame, without: DataFrame) -> DataFrame:
    """key, a, b, reading of two arms (key, candidates, conforming): ratios to three places, null without a site."""
    side = lambda df, name: df.select("key", F.when(F.col("candidates") > 0, F.round(F.col("conforming") / F.col("candidates"), 3)).alias(name))
    both = side(with_map, "a").join(side(without, "b"), "key", "full_outer")
    a, b = F.col("a"), F.col("b")
    reading = F.when(a.isNull() & b.isNull(), "no-site").when(a.isNull() | b.isNull(), "one-arm").when((a == b) & (a == 1), "both-perfect").when(a == b, "equal").when(a > b, "better-with").otherwise("better-without")
    return both.withColumn("reading", reading)
