"""Pinned populations, renames and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import DRIFT_SHARE, ratio
from plumbline.operators.ordering import next_after
from plumbline.tables import stored

MAX_HOPS = 64


def pin_delta(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """area, old_files, new_files, added, removed, change: a full outer join of two populations by area and file."""
    both = pinned.select("area", "rel", F.lit(1).alias("old")).join(current.select("area", "rel", F.lit(1).alias("new")), ["area", "rel"], "full_outer")
    counted = both.groupBy("area").agg(F.count("old").alias("old_files"), F.count("new").alias("new_files"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"))
    change = F.when(F.col("old_files") == 0, "new").when(F.col("new_files") == 0, "gone").when((F.col("added") > 0) | (F.col("removed") > 0), "changed").otherwise("same")
    return counted.withColumn("change", change)


def resolved(renames: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """seq, path, name, hops: where each rename's path ended after the renames that followed it, `hops` (a power of two) at
    most.

    `renames` has seq (newer is larger), old and new. A rename is followed by the first later one of the path it made, so
    a path that is used again keeps apart from its earlier life. Each round takes a chain's end to the end of the chain
    that goes on there, so that chains double; rounds are tables in the shared folder.
    """
    moves = renames.where("old <> new").select(F.col("seq").cast("long"), "old", "new")
    linked = next_after(moves.select("seq", F.col("old").alias("path"), F.col("new").alias("name")), moves.select("seq", F.col("old").alias("name")), "name", "seq", "next_seq")
    chains = stored(linked.withColumn("hops", F.lit(1)), "renames")
    for _ in range(hops.bit_length() - 1):
        if chains.where("next_seq IS NOT NULL").isEmpty():
            break
        onward = chains.select(F.col("seq").alias("next_seq"), F.col("path").alias("name"), F.col("name").alias("_name"), F.col("next_seq").alias("_next"), F.col("hops").alias("_hops"))
        joined = chains.join(onward, ["next_seq", "name"], "left")
        chains = stored(joined.select("seq", "path", F.coalesce("_name", "name").alias("name"), F.col("_next").alias("next_seq"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")), "renames")
    return chains.select("seq", "path", "name", "hops")


def population_match(pinned: DataFrame, current: DataFrame, renames: DataFrame) -> DataFrame:
    """area, pinned_area, overlap, missing, added: each area's best pinned area by shared files, through renames.

    Of pinned areas with equal overlap the least path wins; an area that shares no file has none.
    """
    as_pinned = current.join(renames.select(F.col("new").alias("rel"), "old"), "rel", "left").select("area", F.coalesce("old", "rel").alias("rel"))
    shared = as_pinned.join(pinned.select(F.col("area").alias("pinned_area"), "rel"), "rel").groupBy("area", "pinned_area").agg(F.count(F.lit(1)).alias("overlap"))
    best = shared.groupBy("area").agg(F.min(F.struct(-F.col("overlap"), "pinned_area")).alias("b"), F.max("overlap").alias("overlap")).select("area", "b.pinned_area", "overlap")
    sizes = current.groupBy("area").agg(F.count(F.lit(1)).alias("_now"))
    old = pinned.groupBy(F.col("area").alias("pinned_area")).agg(F.count(F.lit(1)).alias("_then"))
    out = sizes.join(best, "area", "left").join(old, "pinned_area", "left")
    overlap = F.coalesce("overlap", F.lit(0))
    return out.select("area", "pinned_area", overlap.alias("overlap"), F.coalesce(F.col("_then") - overlap, F.lit(0)).alias("missing"), (F.col("_now") - overlap).alias("added"))


def drift(mapped: DataFrame, changed: DataFrame) -> DataFrame:
    """area, mapped, changed, share, stale: mapped files that changed since the pin."""
    both = mapped.join(changed.select("rel").distinct().withColumn("_changed", F.lit(True)), "rel", "left")
    counted = both.groupBy("area").agg(F.count(F.lit(1)).alias("mapped"), F.count("_changed").alias("changed"))
    share = ratio(F.col("changed"), F.col("mapped"))
    return counted.withColumns({"share": share, "stale": share >= DRIFT_SHARE})


def block(status: Column, pinned_area: Column, pinned_at_scan: Column) -> Column:
    """Why an area's slots may not use the pin: unreachable, population-change or postdates-baseline; null if they may."""
    return F.when(status == "unreachable", "unreachable").when(status == "unpinned", F.lit(None)).when(pinned_area.isNull() & pinned_at_scan, "population-change").when(pinned_area.isNull(), "postdates-baseline")


def staleness(states: DataFrame) -> DataFrame:
    """`states` (has_map, truncated, status, mapped, changed) with the first reason for which a map is stale, null if none."""
    rules = [("no map", ~F.col("has_map")), ("truncated", F.col("truncated")), ("unpinned", F.col("status") == "unpinned"), ("unreachable", F.col("status") == "unreachable"), ("empty", F.col("mapped") == 0), ("drifted", ratio(F.col("changed"), F.col("mapped")) >= DRIFT_SHARE)]
    return states.withColumn("reason", reduce(lambda later, rule: F.when(rule[1], rule[0]).otherwise(later), reversed(rules), F.lit(None).cast("string")))


def matched(pinned: DataFrame, current: DataFrame, renames: DataFrame, status: str) -> DataFrame:
    """area, pinned_area, gate: each current area's pinned one, through renames, and why its slots may not use the pin.

    An area that was pinned by its path and now shares no file with any is a changed population; one that was not is newer
    than the pin.
    """
    match = population_match(pinned, current, renames).select("area", "pinned_area")
    by_path = pinned.select("area").distinct().withColumn("_pinned", F.lit(True))
    there = match.join(by_path, "area", "left")
    return there.select("area", "pinned_area", block(F.lit(status), F.col("pinned_area"), F.coalesce("_pinned", F.lit(False))).alias("gate"))


def stale_map(mapped: DataFrame, changed: DataFrame | None, status: str, has_map: bool = True, truncated: bool = False) -> DataFrame:
    """One row, reason: why a map over the files `mapped` (rel) is stale, given those that changed at the base since its pin;
    null if it is not. What changed and is not mapped is no drift."""
    moved = mapped.limit(0).select("rel") if changed is None else changed.select("rel").distinct()
    both = mapped.select("rel").distinct().join(moved.withColumn("_changed", F.lit(True)), "rel", "left")
    counts = both.agg(F.count(F.lit(1)).alias("mapped"), F.count("_changed").alias("changed"))
    return staleness(counts.withColumns({"has_map": F.lit(has_map), "truncated": F.lit(truncated), "status": F.lit(status)})).select("reason")
