"""What a run did not count, and the sentences that its counts allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of files that were not examined, in the order in which they are told; the first depends on the machine.
UNEXAMINED = ("crashed", "unreadable", "rejected", "oversize")
#: Extensions of languages that are named though none of them is read.
OTHER_EXTENSIONS = ("java", "kt", "kts", "rs", "go", "py", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "cs", "swift", "php", "scala", "m", "mm", "ex", "exs", "pl", "pm")


def unexamined(records: DataFrame, stable: bool = False) -> DataFrame:
    """kind, n of records (kind) that were not read. A `stable` tally leaves out what a busy machine makes."""
    kinds = UNEXAMINED[1:] if stable else UNEXAMINED
    return records.where(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def unread_languages(files: DataFrame) -> DataFrame:
    """ext, n of files (ext, lang) in languages that are known and not read."""
    return files.where(F.col("lang").isNull() & F.col("ext").isin(*OTHER_EXTENSIONS)).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def uncovered(files: DataFrame, owned: DataFrame, counted: DataFrame) -> DataFrame:
    """One row, orphaned and barren: files (rel) in no area, and files of areas (rel, area) in which nothing was counted
    (`counted` has area)."""
    orphaned = files.select("rel").distinct().join(owned.select("rel"), "rel", "left_anti").agg(F.count(F.lit(1)).alias("orphaned"))
    barren = owned.join(counted.select("area").distinct(), "area", "left_anti").agg(F.count_distinct("rel").alias("barren"))
    return orphaned.crossJoin(F.broadcast(barren))  # a row each


def principles(roots: DataFrame) -> DataFrame:
    """One row: whether any root (tests, jsx, siblings) has tests, and whether any has modules beside its components."""
    return roots.agg(F.coalesce(F.bool_or(F.col("tests") > 0), F.lit(False)).alias("test_shape"), F.coalesce(F.bool_or((F.col("jsx") > 0) & (F.col("siblings") > 0)), F.lit(False)).alias("granularity"))


def resolution(calls: DataFrame, by: list[str], least: float = 0.8) -> DataFrame:
    """`by`, calls, rate, degraded: the share of calls (resolved) that a type checker resolved; below `least` it cannot be
    trusted. No calls resolve none."""
    counted = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if("resolved").alias("_resolved"))
    rate = F.col("_resolved") / F.col("calls")
    return counted.select(*by, "calls", rate.alias("rate"), (rate < least).alias("degraded"))


def merged_tiers(sites: DataFrame, typed: DataFrame, records: DataFrame) -> DataFrame:
    """`sites` and those that a type checker found (`typed`) in files that were read (records: rel, ok)."""
    read = records.where("ok").select("rel").distinct()
    return sites.unionByName(typed.join(read, "rel", "left_semi"))


def chosen_base(candidates: DataFrame, asked: Column | None = None) -> DataFrame:
    """id, ref, mode of candidates (id, ord, ref, resolved, fork): the first that resolves; how a change is then compared:
    against the fork point, or by its added lines where there is none, or not at all.

    A ref that begins with a dash is none; with `asked` (the ref that somebody named), no other counts.
    """
    fit = F.col("resolved") & ~F.col("ref").startswith("-")
    if asked is not None:
        fit = fit & (asked.isNull() | (F.col("ref") == asked))
    first = candidates.groupBy("id").agg(F.min_by(F.struct("ref", "fork"), F.when(fit, F.col("ord"))).alias("b"), F.bool_or(fit).alias("any"))
    return first.select("id", F.when(F.col("any"), F.col("b.ref")).alias("ref"), F.when(F.col("any") & F.col("b.fork"), "fork-point").when(F.col("any"), "added-lines").otherwise("none").alias("mode"))


def audited(planned: DataFrame, on_disk: DataFrame, prefix: str) -> DataFrame:
    """name, state of rule files: those on disk (name, kind, owned) against those planned (name).

    A name that is no regular file is occupied, one that cannot be read unreadable; of the others, ours carry the prefix and
    the mark, are known if planned, and all else is foreign. Planned and not there is missing.
    """
    both = planned.select("name", F.lit(True).alias("_planned")).distinct().join(on_disk.where(F.col("name").endswith(".md")), "name", "full_outer")
    c = F.col
    state = F.when(c("kind").isNull(), "missing").when(c("kind") == "other", "occupied").when(c("kind") == "unreadable", "unreadable").when(~(c("name").startswith(prefix) & F.coalesce("owned", F.lit(False))), "foreign").when(c("_planned").isNull(), "unknown").otherwise("ours")
    return both.select("name", state.alias("state"))


def filename_findings(changes: DataFrame) -> DataFrame:
    """path, reason of changes (path, from_path, cls, from_cls, site, from_site, learned, states): file names that a branch
    made and that spell another class than their area learned.

    A rename answers only where it changed the class or made the name a site; a name that spells no class is advice, given
    only where the claim is stated.
    """
    c = F.col
    renamed = c("from_path").isNotNull()
    answers = ~renamed | ((c("from_path") != c("path")) & ((c("from_site") != c("site")) | ~c("from_cls").eqNullSafe(c("cls"))))
    wrong = ~c("cls").eqNullSafe(c("learned"))
    hit = changes.where("learned IS NOT NULL AND site").where(answers & wrong).where("cls IS NOT NULL OR states IS NOT NULL")
    return hit.select("path", F.when(c("cls").isNull(), "no-class").otherwise("other-class").alias("reason"))
