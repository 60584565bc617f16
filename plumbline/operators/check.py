"""What a change broke: multisets of findings, added lines, overlays and obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import numbered


def introduced(head: DataFrame, base: DataFrame, by: str = "fp", order: list[str] | None = None) -> DataFrame:
    """Rows of `head` beyond as many of the same fingerprint as `base` has: the first ones, by `order`, are cancelled.

    Base is counted before the join; a fingerprint that the base lacks needs no numbering, so a finding that a new change
    repeats a million times is numbered only where there is something to cancel.
    """
    counts = base.groupBy(by).agg(F.count(F.lit(1)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*(order or [by])))
    fresh = head.join(counts, by, "left_anti")
    again = head.join(counts, by).withColumn("_nth", nth).where(F.col("_nth") > F.col("_base")).drop("_nth", "_base")
    return fresh.unionByName(again)


#: Severities, the gravest first.
SEVERITIES = ("MUST-FIX", "FIX", "NIT")


def ordered(findings: DataFrame, collation: str | None = None) -> DataFrame:
    """`findings` (severity, path, line) with `rank`: gravest first, then by path and line, in order of code points, or as a
    `collation` (`UNICODE`, or a locale's, such as `de`) orders paths; paths that it holds for equal go by code points."""
    grave = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    by_locale = [] if collation is None else [F.collate("path", collation)]
    return numbered(findings.withColumn("_grave", grave), ["_grave", *by_locale, "path", F.col("line").asc_nulls_first(), *[c for c in findings.columns if c not in ("path", "line")]]).drop("_grave")


def tallied(findings: DataFrame) -> DataFrame:
    """severity, reason, n."""
    return findings.groupBy("severity", "reason").agg(F.count(F.lit(1)).alias("n"))


def on_added_lines(findings: DataFrame, ranges: DataFrame, bin_: int = 64) -> DataFrame:
    """Findings (path, line) within a range (path, low, high) of their path, each once; null ends match nothing.

    Ranges are dealt to bins of lines, so the join is one of equality on (path, bin).
    """
    binned = ranges.where("low <= high").select("path", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / bin_), F.floor(F.col("high") / bin_))).alias("_bin"))
    hit = findings.withColumn("_bin", F.floor(F.col("line") / bin_)).alias("f").join(binned.alias("r"), (F.col("f.path") == F.col("r.path")) & (F.col("f._bin") == F.col("r._bin")) & F.col("f.line").between(F.col("r.low"), F.col("r.high")), "left_semi")
    return hit.drop("_bin")


def overlaid(committed: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """The committed rows with pending ones in their place; rows pending as deleted are gone."""
    kept = committed.join(pending.select(key).distinct(), key, "left_anti")
    return kept.unionByName(pending.where("NOT deleted").select(committed.columns))


#: Why a check could not answer in full: code, and what it says. `{n}` is a number of files.
CAVEATS = {
    "no-map": "no map states anything, so nothing was checked",
    "no-base-ref": "there is no base to compare with, so what was there before counts as new",
    "nothing-examined": "none of the changed files could be read",
    "head-crashed": "the reader gave no answer for {n}",
    "head-rejected": "{n} could not be parsed",
    "head-oversize": "{n} were too large to read",
    "head-unreadable": "{n} could not be read",
    "base-unparsed": "{n} could not be read as they were before",
}


def caveats(head: DataFrame, base: DataFrame | None, stated: DataFrame) -> DataFrame:
    """code, files, message of what a check of the records `head` (rel, kind) against those of `base` leaves unanswered.

    `stated` is what a map states. Without files there is nothing to examine, and no caveat of it.
    """
    unread = head.where("kind <> 'ok'").groupBy(F.concat(F.lit("head-"), "kind").alias("code")).agg(F.count(F.lit(1)).alias("files"))
    every = head.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("kind") == "ok").alias("_read")).where("files > 0 AND _read = 0").select(F.lit("nothing-examined").alias("code"), "files")
    none = stated.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit("no-map").alias("code"), F.lit(0).cast("long").alias("files"))
    found = unread.unionByName(every).unionByName(none)
    if base is None:
        found = found.unionByName(head.sparkSession.createDataFrame([("no-base-ref", 0)], "code string, files long"))
    else:
        found = found.unionByName(base.where("kind <> 'ok'").groupBy(F.lit("base-unparsed").alias("code")).agg(F.count(F.lit(1)).alias("files")))
    says = F.coalesce(*[F.when(F.col("code") == code, F.lit(text)) for code, text in CAVEATS.items()])
    number = F.concat(F.col("files").cast("string"), F.when(F.col("files") == 1, " file").otherwise(" files"))
    return found.select("code", "files", F.replace(says, F.lit("{n}"), number).alias("message"))
