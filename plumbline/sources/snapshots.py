"""Snapshots of a tree, what lies between two of them, and who touched what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import next_after


def at_revision(snapshots: DataFrame, sha: str, wanted: DataFrame | None = None) -> DataFrame:
    """Files (rel, hash, missing) of a revision; with `wanted`, just those, marked missing where the revision lacks them."""
    there = snapshots.where(F.col("sha") == sha).select("rel", "hash")
    if wanted is None:
        return there.withColumn("missing", F.lit(False))
    return wanted.select("rel").distinct().join(there, "rel", "left").select("rel", "hash", F.col("hash").isNull().alias("missing"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """status (A, D, M or R), before, after between two snapshots (rel, hash).

    A path that went and one that came with the same content are a rename; where several share a content, they pair in
    order of path. Numbering is by content among changed paths only, so unchanged files are never sorted.
    """
    both = old.select("rel", F.col("hash").alias("was")).join(new.select("rel", F.col("hash").alias("now")), "rel", "full_outer")
    moved = both.where("was IS DISTINCT FROM now")
    nth = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("rel"))
    gone = moved.where("now IS NULL").select(F.col("rel").alias("before"), F.col("was").alias("hash"), nth("was").alias("n"))
    came = moved.where("was IS NULL").select(F.col("rel").alias("after"), F.col("now").alias("hash"), nth("now").alias("n"))
    paired = gone.join(came, ["hash", "n"], "full_outer")
    status = F.when(F.col("before").isNull(), "A").when(F.col("after").isNull(), "D").otherwise("R")
    edited = moved.where("was IS NOT NULL AND now IS NOT NULL").select(F.lit("M").alias("status"), F.col("rel").alias("before"), F.col("rel").alias("after"))
    return paired.select(status.alias("status"), "before", "after").unionByName(edited)


def to_parse(new: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files of `new` (rel, hash) whose content was not parsed before: records of the others are used again."""
    return new.join(parsed.select("hash").distinct(), "hash", "left_anti")


def pending(committed: DataFrame, tree: DataFrame) -> DataFrame:
    """rel, hash, deleted: how a working tree (rel, hash) differs from what is committed."""
    both = committed.select("rel", F.col("hash").alias("_was")).join(tree.select("rel", "hash"), "rel", "full_outer")
    return both.where("NOT (_was <=> hash)").select("rel", "hash", F.col("hash").isNull().alias("deleted"))


def authors(commits: DataFrame, names: DataFrame) -> DataFrame:
    """rel, author: who touched a file, under the name that its path has now; automatic accounts are left out.

    `commits` has seq, path, author; `names` (seq, path, name) says where a path renamed at `seq` ended. A commit is of
    the path's life that ends at the first rename after it.
    """
    people = commits.where(~F.col("author").contains("[bot]")).select("path", "seq", "author")
    ended = next_after(people, names.select("path", "seq"), "path", "seq", "_end")
    held = ended.join(names.select("path", F.col("seq").alias("_end"), "name"), ["path", "_end"], "left")
    return held.select(F.coalesce("name", "path").alias("rel"), "author").distinct()


def attribute(paths: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """path, value: of ordered rules (pattern, value), the last that a path matches; null without one.

    Rules are a file of attributes, some lines long: one expression asks for them from the last on.
    """
    last = F.coalesce(*[F.when(F.col("path").rlike(pattern), F.lit(value)) for pattern, value in reversed(rules)], F.lit(None).cast("string"))
    return paths.select("path").distinct().withColumn("value", last)


def reported(findings: DataFrame, form: str) -> Column:
    """A finding (severity, path, line, message) as a line of text, a JSON record or an annotation."""
    c = F.col
    if form == "json":
        return F.to_json(F.struct("severity", "path", "line", "message"))
    if form == "github":
        level = F.when(c("severity") == "MUST-FIX", "error").when(c("severity") == "FIX", "warning").otherwise("notice")
        return F.concat(F.lit("::"), level, F.lit(" file="), c("path"), F.lit(",line="), c("line").cast("string"), F.lit("::"), c("message"))
    return F.concat(c("severity"), F.lit(" "), c("path"), F.lit(":"), c("line").cast("string"), F.lit(" "), c("message"))
