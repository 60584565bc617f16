"""Trees of files: which of them are source, and why the others are not."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that are never read, directories that are not counted, and marks of generated files.
DENIED = (r"(^|/)\.git(/|$)", r"(^|/)\.env($|\.)", r"(?i)\.(pem|key|p12|pfx|jks|keystore)$", r"(^|/)\.claude/settings\.local\.json$", r"(^|/)(id_rsa|id_ed25519|\.netrc|\.npmrc)$")
EXCLUDED_DIRS = (
    r"(^|/)node_modules(/|$)",
    r"(^|/)vendor(/|$)",
    r"(^|/)\.yarn(/|$)",
    r"(^|/)__fixtures__(/|$)",
    r"(^|/)(\w*_)?fixtures?(/|$)",
    r"(^|/)__snapshots__(/|$)",
    r"(^|/)snapshots?(/|$)",
    r"(^|/)test_cases(/|$)",
    r"(^|/)testdata(/|$)",
    r"(^|/)test-data(/|$)",
    r"(^|/)goldens?([-_]tests?)?(/|$)",
    r"(^|/)__mocks__(/|$)",
    r"(^|/)mocks(/|$)",
    r"(^|/)(cases|[a-zA-Z]*[a-z]Cases)(/|$)",
    r"(^|/)dist(/|$)",
    r"(^|/)coverage(/|$)",
    r"(^|/)\.next(/|$)",
)
GENERATED_MARKER = r"@generated|Code generated by"
HEAD_BYTES, HEAD_LINES = 4096, 10
SOURCE = r"\.(cjs|js|jsx|mjs|cts|mts|ts|tsx|rb|rake)$|(^|/)(Gemfile|Rakefile)$"
ORDER = ("denied", "excluded", "not-source", "escaped", "generated")


def _any(path: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(p)
    return found


def is_excluded(path: Column) -> Column:
    """In a directory that is not counted, or below `build` where no `src` comes before it."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "build")
    built = (at > 0) & ~F.array_contains(F.slice(parts, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))), "src")
    return _any(path, EXCLUDED_DIRS) | built


def is_generated(content: Column) -> Column:
    """A generator's mark in the first lines, or DO NOT EDIT there beside a word about generation."""
    head = F.array_join(F.slice(F.split(F.substring(content, 1, HEAD_BYTES), "\n"), 1, HEAD_LINES), "\n")
    return F.coalesce(head.rlike(GENERATED_MARKER) | (head.rlike("DO NOT EDIT") & head.rlike("(?i)generated|generator")), F.lit(False))


def drop_reason(path: Column, content: Column, escaped: Column) -> Column:
    """Why a tracked file is not in the corpus; null if it is. The first reason of ORDER counts."""
    rules = (_any(path, DENIED), is_excluded(path), ~path.rlike(SOURCE), escaped, is_generated(content))
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in zip(ORDER, rules, strict=True)])


def untracked(there: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row, n: source files (rel) below a root that are not tracked; asked where the corpus is empty."""
    rel = F.col("rel")
    source = there.where(rel.rlike(SOURCE) & ~is_excluded(rel) & ~_any(rel, DENIED))
    return source.select("rel").distinct().join(tracked.select("rel"), "rel", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def contained(path: Column) -> Column:
    """Whether a relative path stays below its root, whatever `.` and `..` it holds: never above it on its way."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "..", -1).when((part == "") | (part == "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    return ~path.startswith("/") & (F.aggregate(F.split(path, "/"), begin, step, lambda s: s["least"]) >= 0)


def scan(spark: SparkSession, root: str, max_bytes: int = 1 << 20) -> DataFrame:
    """rel, content, drop_reason of the files below `root`; files over `max_bytes` are listed as `oversize`, unread.

    Spark lists no link out of the root as a file of it; a path that leaves the root all the same is `escaped`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = lambda path: re.sub(r"^[a-z0-9+.-]+:/*(?=/)", "", path)
    under = F.regexp_replace("path", r"^[a-z0-9+.-]+:/*(?=/)", "")
    rel = F.when(under.startswith(f"{plain(root).rstrip('/')}/"), F.substring(under, len(plain(root).rstrip("/")) + 2, 2**31 - 1)).otherwise(under)
    small = F.col("length") <= max_bytes
    there = files.select(rel.alias("rel"), "length", F.when(small, F.col("content").cast("string")).alias("content"))
    return there.withColumn("drop_reason", F.when(F.col("length") > max_bytes, "oversize").otherwise(drop_reason(F.col("rel"), F.col("content"), ~contained(F.col("rel")))))
