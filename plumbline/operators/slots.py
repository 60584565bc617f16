"""Sites to slots: one row for each area and dimension, counted in two steps, by file and then by slot.

The first step bounds the second: an area's sites are summed where they are read, and what is shuffled by slot has a row a
file at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ["area", "key"]


def file_counts(sites: DataFrame) -> DataFrame:
    """area, key, rel, candidates, conforming."""
    return sites.groupBy(*SLOT, "rel").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("conforming").alias("conforming"))


def slot_counts(by_file: DataFrame) -> DataFrame:
    """Counts of each slot, the inverse Simpson number of its files (as exact integers) and its largest file.

    Of files with equally many sites, the least `rel` is the largest.
    """
    c = F.col("candidates")
    top = F.min(F.struct((-c).alias("minus"), "rel", "conforming"))
    counted = by_file.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("applicability"), F.sum(c).alias("candidates"), F.sum("conforming").alias("conforming"), F.sum(c * c).alias("squares"), top.alias("top"))
    return counted.select(*SLOT, "applicability", "candidates", "conforming", "squares", (-F.col("top.minus")).alias("top_candidates"), F.col("top.conforming").alias("top_conforming"))


def effective_files(candidates: Column, squares: Column) -> Column:
    return F.when(squares > 0, candidates * candidates / squares).otherwise(F.lit(0.0))


def spread(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Of each slot: authors and directories of its sites; of its area: directories and files."""
    authors = sites.select(*SLOT, "author").distinct().groupBy(*SLOT).agg(F.count_if(F.col("author").isNotNull()).alias("authors"))
    dirs = sites.select(*SLOT, "dir").distinct().groupBy(*SLOT).agg(F.count(F.lit(1)).alias("dirs"))
    area_dirs = files.groupBy("area", "dir").agg(F.count(F.lit(1)).alias("n")).groupBy("area").agg(F.count(F.lit(1)).alias("area_dirs"), F.sum("n").alias("area_files"))
    return authors.join(dirs, SLOT).join(area_dirs, "area")


def denominators(files: DataFrame, dimensions: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """area, key, lang_files: files that a dimension could be seen in, with or without a site of it.

    A file counts where the dimension knows its language, unless it was stripped and the dimension is blind then, or holds
    no type syntax (`typed`, if the files have it) and the dimension needs some. Files are counted by what decides that
    before they meet the dimensions: a few rows an area. Files that were not read are the caller's to leave out. With
    `kinds` (area, key, kind), a slot that it names counts files of that `kind` only.
    """
    sees = ~(F.col("stripped") & F.col("blind"))
    alike = ["area", "lang", "stripped", *[c for c in ("typed", "kind") if c in files.columns]]
    if "typed" in alike:
        sees = sees & ~(F.col("needs_types") & ~F.col("typed"))
    counted = files.groupBy(*alike).agg(F.count(F.lit(1)).alias("_files"))
    by_lang = dimensions.withColumn("lang", F.explode(F.array_distinct("langs")))  # a row a dimension and language of the registry
    seen = counted.join(F.broadcast(by_lang), "lang").where(sees)
    if kinds is not None:
        seen = seen.join(kinds.select("area", "key", F.col("kind").alias("_kind")), SLOT, "left").where("_kind IS NULL OR kind = _kind")
    return seen.groupBy("area", "key").agg(F.sum("_files").alias("lang_files"))


def pooled(slots: DataFrame, by: list[str], blocked: Column | None = None) -> DataFrame:
    """`slots` with rest_candidates and rest_conforming: sums over all other slots of the same claim that are not blocked."""
    open_ = F.lit(True) if blocked is None else ~blocked
    counts = ("candidates", "conforming")
    own = lambda c: F.when(open_, F.col(c)).otherwise(0)
    pool = slots.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.sum(own(c)).alias(f"_all_{c}") for c in counts])  # a row a claim
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    rest = [F.greatest(F.coalesce(f"_all_{c}", F.lit(0)) - own(c), F.lit(0)).alias(f"rest_{c}") for c in counts]
    return slots.join(pool, same, "left").select(*[F.col(f"`{c}`") for c in slots.columns], *rest)


def exceptions(by_file: DataFrame, most: int = 3) -> DataFrame:
    """area, key, exceptions (the files with most sites that do not conform, ties by path) and how many more there are."""
    bad = by_file.withColumn("bad", F.col("candidates") - F.col("conforming")).where("bad > 0")
    total = bad.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*SLOT).orderBy(F.desc("bad"), "rel"))
    top = bad.withColumn("rank", rank).where(F.col("rank") <= most).groupBy(*SLOT).agg(F.array_sort(F.collect_list(F.struct("rank", "rel", "bad"))).alias("listed"))
    told = F.array_join(F.transform("listed", lambda x: F.concat_ws(":", x["rel"], x["bad"])), ",")
    return top.join(total, SLOT).select(*SLOT, told.alias("exceptions"), F.greatest(F.col("n") - most, F.lit(0)).alias("more_exceptions"))


def listed(by_file: DataFrame, most: int = 3) -> DataFrame:
    """area, key, rel: the files that `exceptions` names, a row each, from rows that have `bad`."""
    rank = F.row_number().over(Window.partitionBy(*SLOT).orderBy(F.desc("bad"), "rel"))
    return by_file.where("bad > 0").withColumn("rank", rank).where(F.col("rank") <= most).select(*SLOT, "rel")


def learned(sites: DataFrame, by: list[str], cls: str = "class", group: str | None = None) -> DataFrame:
    """`by`, learned, votes: the class that most sites have. A tie at the top gives null, which no slot can state.

    Sites without a class do not vote. With `group`, rows of one group vote once for each class that they name.
    """
    votes = sites.where(F.col(cls).isNotNull())
    if group:
        own = votes.where(F.col(group).isNotNull()).dropDuplicates([*by, group, cls])
        votes = votes.where(F.col(group).isNull()).unionByName(own)
    counts = votes.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", cls)).alias("best"), F.min(F.struct(-F.col("n"), F.col(cls))).alias("other"))
    # max takes the last class of the largest count, min the first: they differ just when there is a tie
    tie = F.col(f"best.{cls}") != F.col(f"other.{cls}")
    return best.select(*by, F.when(~tie, F.col(f"best.{cls}")).alias("learned"), F.col("best.n").alias("votes"))


def collapsed(sites: DataFrame, by: list[str], group: str) -> DataFrame:
    """One site for each group, conforming if any row of it is; rows without a group stay as they are."""
    own = sites.where(F.col(group).isNotNull()).groupBy(*by, group).agg(F.bool_or("conforming").alias("conforming"))
    return own.unionByName(sites.where(F.col(group).isNull()).select(*by, group, "conforming"))


def majority_kind(files: DataFrame, by: list[str], kind: str, wins_ties: str) -> DataFrame:
    """`by`, kind: the kind of most files; `wins_ties` among equals, then the least."""
    counts = files.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(-F.col("n"), F.when(F.col(kind) == wins_ties, 0).otherwise(1), F.col(kind)))
    return counts.groupBy(*by).agg(first.alias("first"), F.sum("n").alias("files")).select(*by, F.col(f"first.{kind}").alias("kind"), "files")
