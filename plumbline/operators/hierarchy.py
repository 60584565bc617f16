"""Directory hierarchies as paths: owners, cumulative counts, discovery of areas and what globs reach.

A path is exploded to its ancestors and joined by equality; nothing compares prefixes of pairs.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import ancestors, base, directory
from plumbline.functions.stats import area_floor


def cumulative(files: DataFrame, dir_: str = "dir") -> DataFrame:
    """path, files: files in each directory's whole subtree. Directories are counted before they are exploded."""
    by_dir = files.groupBy(dir_).agg(F.count(F.lit(1)).alias("n"))
    return by_dir.select(F.explode(ancestors(F.col(dir_))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("files"))


def deepest(paths: DataFrame, areas: DataFrame, path: str = "path", area: str = "area") -> DataFrame:
    """Each distinct path with `owner`: the deepest area that is the path or above it, null if none is."""
    each = paths.select(path).distinct()
    above = each.select(path, F.explode(ancestors(F.col(path))).alias("_above"))
    owned = above.join(areas.select(F.col(area).alias("_above")).distinct(), "_above").groupBy(path).agg(F.max_by("_above", F.length("_above")).alias("owner"))
    return each.join(owned, path, "left")


def discover(files: DataFrame, min_files: Column | None = None, dir_: str = "dir") -> DataFrame:
    """area, files: directories that stand for their subtrees.

    A directory's files go to its nearest ancestor, itself first, whose whole subtree has `min_files` and whose path a glob
    can spell; the root is none.
    Areas that end with fewer than that themselves are left out.
    """
    by_dir = files.groupBy(dir_).agg(F.count(F.lit(1)).alias("n"))
    least = min_files if min_files is not None else area_floor(F.col("total"))
    total = by_dir.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(least.alias("least"))  # one row
    above = by_dir.select(dir_, "n", F.explode(ancestors(F.col(dir_))).alias("path"))
    large = above.groupBy("path").agg(F.sum("n").alias("below")).crossJoin(F.broadcast(total)).where("path <> '.' AND below >= least").where(~F.col("path").rlike(GLOB_SYNTAX)).select("path", "least")
    home = above.join(large, "path").groupBy(dir_, "n", "least").agg(F.max_by("path", F.length("path")).alias("area"))
    return home.groupBy("area", "least").agg(F.sum("n").alias("files")).where("files >= least").select("area", "files")


#: Characters that a glob does not take as they are; a directory named with one is never an area.
GLOB_SYNTAX = r"[*?\[\]{}!]"


def fold(areas: Iterable[tuple[str, int]], most: int) -> tuple[list[tuple[str, int]], int]:
    """(areas, orphaned files): the smallest areas folded into their nearest ancestor area, or a new parent, until `most` are
    left; never into the root, nor into a directory that no glob spells. Files that find no home are orphaned.

    Each step depends on the one before it. Areas are taken in order of their first size; a new parent queues behind them.
    """
    size = dict(areas)
    queue = deque(sorted(size, key=lambda p: (size[p], p)))
    orphaned = 0
    while len(size) > most and queue:
        victim = queue.popleft()
        if victim not in size:
            continue
        parts = victim.split("/")
        chain = [p for n in range(len(parts) - 1, 0, -1) if not re.search(GLOB_SYNTAX, p := "/".join(parts[:n]))]
        host = next((p for p in chain if p in size), chain[0] if chain else None)
        n = size.pop(victim)
        if host is None:
            orphaned += n
            continue
        if host not in size:
            queue.append(host)
        size[host] = size.get(host, 0) + n
    return sorted(size.items()), orphaned


def folded(areas: DataFrame, most: int) -> DataFrame:
    """tree, area, files of areas (tree, area, files), `most` to a tree; a null area holds what was orphaned.

    A tree's areas, a row a directory of one repository, are folded by one task; trees by as many as there are.
    """

    def one(table: pa.Table) -> pa.Table:
        kept, orphaned = fold(zip(table["area"].to_pylist(), table["files"].to_pylist(), strict=True), most)
        kept += [(None, orphaned)] if orphaned else []
        return pa.table({"tree": pa.array([table["tree"][0].as_py()] * len(kept), pa.string()), "area": pa.array([a for a, _ in kept], pa.string()), "files": pa.array([n for _, n in kept], pa.int64())})

    return areas.select("tree", "area", "files").groupBy("tree").applyInArrow(one, "tree string, area string, files long")


def reach(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """path, area, reached: whether an area's globs reach a path: one that is not negated does, and none that is.

    `globs` has area, dir (empty for the root), deep, exts (array), negated and, if some name files without an extension,
    names (array). A path meets the globs of its ancestors by equality of directories.
    """
    each = paths.select("path", directory(F.col("path"), "").alias("_dir"), F.regexp_extract(F.col("path"), r"[^/]\.([^./]+)$", 1).alias("_ext"), base(F.col("path")).alias("_base")).distinct()
    above = each.select("path", "_dir", "_ext", "_base", F.explode(F.transform(ancestors(F.when(F.col("_dir") == "", ".").otherwise(F.col("_dir"))), lambda a: F.when(a == ".", "").otherwise(a))).alias("dir"))
    spelled = F.array_contains("exts", F.col("_ext"))
    if "names" in globs.columns:
        spelled = spelled | F.array_contains("names", F.col("_base"))
    hits = above.join(globs, "dir").where((F.col("deep") | (F.col("_dir") == F.col("dir"))) & spelled)
    return hits.groupBy("path", "area").agg((F.bool_or(~F.col("negated")) & ~F.bool_or("negated")).alias("reached"))


def nearest_stating(slots: DataFrame, areas: DataFrame) -> DataFrame:
    """area, key, from_area: for each area and dimension, the deepest area at or above it that states the dimension."""
    stating = slots.where(F.col("states").isNotNull()).select(F.col("area").alias("_above"), "key").distinct()
    above = areas.select("area").distinct().select("area", F.explode(ancestors(F.col("area"))).alias("_above"))
    return above.join(stating, "_above").groupBy("area", "key").agg(F.max_by("_above", F.length("_above")).alias("from_area"))
