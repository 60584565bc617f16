"""What lives where: tallies, roots and test lines of a tree, and which files are tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.paths import ancestors, base, directory, suffixes, without_extension
from plumbline.functions.stats import min_root_files
from plumbline.operators.ordering import numbered

BUDGET, WRAPPER_SHARE = 7, 0.8
#: Directory names that say nothing of what is inside, how tests are named, and where they are kept.
SHELL_NAMES = ("src", "lib", "app", "apps", "packages", "source")
TEST_NAME = r"[.-](?:test|spec)\.|\.cy\.|_(?:spec|test)\.rb$"
STORY_NAME = r"\.stories\.[^./]+$"
TEST_DIRS = ("__tests__",)
TEST_ROOTS = ("test", "tests", "spec")
TEST_TREES = (*TEST_ROOTS, "cypress", "e2e", "__tests__")
UNNAMED_RUNNER = "test files"


def tally(rows: DataFrame, value: str, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(by,) value, n, rank: counts of values, most first, ties by value; `most` of them (of each group) if given.

    Over all rows, the first ones are found by a top-k, and a rank of all by a sort by range: no task holds all values.
    """
    counts = rows.groupBy(*(by or []), value).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col(value)]
    if not by:
        return numbered(counts.orderBy(*order).limit(most) if most else counts, order)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def roots(files: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(path, files, source, rank of the directories that tell a tree's layout; one row of what else there is).

    `files` has dir (`.` for the root) and lang (null where a file is no source). From the root, a directory is opened if its
    name is a shell's or one child holds nearly all of it. A directory that is reached and not opened is a root. One that is
    opened gives its own files a line, `(files at this level)`, if they clear the floor; where neither it nor a child has a
    line, it is a root after all. Directories below the floor have no line.

    What is opened depends on a directory and its children alone, and it is reached if all directories above it are opened:
    three aggregates over the directories, without a walk.
    """
    by_dir = files.groupBy("dir").agg(F.count(F.lit(1)).alias("direct"), F.count("lang").alias("direct_source"))
    above = by_dir.select("direct", "direct_source", F.explode(ancestors(F.col("dir"))).alias("path"))
    total = above.groupBy("path").agg(F.sum("direct").alias("files"), F.sum("direct_source").alias("source"))
    floor = files.agg(min_root_files(F.count(F.lit(1))).alias("floor"), F.count(F.lit(1)).alias("all_files"))  # one row
    own = by_dir.select(F.col("dir").alias("path"), "direct", "direct_source")
    children = total.where("path <> '.'").groupBy(directory(F.col("path")).alias("path")).agg(F.max("files").alias("largest"))
    there = total.join(own, "path", "left").join(children, "path", "left").crossJoin(F.broadcast(floor)).fillna(0, ["direct", "direct_source"])
    there = there.withColumn("opened", (F.col("path") == ".") | base(F.col("path")).isin(*SHELL_NAMES) | F.coalesce(F.col("largest") >= WRAPPER_SHARE * F.col("files"), F.lit(False)))
    tall = there.where("path <> '.' AND files >= floor OR path = '.'")
    upward = tall.select("path", F.explode(ancestors(directory(F.col("path")))).alias("up")).where("path <> '.'")
    reached = upward.join(there.select(F.col("path").alias("up"), F.col("opened").alias("up_opened")), "up").groupBy("path").agg(F.bool_and("up_opened").alias("reached")).where("reached")
    seen = tall.join(reached, "path", "left").where("reached OR path = '.'")
    line = lambda path, files, source: F.struct(path.alias("path"), files.alias("files"), source.alias("source"))
    c = F.col
    flat = c("largest").isNull()
    level = (c("path") != ".") & ~flat & (c("direct") >= c("floor"))
    whole = (c("path") != ".") & (~c("opened") | flat | (~level & (c("largest") < c("floor"))))
    alone = (c("path") == ".") & flat & (c("direct") >= c("floor"))
    rows = F.array_compact(F.array(F.when(whole, line(c("path"), c("files"), c("source"))), F.when(c("opened") & level, line(F.concat("path", F.lit(" (files at this level)")), c("direct"), c("direct_source"))), F.when(alone, line(c("path"), c("direct"), c("direct_source")))))
    lines = seen.select("all_files", F.explode(rows).alias("l")).select("all_files", "l.*")
    ranked = numbered(lines, [F.desc("source"), F.desc("files"), "path"])
    more = ranked.agg(F.count_if(c("rank") > budget).alias("more_roots"), F.coalesce(F.sum(F.when(c("rank") <= budget, c("files"))), F.lit(0)).alias("told")).crossJoin(F.broadcast(floor))
    return ranked.where(c("rank") <= budget).select("path", "files", "source", "rank"), more.select("more_roots", (c("all_files") - c("told")).alias("more_files"))


def majority_dirs(files: DataFrame, by: list[str]) -> DataFrame:
    """`by`, files, dir, under: the deepest directory below which nearly all of a group's files are, and how many are; null,
    and all of them, where no directory but the root is that. Two such directories lie above one another."""
    counts = files.groupBy(*by, "dir").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("files"))
    above = counts.select(*by, "n", F.explode(ancestors(F.col("dir"))).alias("up")).where("up <> '.'").groupBy(*by, "up").agg(F.sum("n").alias("under"))
    best = above.join(total, by).where(F.col("under") >= WRAPPER_SHARE * F.col("files")).groupBy(*by).agg(F.max_by(F.struct("up", "under"), F.length("up")).alias("best"))
    return total.join(best, by, "left").select(*by, "files", F.col("best.up").alias("dir"), F.coalesce("best.under", "files").alias("under"))


def packed(lines: DataFrame, by: str, order: list, height: str, budget: int) -> DataFrame:
    """`lines` with `used` (height so far) and `dropped`: what no longer fits a group's budget, from the end."""
    used = F.sum(height).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("used", used).withColumn("dropped", F.col("used") > budget)


def settled(blocks: DataFrame, by: str, order: list, height: str, budget: int) -> DataFrame:
    """`blocks` with `kept` and `named`: which of a group's blocks fit its budget of lines, from the first on.

    Where not all do, one line says so and the hidden ones are named at a line each, as many as half the budget. As many
    blocks stay as leave room for that. A group has a block for each dimension at most.
    """
    over = Window.partitionBy(by)
    cap = max(1, budget // 2)
    upto = F.sum(height).over(over.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    there = blocks.withColumns({"_upto": upto, "_nth": F.row_number().over(over.orderBy(*order)), "_all": F.sum(height).over(over), "_n": F.count(F.lit(1)).over(over)})
    fits = F.col("_upto") + 1 + F.least(F.col("_n") - F.col("_nth"), F.lit(cap)) <= budget
    there = there.withColumn("_last", F.coalesce(F.max(F.when(fits, F.col("_nth"))).over(over), F.lit(0)))
    kept = (F.col("_all") <= budget) | (F.col("_nth") <= F.col("_last"))
    return there.withColumns({"kept": kept, "named": ~kept & (F.col("_nth") - F.col("_last") <= cap)}).drop("_upto", "_nth", "_all", "_n", "_last")


def _within(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a directory on the way to a path has one of the names."""
    return F.arrays_overlap(F.split(directory(path), "/"), F.array(*[F.lit(n) for n in names]))


def under_test_tree(path: Column) -> Column:
    return _within(path, TEST_TREES)


def is_story(path: Column) -> Column:
    return base(path).rlike(STORY_NAME)


def mirrored_tests(files: DataFrame) -> DataFrame:
    """path, distinct: sources in a test root whose place below it is the tail of a source's path outside, two names at least.

    Tails are exploded and joined by equality.
    """
    source = files.where("lang IS NOT NULL").select("path", without_extension(F.col("path")).alias("bare"), (F.instr("path", "/") > 0).alias("deep"), F.substring_index("path", "/", 1).alias("top"))
    in_root = F.col("deep") & F.col("top").isin(*TEST_ROOTS)
    outside = source.where(~in_root).select(F.explode(suffixes(F.col("bare"))).alias("tail")).where("tail LIKE '%/%'").distinct()
    inside = source.where(in_root).select("path", F.expr("substring(bare, length(top) + 2)").alias("tail")).where("tail LIKE '%/%'").distinct()
    return inside.join(outside, "tail", "left_semi").select("path").distinct()


def is_test(path: Column, lang: Column, runner: Column, test_calls: Column, empty: Column, mirrored: Column) -> Column:
    """Whether a file is a test: it imports a runner or calls one, or else holds code and has a test's name, mirrors a source
    or stands in a directory for tests alone."""
    said = runner.isNotNull() | F.coalesce(test_calls, F.lit(False))
    named = base(path).rlike(TEST_NAME) | F.coalesce(mirrored, F.lit(False)) | _within(path, TEST_DIRS)
    return lang.isNotNull() & (said | (~F.coalesce(empty, F.lit(False)) & named))


def runner_of(path: Column, runner: Column) -> Column:
    """What to call a test's runner: as its imports say, else by a directory `cypress`, else unnamed."""
    return F.coalesce(runner, F.when(_within(path, ("cypress",)), F.lit("cypress")), F.lit(UNNAMED_RUNNER))


def test_files(files: DataFrame) -> DataFrame:
    """`files` (path, lang, runner, test_calls, empty) with is_test, is_story and runner_name."""
    mirrored = mirrored_tests(files).withColumn("_mirrored", F.lit(True))
    c = F.col
    there = files.join(mirrored, "path", "left")
    return there.withColumns({"is_test": is_test(c("path"), c("lang"), c("runner"), c("test_calls"), c("empty"), c("_mirrored")), "is_story": is_story(c("path")), "runner_name": runner_of(c("path"), c("runner"))}).drop("_mirrored")


def root_facts(files: DataFrame, root: str) -> DataFrame:
    """`root` and what a line tells of each: files, source, exts (the two commonest), other, jsx, tests, stories, test_root.

    `files` has `root`, ext, lang, jsx, is_test and is_story. A root of which more than half are tests is a test directory.
    """
    exts = tally(files, "ext", [root], 2).groupBy(root).agg(F.array_sort(F.collect_list(F.struct("rank", "ext", "n"))).alias("e"), F.sum("n").alias("told"))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    counts = files.groupBy(root).agg(F.count(F.lit(1)).alias("files"), F.count("lang").alias("source"), flag("jsx").alias("jsx"), flag("is_test").alias("tests"), flag("is_story").alias("stories"))
    told = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["ext"], x["n"])), ",")
    return counts.join(exts, root).select(root, "files", "source", told.alias("exts"), (F.col("files") - F.col("told")).alias("other"), "jsx", "tests", "stories", (F.col("tests") * 2 > F.col("files")).alias("test_root"))
