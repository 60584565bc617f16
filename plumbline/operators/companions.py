"""Files that belong together: companions by derived paths, namesakes, imports and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.paths import ancestors, directory, import_candidates, imported_path, suffixes

MIN_IMPORTERS, MIN_IMPORT_SHARE, TOP_IMPORTS = 5, 0.6, 3
MIN_REUSE, TOP_REUSED = 3, 5


def companions(producers: DataFrame, paths: DataFrame, expected: Column) -> DataFrame:
    """`producers` with companion (the derived path) and there: whether a path of the corpus is it."""
    known = paths.select(F.col("path").alias("companion"), F.lit(True).alias("_known")).distinct()
    return producers.withColumn("companion", expected).join(known, "companion", "left").withColumn("there", F.coalesce("_known", F.lit(False))).drop("_known")


def missing(changed: DataFrame, paths: DataFrame, packages: DataFrame) -> DataFrame:
    """path, companion, elsewhere: changed producers whose companion is not there, by the first package that takes them.

    `packages` (ord, from, to, ext, suffixes: array) are the rows of one obligation, a few, in order of preference; any of
    the suffixes answers it and the first names what is missing. `elsewhere` says that a file of that name is in another place.
    """
    known = paths.select("path").distinct()
    above = changed.select("path").distinct().select("path", F.explode(ancestors(directory(F.col("path")))).alias("from"))
    fits = above.join(packages, "from").where(F.endswith(F.col("path"), F.concat(F.lit("."), "ext")))
    taken = fits.groupBy("path").agg(F.min_by(F.struct("from", "to", "ext", "suffixes"), "ord").alias("k"))
    tail = F.expr("substring(path, length(k.`from`) + 1, length(path) - length(k.`from`) - length(k.ext) - 1)")
    each = taken.withColumn("_tail", tail).where(~F.exists("k.suffixes", lambda s: F.endswith(F.col("path"), s)))
    wanted = each.select("path", F.posexplode(F.transform("k.suffixes", lambda s: F.concat(F.col("k.to"), F.col("_tail"), s))).alias("nth", "companion"))
    met = wanted.join(known.withColumnRenamed("path", "companion"), "companion", "left_semi").select("path")
    open_ = wanted.where("nth = 0").join(met, "path", "left_anti").select("path", "companion", F.substring_index("companion", "/", -1).alias("_base"))
    named = known.select(F.substring_index("path", "/", -1).alias("_base")).distinct().withColumn("_there", F.lit(True))
    return open_.join(named, "_base", "left").select("path", "companion", F.coalesce("_there", F.lit(False)).alias("elsewhere"))


def stem_extras(tests: DataFrame, sources: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """dir, lang, extra, n: what tests (dir, lang, stem) add to the stem of a source (lang, stem), where as many of a
    directory's tests do as `least` and `share` ask for.

    A test that has a source of its own stem adds nothing; of several sources whose stem begins a test's, the longest counts,
    and what follows must begin with a separator. Stems are cut at every place and joined by equality.
    """
    known = sources.select("lang", "stem").distinct()
    total = tests.groupBy("dir").agg(F.count(F.lit(1)).alias("_tests"))
    loose = tests.join(known, ["lang", "stem"], "left_anti").withColumn("_test", F.monotonically_increasing_id())
    cut = loose.where("length(stem) > 1").select("_test", "dir", "lang", F.col("stem").alias("_stem"), F.explode(F.expr("transform(sequence(1, length(stem) - 1), n -> left(stem, n))")).alias("stem"))
    longest = cut.join(known, ["lang", "stem"]).groupBy("_test", "dir", "lang", "_stem").agg(F.max(F.length("stem")).alias("_n"))
    extra = F.expr("substring(_stem, _n + 1)")
    counts = longest.select("dir", "lang", extra.alias("extra")).where(F.col("extra").rlike("^[._-]")).groupBy("dir", "lang", "extra").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total, "dir").where((F.col("n") >= least) & (F.col("n") >= share * F.col("_tests"))).select("dir", "lang", "extra", "n")


def namesake_ratio(answers: DataFrame, by: list[str]) -> DataFrame:
    """`by`, of, answered, root of source files (answered, place): how many have a test of their name, and the place that at
    least half of these, and two at least, agree on. The tie goes to the least place; an empty one is none."""
    counts = answers.groupBy(*by).agg(F.count(F.lit(1)).alias("of"), F.count_if("answered").alias("answered"))
    votes = answers.where("answered AND place IS NOT NULL").groupBy(*by, "place").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("minus"), "place")).alias("_top"))
    agreed = (F.col("answered") > 1) & (-2 * F.col("_top.minus") >= F.col("answered"))
    return counts.join(top, by, "left").select(*by, "of", "answered", F.when(agreed, F.nullif(F.col("_top.place"), F.lit(""))).alias("root"))


def root_vote(producers: DataFrame, companions: DataFrame, declared: str) -> DataFrame:
    """root, votes: the prefix before a producer's tail that most companions have; on a tie the declared root if it is
    among the first, else null. Companions are exploded to their tails: no pair of paths is compared."""
    tails = companions.select("path", F.explode(suffixes(F.col("path"))).alias("tail"))
    hits = tails.join(producers.select("tail").distinct(), "tail")
    prefix = F.expr("CASE WHEN path = tail THEN '' ELSE substring(path, 1, length(path) - length(tail) - 1) END")
    votes = hits.groupBy(prefix.alias("root")).agg(F.count(F.lit(1)).alias("n"))
    best = votes.agg(F.max("n").alias("best"))
    top = votes.crossJoin(F.broadcast(best)).where("n = best").agg(F.count(F.lit(1)).alias("ties"), F.min("root").alias("least"), F.bool_or(F.col("root") == declared).alias("declared"), F.max("n").alias("votes"))
    return top.where("ties > 0").select(F.when(F.col("ties") == 1, F.col("least")).when(F.col("declared"), declared).alias("root"), "votes")


def learned_suffixes(endings: DataFrame, by: list[str], least: int = 3, share: float = 0.2) -> DataFrame:
    """`by`, suffix, n of endings (by, suffix) that at least `least` and `share` of the group's rows have."""
    counts = endings.groupBy(*by, "suffix").agg(F.count(F.lit(1)).alias("n"))
    total = endings.groupBy(*by).agg(F.count(F.lit(1)).alias("producers"))
    return counts.join(total, by).where((F.col("n") >= least) & (F.col("n") >= share * F.col("producers"))).select(*by, "suffix", "n", "producers")


def namesakes(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """source, test, how: tests of the same stem, one source each: whole path below the root first, then the same
    directory name, then the stem alone; among equals the least source.

    Each way is a join by equality with one row a key, so a stem that thousands of files share makes no pairs.
    """
    last = lambda dir_: F.substring_index(dir_, "/", -1)
    each = tests.select("stem", F.col("path").alias("test"), F.col("dir"), last("dir").alias("_last")).distinct()
    ways = (("whole", ["stem", "dir"]), ("mirrored", ["stem", "_last"]), ("stem", ["stem"]))
    known = sources.select("stem", F.col("path").alias("_source"), F.col("dir"), last("dir").alias("_last"))
    for how, keys in ways:
        each = each.join(known.groupBy(*keys).agg(F.min("_source").alias(f"_{how}_source")), keys, "left")
    found = [F.when(F.col(f"_{how}_source").isNotNull(), F.struct(F.col(f"_{how}_source").alias("source"), F.lit(how).alias("how"))) for how, _ in ways]
    return each.withColumn("_b", F.coalesce(*found)).where("_b IS NOT NULL").select("test", "_b.source", "_b.how")


def owners(sources: DataFrame, tests: DataFrame, covers: DataFrame) -> DataFrame:
    """test, owner: the one source file that each test was written for, null where that is not decided.

    `sources` and `tests` have lang, stem, path and bare (the directory without words that only name a tree), `covers` has the
    sources (test, path) that a test imports. Only a stem that several sources of the language share is contested: the
    sources that share most of the directory's last parts with the test win, and an import among them breaks a tie; a test
    that imports one source and mirrors another owns neither. Directories are exploded to their endings, which are counted
    once and joined by equality, so a stem that thousands of files share makes no pairs.
    """
    by = ["lang", "stem"]
    parts = F.filter(F.split("bare", "/"), lambda p: p != "")
    ends = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("shared"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("ending")))
    source_ends = sources.select(*by, "path", F.explode(ends).alias("e")).select(*by, "path", "e.*")
    index = source_ends.groupBy(*by, "shared", "ending").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_first"))
    asked = tests.select(*by, F.col("path").alias("test"), F.explode(ends).alias("e")).select(*by, "test", "e.*")
    met = asked.join(index, [*by, "shared", "ending"])
    best = met.groupBy(*by, "test").agg(F.max_by(F.struct("shared", "ending", "_n", "_first"), "shared").alias("b"), F.max(F.when(F.col("shared") == 0, F.col("_n"))).alias("_sources")).where("_sources > 1")
    # of the sources that a test imports, those of its own stem, and whether they are among the winners
    own = covers.select("test", "path").distinct().join(sources.select(*by, "path", "bare"), "path").join(best.select(*by, "test", F.col("b.shared").alias("_shared"), F.col("b.ending").alias("_ending")), [*by, "test"])
    mine = F.array_join(F.slice(parts, F.size(parts) - F.col("_shared") + 1, F.col("_shared")), "/")
    wins = (F.size(parts) >= F.col("_shared")) & (mine == F.col("_ending"))
    said = own.groupBy("test").agg(F.count(F.lit(1)).alias("_imports"), F.min("path").alias("_import"), F.bool_and(wins).alias("_wins"), F.collect_set(F.when(wins, F.col("path"))).alias("_winners"))
    there = best.join(said, "test", "left")
    alone = F.when(F.col("_imports").isNull() | F.array_contains("_winners", F.col("b._first")), F.col("b._first"))
    tied = F.when((F.col("_imports") == 1) & F.col("_wins"), F.col("_import"))
    decided = there.select("test", F.when(F.col("b._n") == 1, alone).otherwise(tied).alias("owner"))
    return tests.select(F.col("path").alias("test")).distinct().join(decided, "test", "left")


def resolved_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """`imports` (importer, specifier) with target: the one path that ends in the specifier; null if several do or none.

    Paths are exploded to their tails; tails of more than one path are no targets.
    """
    index = paths.select("path", F.explode(suffixes(F.col("path"))).alias("specifier")).groupBy("specifier").agg(F.min("path").alias("target"), F.max("path").alias("_last")).where("target = _last").drop("_last")
    return imports.join(index, "specifier", "left").select("importer", "specifier", "target")


def relative_imports(imports: DataFrame, paths: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """importer, specifier, target of imports (importer, dir, specifier): the first candidate that is a path; else null."""
    each = imports.select("importer", "specifier", F.posexplode(import_candidates(imported_path(F.col("dir"), F.col("specifier")), extensions)).alias("nth", "path"))
    found = each.join(paths.select("path").distinct(), "path").groupBy("importer", "specifier").agg(F.min_by("path", "nth").alias("target"))
    return imports.select("importer", "specifier").distinct().join(found, ["importer", "specifier"], "left")


def common_imports(imports: DataFrame, by: str) -> DataFrame:
    """by, module, importers, files, share: modules that most importing files of a group import, three at most."""
    once = imports.select(by, "importer", "module").distinct()
    files = once.select(by, "importer").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= MIN_IMPORTERS)
    counts = once.groupBy(by, "module").agg(F.count(F.lit(1)).alias("importers")).join(files, by)
    share = F.col("importers") / F.col("files")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importers"), "module"))
    return counts.withColumn("share", share).where(F.col("share") >= MIN_IMPORT_SHARE).withColumn("rank", rank).where(F.col("rank") <= TOP_IMPORTS)


def most_imported(imports: DataFrame, by: str) -> DataFrame:
    """by, module, importers: modules with most importers of other groups than their own, five at most."""
    outside = imports.where(F.col(by) != F.col("importer_group")).select(by, "module", "importer").distinct()
    counts = outside.groupBy(by, "module").agg(F.count(F.lit(1)).alias("importers")).where(F.col("importers") >= MIN_REUSE)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importers"), "module"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= TOP_REUSED)
