"""Nodes to sites: all tree dimensions of the registry over one scan of the nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.paths import base, classify_basename, directory, names_a_site
from plumbline.registry import DIMENSIONS, Dimension

NODES = "rel string, pre int, post int, depth int, type string, name string, above array<string>, fn int, cls int, line int, attrs map<string,string>"
SITES = ["rel", "key", "pre", "line", "conforming", "class", "grp"]
SITES_SCHEMA = "rel string, key string, pre int, line int, conforming boolean, class string, grp int"
MIN_CAPABLE_FILES = 3


def _struct(d: Dimension) -> Column:
    # an attribute that is not there makes a predicate null: the site does not conform
    conforming = F.coalesce(F.expr(d.conforming), F.lit(False)) if d.conforming and not d.inner and not d.per_file else F.lit(None).cast("boolean")
    return F.struct(F.lit(d.key).alias("key"), conforming.alias("conforming"), F.expr(d.cls or "CAST(NULL AS STRING)").alias("class"), (F.expr(d.grouped) if d.grouped else F.lit(None)).cast("int").alias("grp"))


def _holding(sites: DataFrame, nodes: DataFrame, dimensions: list[Dimension]) -> DataFrame:
    """rel, key, pre of the sites that hold a node that their dimension asks for.

    Of the nodes of one kind, and one key where the kind has one, the next after a site is in it just if its place is not
    past the site's last: one ordered pass over both, for all kinds together, and no pair of a site and a node.
    """
    kinds = [(d.key, nth, *kind) for d in dimensions for nth, kind in enumerate(d.inner)]
    none = F.lit(None).cast("int")
    asks = F.array_compact(F.array(*[F.when(F.col("n.key") == key, F.struct(F.lit(nth).alias("nth"), F.expr(mine or "''").alias("by"))) for key, nth, _, mine, _ in kinds]))
    there = F.array_compact(F.array(*[F.when(F.expr(holds), F.struct(F.lit(key).alias("key"), F.lit(nth).alias("nth"), F.expr(theirs or "''").alias("by"))) for key, nth, holds, _, theirs in kinds]))
    asking = sites.alias("n").select("rel", "key", "pre", "post", F.explode(asks).alias("a")).select("rel", "key", "a.nth", "a.by", "pre", "post")
    inside = nodes.alias("i").select("rel", "pre", F.explode(there).alias("a")).select("rel", "a.key", "a.nth", "a.by", "pre", none.alias("post"))
    behind = Window.partitionBy("rel", "key", "nth", "by").orderBy(F.desc("pre"), F.col("post").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    next_ = F.last(F.when(F.col("post").isNull(), F.col("pre")), ignorenulls=True).over(behind)
    both = asking.unionByName(inside).where("by IS NOT NULL").withColumn("_next", next_)
    return both.where("post IS NOT NULL AND _next <= post").select("rel", "key", "pre").distinct()


def tree_sites(nodes: DataFrame, dimensions: tuple[Dimension, ...] = DIMENSIONS) -> DataFrame:
    """rel, key, pre, line, conforming, class, grp: a row for each node that is a site of a dimension.

    Predicates over the node alone are one projection, exploded. Those over what the node holds take one ordered pass over a
    file's nodes, for all such dimensions together; these are bounded by the size of files that are read.
    """
    tree = [d for d in dimensions if d.kind == "tree"]
    if not tree:
        return nodes.sparkSession.createDataFrame([], SITES_SCHEMA)
    each = F.array_compact(F.array(*[F.when(F.expr(d.site), _struct(d)) for d in tree]))
    found = nodes.alias("n").select("n.*", F.explode(each).alias("d")).select("n.*", "d.*")
    inner, per_file = [d for d in tree if d.inner], [d for d in tree if d.per_file]
    special = [d.key for d in (*inner, *per_file)]
    out = found.where(~F.col("key").isin(special)).select(SITES) if special else found.select(SITES)
    if inner:
        sites = found.where(F.col("key").isin([d.key for d in inner]))
        held = _holding(sites, nodes, inner).withColumn("_held", F.lit(True))
        both = sites.join(held, ["rel", "key", "pre"], "left").withColumn("held", F.coalesce("_held", F.lit(False))).alias("n")
        verdict = F.coalesce(*[F.when(F.col("n.key") == d.key, F.expr(d.conforming)) for d in inner], F.lit(False))
        out = out.unionByName(both.withColumn("conforming", verdict).select(SITES))
    for d in per_file:
        one = found.where(F.col("key") == d.key).groupBy("rel", "key").agg(F.min("pre").alias("pre"), F.min("line").alias("line"), F.count_distinct("name").alias("names"))
        out = out.unionByName(one.select("rel", "key", "pre", "line", F.expr(d.conforming).alias("conforming"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("int").alias("grp")))
    return out


def naming_sites(files: DataFrame) -> DataFrame:
    """Sites of the file-naming dimension: file names that can agree or disagree with a class."""
    rel = F.col("rel")
    none = lambda kind: F.lit(None).cast(kind)
    return files.where(names_a_site(rel)).select("rel", F.lit("file_naming_case").alias("key"), none("int").alias("pre"), none("int").alias("line"), none("boolean").alias("conforming"), classify_basename(rel).alias("class"), none("int").alias("grp"))


def pairing_sites(files: DataFrame, dimensions: tuple[Dimension, ...] = DIMENSIONS, producers: DataFrame | None = None) -> DataFrame:
    """Sites of the pairing dimensions: producers, conforming where their companion is a file. One join for all of them.

    Files that could not be read are left out of `producers` by the caller; they are companions all the same.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rules = [d for d in dimensions if d.kind == "pairing"]
    if not rules:
        return files.sparkSession.createDataFrame([], SITES_SCHEMA)
    rel = F.col("rel")

    def expected(d: Dimension) -> Column:
        inside = rel.startswith(f"{d.from_}/") & rel.endswith(f".{d.ext}") & ~rel.endswith(d.suffix) & ~rel.rlike(r"(^|/)base(_[^/]*)?\.[^./]+$")
        tail = F.expr(f"substring(rel, {len(d.from_) + 1}, length(rel) - {len(d.from_) + len(d.ext) + 1})")
        return F.when(inside, F.struct(F.lit(d.key).alias("key"), F.concat(F.lit(d.to), tail, F.lit(d.suffix)).alias("companion")))

    wanted = (files if producers is None else producers).select("rel", F.explode(F.array_compact(F.array(*[expected(d) for d in rules]))).alias("d")).select("rel", "d.*")
    known = files.select(F.col("rel").alias("companion"), F.lit(True).alias("_known")).distinct()
    return wanted.join(known, "companion", "left").select("rel", "key", none("int").alias("pre"), none("int").alias("line"), F.coalesce("_known", F.lit(False)).alias("conforming"), none("string").alias("class"), none("int").alias("grp"))


def file_kinds(nodes: DataFrame) -> DataFrame:
    """rel, kind of the files that hold JSX; all others are modules."""
    return nodes.where(F.col("type").startswith("JSX")).select("rel", F.lit("jsx").alias("kind")).distinct()


def placed(sites: DataFrame, nodes: DataFrame, dimensions: tuple[Dimension, ...] = DIMENSIONS) -> DataFrame:
    """`sites` with kind (of their file, where the dimension splits by it), and nesting and self (where its classes are
    constants): the scopes around a site, the innermost first, and the name of the class that it is about.

    A file's modules and classes are one row, bounded by the size of files that are read; sites join it by file.
    """
    split, constants = [d.key for d in dimensions if d.split], [d.key for d in dimensions if d.constants]
    none = F.lit(None).cast("string")
    plain = sites.where(~F.col("key").isin(*split, *constants)).withColumns({"kind": none, "nesting": F.lit(None).cast("array<string>"), "self": none})
    kinds = sites.where(F.col("key").isin(split)).join(file_kinds(nodes), "rel", "left").withColumns({"kind": F.coalesce("kind", F.lit("module")), "nesting": F.lit(None).cast("array<string>"), "self": none})
    bodies = nodes.where(F.col("type").isin("Module", "Class")).groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("pre", "post", "name", "type"))).alias("_bodies"))
    around = F.filter("_bodies", lambda b: (b["pre"] < F.col("pre")) & (F.col("pre") <= b["post"]))
    names = F.transform(around, lambda b: b["name"])
    nesting = F.reverse(F.transform(names, lambda _, i: F.array_join(F.slice(names, 1, i + 1), "::")))
    own = F.element_at(F.filter("_bodies", lambda b: (b["pre"] == F.col("pre")) & (b["type"] == "Class")), 1)["name"]
    full = F.when(own.isNotNull(), F.concat_ws("::", F.array_join(names, "::"), own))
    told = F.when(F.size(names) > 0, full).otherwise(own)
    scoped = sites.where(F.col("key").isin(constants)).join(bodies, "rel", "left").withColumns({"kind": none, "nesting": F.coalesce(nesting, F.array().cast("array<string>")), "self": F.when(F.col("key") == "class_base", told)}).drop("_bodies")
    return plain.unionByName(kinds).unionByName(scoped)


#: Paths that show a framework in use, with the language of the files that count; words of a wrapper's path.
FRAMEWORKS = {"rails": ("ruby", r"(^|/)(app/models/|db/migrate/|config/application\.rb$)")}
CAPABILITY_WORDS = {"logging": ("log", "logger", "logging"), "network": ("client", "http", "api", "request", "fetcher"), "env": ("config", "env", "settings")}


def frameworks(files: DataFrame) -> DataFrame:
    """framework: those that the paths (rel, lang) show."""
    shown = F.array_compact(F.array(*[F.when((F.col("lang") == lang) & F.col("rel").rlike(shape), F.lit(name)) for name, (lang, shape) in FRAMEWORKS.items()]))
    return files.select(F.explode(shown).alias("framework")).distinct()


def capabilities(files: DataFrame) -> DataFrame:
    """capability: those whose words name a directory or a file of the paths (rel): what could be asked, before anything is
    parsed. Whether it is adopted, `capable` says."""
    parts = F.concat(F.filter(F.split(directory(F.col("rel"), ""), "/"), lambda p: p != ""), F.array(F.regexp_extract(base(F.col("rel")), r"^(\.?[^.]*)", 1)))
    words = F.flatten(F.transform(parts, lambda p: F.split(F.lower(F.regexp_replace(p, "([A-Z])", "-$1")), "[-_.]+")))
    shown = F.array_compact(F.array(*[F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in known])), F.lit(name)) for name, known in CAPABILITY_WORDS.items()]))
    return files.select(words.alias("words")).select(F.explode(shown).alias("capability")).distinct()


def capable(sites: DataFrame, dimensions: tuple[Dimension, ...] = DIMENSIONS) -> DataFrame:
    """capability: those with conforming sites in MIN_CAPABLE_FILES files or more."""
    of = F.coalesce(*[F.when(F.col("key") == d.key, d.capability) for d in dimensions if d.capability], F.lit(None).cast("string"))
    used = sites.where("conforming").select(of.alias("capability"), "rel").where("capability IS NOT NULL")
    return used.groupBy("capability").agg(F.count_distinct("rel").alias("files")).where(F.col("files") >= MIN_CAPABLE_FILES).select("capability")


def offered(sites: DataFrame, files: DataFrame, frameworks: tuple[str, ...] = (), dimensions: tuple[Dimension, ...] = DIMENSIONS) -> DataFrame:
    """Sites of dimensions that apply to their file: its language, not blind there, framework in use, capability adopted."""
    spark = sites.sparkSession
    rows = [(d.key, list(d.langs), d.blind, d.capability) for d in dimensions if not d.framework or d.framework in frameworks]
    table = spark.createDataFrame(rows, "key string, langs array<string>, blind boolean, capability string")  # the registry
    there = sites.join(files.select("rel", "lang", "stripped"), "rel").join(F.broadcast(table), "key").where(F.array_contains("langs", F.col("lang")) & ~(F.col("blind") & F.col("stripped")))
    adopted = capable(there.select(SITES), dimensions).select("capability", F.lit(True).alias("_adopted"))
    return there.join(F.broadcast(adopted), "capability", "left").where("capability = '' OR _adopted").select(SITES)  # three capabilities at most
