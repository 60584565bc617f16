"""Queries of whole scans over nodes that Spark makes of the given tables: a customer is a file, a nation an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.api import Base, Engine
from plumbline.plans.registry import query
from plumbline.registry import DIMENSIONS
from plumbline.sources.star import customers
from plumbline.tables import stored

_NODE = ("rel", "pre", "post", "depth", "type", "name", "above", "fn", "cls", "line", "attrs")


def _engine(spark: SparkSession, *keys: str) -> Engine:
    return Engine(spark, tuple(d for d in DIMENSIONS if d.key in keys))


def _node(at: int, type_: str, name: Column | None = None, until: int | None = None, **attrs: Column) -> Column:
    """A node of a file; attributes that are null are not there."""
    none, pairs = F.lit(None).cast("int"), [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    held = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    values = (F.lit(at), F.lit(at if until is None else until), F.lit(0), F.lit(type_), F.lit(None).cast("string") if name is None else name, F.array().cast("array<string>"), none, none, F.lit(at + 1), held)
    return F.struct(*[v.alias(n) for n, v in zip(_NODE[1:], values, strict=True)])


def _nodes(files: DataFrame, *each: Column) -> DataFrame:
    return files.select("rel", F.explode(F.array_compact(F.array(*each))).alias("n")).select("rel", "n.*")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k"))


def _files(customers: DataFrame, rel: str, lang: str = "'js'") -> DataFrame:
    return customers.select("c", "k", F.expr(rel).alias("rel"), F.expr(lang).alias("lang"), F.lit(False).alias("stripped"))


_THEN = "c % 3 <> 0 AND k % 5 <> 4"
_WAS = "CASE WHEN k % 7 = 1 THEN concat('old/n', k, '/f', c, '.js') WHEN k % 6 = 5 THEN concat('src/n', k, '/g', c, '.js') ELSE concat('src/n', k, '/f', c, '.js') END"
_NOW = "concat('src/n', k, '/f', c, '.js')"


@query("""WITH c AS (SELECT c_custkey AS c, c_nationkey AS k FROM customer),
n AS (SELECT k, count(*)::BIGINT AS n, count(*) FILTER (WHERE c % 10 <> 0)::BIGINT AS const FROM c GROUP BY k),
t AS (SELECT k, count(*)::BIGINT AS n, count(*) FILTER (WHERE c % 4 <> 0)::BIGINT AS const FROM c WHERE c % 3 <> 0 AND k % 5 <> 4 GROUP BY k),
g AS (SELECT n.k, n.n AS now, n.const AS now_const, t.n AS was, t.const AS was_const, CASE WHEN k % 5 = 4 THEN 'postdates-baseline' WHEN k % 7 <> 1 AND k % 6 = 5 THEN 'population-change' END AS gate FROM n LEFT JOIN t USING (k)),
s AS (SELECT *, 'module_state_const' AS key, now_const AS now_good, was_const AS was_good, false AS moved FROM g UNION ALL SELECT *, 'extends_base', now, was, gate IS NULL AND k % 3 = 0 FROM g)
SELECT 'src/n' || k AS area, key, coalesce(gate, CASE WHEN moved THEN 'learned-moved' END) AS block, gate IS NULL AS has_base, moved AS learned_moved, CASE WHEN gate IS NULL THEN was ELSE now END AS candidates, CASE WHEN gate IS NULL THEN was_good ELSE now_good END AS conforming, now AS now_candidates, now_good AS now_conforming,
  CASE WHEN gate IS NULL THEN was ELSE now END AS lang_files FROM s""")
def engine_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Slots judged by a pinned population: through renames, and closed where the area is new, has changed its files, or
    learned another class."""
    engine, there = _engine(spark, "module_state_const", "extends_base"), _customers(spark, sf)
    now, then = _files(there, _NOW), _files(there.where(_THEN), _WAS)
    nodes = lambda files, const, base: _nodes(files, _node(0, "VariableDeclaration", F.lit("a"), kind=F.when(F.expr(const), "const").otherwise("let")), _node(1, "Class", F.lit("C"), super=F.expr(base)))
    before = engine.scan(then, nodes(then, "c % 4 <> 0", "'A'"), frameworks=(), min_files=F.lit(1))
    renames = there.where(_THEN).where("k % 7 = 1").select(F.expr(_WAS).alias("old"), F.expr(_NOW).alias("new"))
    base = Base(before.slots, before.owned.select("area", "rel"), renames)
    found = engine.scan(now, nodes(now, "c % 10 <> 0", "CASE WHEN k % 3 = 0 THEN 'B' ELSE 'A' END"), frameworks=(), min_files=F.lit(1), base=base)
    return found.slots.select("area", "key", "block", "has_base", "learned_moved", "candidates", "conforming", "now_candidates", "now_conforming", "lang_files")


_JSX = "CASE WHEN k % 2 = 0 THEN c % 3 = 0 ELSE c % 3 <> 0 END"
_SNAKE, _KEBAB = "(c + k) % 4 = 0", "(c + k) % 5 < 2"


@query(f"""WITH f AS (SELECT c_nationkey AS k, {_JSX.replace('k %', 'c_nationkey %').replace('c %', 'c_custkey %')} AS jsx, CASE WHEN {_SNAKE.replace('c + k', 'c_custkey + c_nationkey')} THEN 'snake_case' ELSE 'camelCase' END AS fn, CASE WHEN {_KEBAB.replace('c + k', 'c_custkey + c_nationkey')} THEN 'kebab-case' ELSE 'camelCase' END AS file FROM customer),
s AS (SELECT k, jsx, 'function_naming_case' AS key, fn AS cls FROM f UNION ALL SELECT k, jsx, 'file_naming_case', file FROM f),
m AS (SELECT k, key, 2 * count(*) FILTER (WHERE jsx) > count(*) AS jsx FROM s GROUP BY k, key),
o AS (SELECT s.* FROM s JOIN m ON s.k = m.k AND s.key = m.key AND s.jsx = m.jsx),
v AS (SELECT k, key, jsx, cls, count(*) AS n FROM o GROUP BY ALL),
l AS (SELECT k, key, arg_max(cls, n) AS learned, max(n) AS n FROM v GROUP BY k, key HAVING count(*) FILTER (WHERE n = (SELECT max(w.n) FROM v w WHERE w.k = v.k AND w.key = v.key)) = 1)
SELECT 'src/n' || o.k AS area, o.key, CASE WHEN jsx THEN 'jsx' ELSE 'module' END AS kind, learned, count(*)::BIGINT AS candidates, count(*) FILTER (WHERE cls = learned)::BIGINT AS conforming, count(*)::BIGINT AS lang_files FROM o JOIN l ON o.k = l.k AND o.key = l.key GROUP BY o.k, o.key, jsx, learned""")
def split_populations(spark: SparkSession, sf: str) -> DataFrame:
    """Names are learned from files that hold JSX or from those that do not, whichever an area has more of."""
    there = _customers(spark, sf)
    files = _files(there, f"concat('src/n', k, '/', CASE WHEN {_KEBAB} THEN 'format-date-' ELSE 'formatDate' END, c, CASE WHEN {_JSX} THEN '.jsx' ELSE '.js' END)", f"CASE WHEN {_JSX} THEN 'jsx' ELSE 'js' END")
    nodes = _nodes(files, F.when(F.expr(_JSX), _node(0, "JSXText")), _node(1, "Function", F.when(F.expr(_SNAKE), "get_thing").otherwise("getThing")))
    found = _engine(spark, "function_naming_case", "file_naming_case").scan(files, nodes, frameworks=(), min_files=F.lit(1))
    return found.slots.select("area", "key", "kind", "learned", "candidates", "conforming", "lang_files")


@query("""WITH f AS (SELECT c_nationkey AS k, c_custkey % 3 <> 1 AS inside, c_custkey % 4 = 0 AS spelled, c_custkey % 11 = 0 AS itself FROM customer),
s AS (SELECT k, inside, CASE WHEN itself THEN 'Other' WHEN spelled THEN 'Api::Base' ELSE 'Base' END AS cls, itself FROM f),
v AS (SELECT k, cls, count(*) AS n FROM s GROUP BY ALL),
l AS (SELECT k, arg_max(cls, n) AS learned FROM v GROUP BY k HAVING count(*) FILTER (WHERE n = (SELECT max(w.n) FROM v w WHERE w.k = v.k)) = 1)
SELECT 'app/n' || s.k AS area, learned, count(*)::BIGINT AS candidates, count(*) FILTER (WHERE cls = learned OR inside AND cls <> 'Other' AND learned <> 'Other')::BIGINT AS conforming FROM s JOIN l ON s.k = l.k
WHERE NOT (itself AND (inside AND learned = 'Api::Base' OR NOT inside AND learned = 'Base')) GROUP BY s.k, learned""")
def nested_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Base classes by whole and by bare name: within a module they are one constant; the base itself is no site of its own."""
    files = _files(_customers(spark, sf), "concat('app/n', k, '/f', c, '.rb')", "'ruby'")
    inside = F.expr("c % 3 <> 1")
    own = F.when(F.expr("c % 11 = 0"), F.lit("Base")).otherwise(F.concat(F.lit("C"), F.col("c").cast("string")))
    base = F.when(F.expr("c % 11 = 0"), "Other").when(F.expr("c % 4 = 0"), "Api::Base").otherwise("Base")
    nodes = _nodes(files, F.when(inside, _node(0, "Module", F.lit("Api"), 5)), _node(1, "Class", own, 3, super=base))
    found = _engine(spark, "class_base").scan(files, nodes, frameworks=("rails",), min_files=F.lit(1))
    return found.slots.select("area", "learned", "candidates", "conforming")


@query("""WITH c AS (SELECT CASE WHEN c_custkey % 10 = 1 THEN 'head-oversize' WHEN c_custkey % 6 = 0 THEN 'head-unreadable' END AS head, CASE WHEN c_custkey % 9 = 0 THEN 'base-unparsed' END AS base FROM customer),
f AS (SELECT head AS code, count(*)::BIGINT AS files FROM c WHERE head IS NOT NULL GROUP BY head UNION ALL SELECT base, count(*) FROM c WHERE base IS NOT NULL GROUP BY base UNION ALL SELECT 'no-map', 0)
SELECT code, files, CASE code WHEN 'no-map' THEN 'no map states anything, so nothing was checked' ELSE files || CASE files WHEN 1 THEN ' file' ELSE ' files' END || CASE code WHEN 'head-oversize' THEN ' were too large to read' WHEN 'head-unreadable' THEN ' could not be read' ELSE ' could not be read as they were before' END END AS message FROM f""")
def check_caveats(spark: SparkSession, sf: str) -> DataFrame:
    """What a check could not answer: files of either side that were not read, and a map that states nothing."""
    there = _customers(spark, sf)
    engine = _engine(spark, "swallowed_error")
    files = lambda lost: _files(there, _NOW).withColumns({"content": F.when(~F.expr(lost), "f();"), "bytes": F.when(F.expr("c % 10 = 1") & F.lit("6" in lost), 1 << 21).otherwise(4)})
    head, base = stored(files("c % 6 = 0"), "head"), stored(files("c % 9 = 0"), "base")
    return engine.caveats(engine.scan(base, frameworks=()), head, base)
