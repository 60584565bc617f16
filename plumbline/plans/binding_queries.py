"""Queries of scopes, bindings and comments: a supplier is a file, and each of its line items a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import dimensions, scopes
from plumbline.plans.registry import query
from plumbline.registry import DIMENSIONS
from plumbline.sources.star import read
from plumbline.tables import dealt, stored

_KIND = "CASE CAST(l_quantity AS INT) % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'open' WHEN 2 THEN 'close' WHEN 3 THEN 'close' WHEN 4 THEN 'declare' WHEN 5 THEN 'declare' WHEN 6 THEN 'assign' ELSE 'use' END"
_NAME = "concat('n', CAST(l_partkey % 13 AS STRING))"
_HOW = "CASE l_returnflag WHEN 'R' THEN 'rest' WHEN 'A' THEN 'useCallback' ELSE 'function' END"
_CONST = "CASE l_linestatus WHEN 'F' THEN 'const' ELSE 'let' END"
_MODULES = ("./lib/app-logger", "../apiClient.js", "./config", "lodash", "./widgets")
_SOURCE = f"CASE l_partkey % 5 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODULES))} END"
_BLOCK = "CASE l_partkey % 3 WHEN 0 THEN 'Function' ELSE 'Block' END"

_TOKENS_SQL = f"""tokens AS (SELECT l_suppkey AS rel, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS "at",
  {_KIND} AS kind, {_NAME} AS name, {_HOW} AS how, {_CONST} AS declares, {_SOURCE} AS source, {_BLOCK} AS block, l_partkey, l_returnflag FROM lineitem)""".replace("AS STRING", "AS VARCHAR")
_SCOPES_SQL = f"""{_TOKENS_SQL},
l AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY rel ORDER BY "at") AS level, max("at") OVER (PARTITION BY rel) AS last FROM tokens),
d AS (SELECT *, level - least(min(level) OVER (PARTITION BY rel ORDER BY "at"), 0) AS depth FROM l),
scopes AS (SELECT rel, "at" AS start, depth, block, coalesce((SELECT min(c."at") FROM d c WHERE c.rel = o.rel AND c."at" > o."at" AND c.depth < o.depth), last) AS until FROM d o WHERE kind = 'open')"""
_DECLARED_SQL = f"""{_SCOPES_SQL},
decl AS (SELECT t.rel, t.name, t."at" AS start, t.how, t.source, t.declares, t.l_partkey, coalesce((SELECT s.until FROM scopes s WHERE s.rel = t.rel AND s.start < t."at" AND s.until >= t."at" ORDER BY s.start DESC LIMIT 1), t.last) AS until FROM d t WHERE kind = 'declare'),
bound AS (SELECT t.rel, t."at", t.name, t.kind, max(x.start) AS declared, arg_max(x.how, x.start) AS how, arg_max(x.source, x.start) AS source FROM d t LEFT JOIN decl x ON x.rel = t.rel AND x.name = t.name AND x.start < t."at" AND x.until >= t."at" WHERE t.kind IN ('use', 'assign') GROUP BY t.rel, t."at", t.name, t.kind)"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    columns = {"kind": _KIND, "name": _NAME, "how": _HOW, "declares": _CONST, "source": _SOURCE, "block": _BLOCK}
    items = read(spark, sf, "lineitem")
    return dealt(items, items.count(), "l_suppkey").select(F.col("l_suppkey").alias("rel"), F.row_number().over(order).cast("long").alias("at"), *[F.expr(e).alias(n) for n, e in columns.items()], "l_partkey", "l_returnflag")


def _declared(spark: SparkSession, sf: str, carried: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Tokens, declarations, and how many rows a pass over them takes at most: a declaration or scope has two ends."""
    tokens = stored(_tokens(spark, sf), "tokens")
    rows = 2 * tokens.count()
    return tokens, scopes.declared(tokens, scopes.scopes(tokens), F.col("kind") == "declare", carried, rows), rows


def _nodes(rows: DataFrame, type_: str, name: str, above: Column, **attrs: Column) -> DataFrame:
    """Nodes of tokens (rel, at), a node a token, for the registry's own predicates."""
    none = F.lit(None).cast("int")
    pairs = F.map_filter(F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return rows.select(F.col("rel").cast("string").alias("rel"), F.col("at").cast("int").alias("pre"), F.col("at").cast("int").alias("post"), F.lit(0).alias("depth"), F.lit(type_).alias("type"), F.expr(name).alias("name"), above.alias("above"), none.alias("fn"), none.alias("cls"), F.lit(1).alias("line"), pairs.alias("attrs"))


def _told(nodes: DataFrame, key: str) -> DataFrame:
    found = dimensions.tree_sites(nodes, tuple(d for d in DIMENSIONS if d.key == key))
    return found.select(F.col("rel").cast("long").alias("rel"), F.col("pre").cast("long").alias("at"), "conforming")


def _nowhere() -> Column:
    return F.array().cast("array<string>")


@query(f"""WITH {_SCOPES_SQL} SELECT s.rel, s.start, s.until, s.depth::BIGINT AS depth, (SELECT max(p.start) FROM scopes p WHERE p.rel = s.rel AND p.start < s.start AND p.until >= s.start) AS parent FROM scopes s""")
def scope_tree(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.scopes(_tokens(spark, sf))


@query(f"""WITH {_DECLARED_SQL} SELECT rel, "at", name, declared FROM bound WHERE kind = 'use'""")
def bound_names(spark: SparkSession, sf: str) -> DataFrame:
    """Each use of a name and the declaration that it means."""
    tokens, there, rows = _declared(spark, sf, [])
    return scopes.bound(there, tokens.where("kind = 'use'").select("rel", "at", "name"), [], rows).select("rel", "at", "name", F.col("binding.start").alias("declared"))


@query(f"""WITH {_DECLARED_SQL}, again AS (SELECT DISTINCT rel, declared FROM bound WHERE kind = 'assign' AND declared IS NOT NULL)
SELECT x.rel, x.start AS "at", x.declares = 'const' AS conforming FROM decl x LEFT JOIN again a ON a.rel = x.rel AND a.declared = x.start
WHERE NOT EXISTS (SELECT 1 FROM scopes s WHERE s.rel = x.rel AND s.block = 'Function' AND s.start < x.start AND s.until >= x.start) AND (x.declares = 'const' OR a.rel IS NULL)""")
def module_state(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations outside all functions: `const`, or `let` though nothing assigns to them."""
    tokens = stored(_tokens(spark, sf), "tokens")
    rows = 2 * tokens.count()
    made = stored(scopes.scopes(tokens, ["block"]), "scopes")
    there = stored(scopes.declared(tokens, made, F.col("kind") == "declare", ["declares"], rows), "declared")
    again = scopes.reassigned(there, tokens.where("kind = 'assign'").select("rel", "at", "name"), rows).withColumn("at", F.col("start"))
    inside = scopes.innermost(made.where("block = 'Function'"), again.select("rel", "at", "name", "declares", "reassigned"), ["rel"], "_in", rows=rows)
    above = F.when(F.col("_in").isNotNull(), F.array(F.lit("Function"))).otherwise(_nowhere())
    return _told(_nodes(inside, "VariableDeclaration", "name", above, kind=F.col("declares"), reassigned=F.when(F.col("reassigned"), "1")), "module_state_const")


@query(f"""WITH {_DECLARED_SQL} SELECT rel, "at", how = 'useCallback' AS conforming FROM bound WHERE kind = 'use' AND how IN ('useCallback', 'function')""")
def memoised_handlers(spark: SparkSession, sf: str) -> DataFrame:
    """Handlers by the declaration that their name means: a memoised function or a plain one."""
    tokens, there, rows = _declared(spark, sf, ["how"])
    uses = scopes.bound(there, tokens.where("kind = 'use'").select("rel", "at", "name"), ["how"], rows)
    how = F.when(F.col("binding.how").isin("useCallback", "function"), F.col("binding.how"))
    return _told(_nodes(uses, "JSXAttribute", "'onClick'", _nowhere(), bound_by=how), "handler_memoised")


@query(f"""WITH {_DECLARED_SQL} SELECT b.rel, b."at", t.l_partkey % 2 = 0 AS conforming FROM bound b JOIN d t ON t.rel = b.rel AND t."at" = b."at" WHERE b.kind = 'use' AND (t.l_partkey % 2 = 0 OR b.how IS DISTINCT FROM 'rest')""")
def spread_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Spreads on components and on plain elements; a plain element that passes on what is left of its own props is none."""
    tokens, there, rows = _declared(spark, sf, ["how"])
    uses = scopes.bound(there, tokens.where("kind = 'use'").select("rel", "at", "name", "l_partkey"), ["how"], rows)
    element = F.when(F.col("l_partkey") % 2 == 0, "component").otherwise("plain")
    return _told(_nodes(uses, "JSXSpreadAttribute", "name", _nowhere(), element=element, forwarded=F.when(F.col("binding.how") == "rest", "1")), "spread_on_component")


_CONCERNS_SQL = f"""{_DECLARED_SQL},
w AS (SELECT b.rel, b."at", CASE b.source WHEN './lib/app-logger' THEN 'logging' WHEN '../apiClient.js' THEN 'network' WHEN './config' THEN 'env' END AS wrapper, t.l_partkey % 7 = 0 AS own FROM bound b JOIN d t ON t.rel = b.rel AND t."at" = b."at" WHERE b.kind = 'use')"""


@query(f"""WITH {_CONCERNS_SQL} SELECT rel, "at", 'route_logging' AS key, coalesce(wrapper = 'logging', false) AS conforming FROM w WHERE own OR wrapper = 'logging' UNION ALL SELECT rel, "at", 'route_network', coalesce(wrapper = 'network', false) FROM w WHERE own OR wrapper = 'network' UNION ALL SELECT rel, "at", 'route_env', coalesce(wrapper = 'env', false) FROM w WHERE own OR wrapper = 'env'""")
def wrapper_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and members that reach a concern through a module of one's own, by the import that their name means, or
    around it."""
    tokens, there, rows = _declared(spark, sf, ["source"])
    uses = tokens.where("kind = 'use'").select("rel", "at", "name", "l_partkey")
    calls = stored(scopes.wrapped(uses, there, dimensions.CAPABILITY_WORDS, rows), "calls")  # read for each concern
    own = F.col("l_partkey") % 7 == 0
    shapes = {"route_logging": ("CallExpression", "'log'", "console"), "route_network": ("CallExpression", "'fetch'", None), "route_env": ("MemberExpression", "'PORT'", "process.env")}
    out = None
    for key, (type_, name, object_) in shapes.items():
        nodes = _nodes(calls, type_, f"CASE WHEN l_partkey % 7 = 0 THEN {name} ELSE 'other' END", _nowhere(), object=F.when(own, object_), wrapper=F.col("wrapper"))
        told = _told(nodes, key).select("rel", "at", F.lit(key).alias("key"), "conforming")
        out = told if out is None else out.unionByName(told)
    return out


_OWNER, _COLUMN = "concat('t', CAST(l_partkey % 4 AS STRING))", "concat('c', CAST(l_linenumber AS STRING), '_id')"
_FK_SQL = f"""f AS (SELECT l_orderkey AS rel, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity AS quantity, l_returnflag AS flag, {_OWNER} AS owner, {_COLUMN} AS col FROM lineitem)""".replace("AS STRING", "AS VARCHAR")


@query(f"""WITH {_FK_SQL} SELECT r.rel, r.part, r.supp, r.line, r.quantity, EXISTS (SELECT 1 FROM f k WHERE k.rel = r.rel AND k.owner = r.owner AND (k.flag = 'A' AND k.col = r.col OR k.flag = 'R' AND 'c' || (k.line + 1) || 's' = 'c' || r.line || 's')) AS conforming FROM f r WHERE flag = 'N'""")
def reference_keys(spark: SparkSession, sf: str) -> DataFrame:
    """References with a foreign key that the same migration, an order, declares apart: by column, or by the table meant."""
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rel"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.expr(_OWNER).alias("owner"), F.expr(_COLUMN).alias("column"))
    keys = items.where("flag <> 'N'").select("rel", "owner", F.when(F.col("flag") == "A", F.col("column")).alias("column"), F.concat(F.lit("c"), F.col("line") + 1, F.lit("s")).alias("target"))
    there = scopes.with_foreign_key(items.where("flag = 'N'").drop("flag"), keys)
    return there.select("rel", "part", "supp", "line", "quantity", F.col("foreign_key").alias("conforming"))


_SAID = "CAST(l_quantity AS INT) % 5 = 0"
_NEW = "CAST(l_quantity AS INT) % 5 = 1"
_DOC_SQL = f"""t AS (SELECT l_suppkey AS rel, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS "at", {_SAID} AS comment, {_NEW} AS new, l_returnflag <> 'R' AS own_line, l_linestatus = 'F' AS tool FROM lineitem),
c AS (SELECT *, max(CASE WHEN NOT comment THEN "at" END) OVER (PARTITION BY rel ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS code FROM t),
q AS (SELECT c.rel, c."at", (SELECT arg_max(x.own_line, x."at") FROM t x WHERE x.rel = c.rel AND x.comment AND NOT (x.own_line AND x.tool) AND x."at" < c."at" AND x."at" > coalesce(c.code, 0)) AS doc FROM c WHERE new)"""


@query(f"""WITH {_DOC_SQL} SELECT rel, "at", coalesce(doc, false) AS conforming FROM q""")
def documented_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Exported declarations and whether a comment before them says what they are."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    tokens = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rel"), F.row_number().over(order).cast("long").alias("at"), F.expr(_SAID).alias("comment"), F.expr(_NEW).alias("new"), (F.col("l_returnflag") != "R").alias("own_line"), (F.col("l_linestatus") == "F").alias("tool"))
    tokens = stored(tokens, "tokens")
    there = scopes.documented(tokens.where("new").select("rel", "at"), tokens.where("comment"), tokens.where("NOT comment"))
    return _told(_nodes(there, "Function", "CAST(NULL AS STRING)", _nowhere(), exported=F.lit("1"), doc=F.when(F.col("doc"), "1")), "doc_comment_style")
