"""Queries over snapshots, histories, adoption and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import baseline, companions, dimensions
from plumbline.plans.registry import query
from plumbline.registry import Dimension
from plumbline.sources import pages, snapshots, star

_SNAPS = "old AS (SELECT 'f' || doc_id AS rel, md5(text) AS hash FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/f' ELSE 'f' END || doc_id AS rel, md5(CASE WHEN doc_id % 13 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0)"


def _snaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs, n = star.read(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    old = docs.where(n % 5 != 0).select(F.concat(F.lit("f"), n.cast("string")).alias("rel"), F.md5("text").alias("hash"))
    rel = F.concat(F.when(n % 11 == 0, "moved/f").otherwise("f"), n.cast("string"))
    return old, docs.where(n % 7 != 0).select(rel.alias("rel"), F.md5(F.when(n % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))


@query(f"""WITH {_SNAPS}, b AS (SELECT coalesce(o.rel, n.rel) AS rel, o.hash AS was, n.hash AS now FROM old o FULL JOIN new n ON o.rel = n.rel WHERE o.hash IS DISTINCT FROM n.hash),
g AS (SELECT rel, was AS hash, row_number() OVER (PARTITION BY was ORDER BY rel) AS n FROM b WHERE now IS NULL), c AS (SELECT rel, now AS hash, row_number() OVER (PARTITION BY now ORDER BY rel) AS n FROM b WHERE was IS NULL)
SELECT CASE WHEN g.rel IS NULL THEN 'A' WHEN c.rel IS NULL THEN 'D' ELSE 'R' END AS status, g.rel AS before, c.rel AS after FROM g FULL JOIN c ON g.hash = c.hash AND g.n = c.n UNION ALL SELECT 'M', rel, rel FROM b WHERE was IS NOT NULL AND now IS NOT NULL""")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.changes(*_snaps(spark, sf))


@query(f"WITH {_SNAPS} SELECT rel, hash FROM new WHERE hash NOT IN (SELECT hash FROM old)")
def reparse_delta(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snaps(spark, sf)
    return snapshots.to_parse(new, old).select("rel", "hash")


@query(f"WITH {_SNAPS} SELECT w.rel, n.hash, n.hash IS NULL AS missing FROM (SELECT DISTINCT rel FROM old) w LEFT JOIN new n ON w.rel = n.rel")
def revision_read(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snaps(spark, sf)
    return snapshots.at_revision(new.withColumn("sha", F.lit("head")), "head", old)


_HISTORY = """renames AS (SELECT event_id AS seq, 'f' || user_id || '_' || (event_id // 7 % 5) AS old, 'f' || user_id || '_' || ((event_id // 7 + 1 + event_id % 3) % 5) AS new FROM events WHERE event_type = 'click'),
moves AS (SELECT r.seq, r.old, r.new, min(n.seq) AS next_seq FROM renames r LEFT JOIN renames n ON n.old = r.new AND n.seq > r.seq AND n.old <> n.new WHERE r.old <> r.new GROUP BY r.seq, r.old, r.new),
chain AS (SELECT seq, old AS path, new AS name, next_seq, 1 AS hops FROM moves UNION ALL SELECT c.seq, c.path, m.new, m.next_seq, c.hops + 1 FROM chain c JOIN moves m ON c.next_seq = m.seq WHERE c.hops < 64),
names AS (SELECT seq, path, max_by(name, hops) AS name FROM chain GROUP BY seq, path),
commits AS (SELECT event_id AS seq, 'f' || user_id || '_' || (event_id % 5) AS path, CASE WHEN event_id % 6 = 0 THEN 'helper[bot]' ELSE 'u' || (event_id % 4) END AS author FROM events WHERE event_type = 'view')"""


@query(f"WITH RECURSIVE {_HISTORY}, h AS (SELECT c.seq, c.path, c.author, arg_min(n.name, n.seq) FILTER (WHERE n.seq > c.seq) AS name FROM commits c LEFT JOIN names n ON c.path = n.path WHERE NOT contains(author, '[bot]') GROUP BY c.seq, c.path, c.author) SELECT DISTINCT coalesce(name, path) AS rel, author FROM h")
def author_history(spark: SparkSession, sf: str) -> DataFrame:
    events, n = star.read(spark, sf, "events"), F.col("event_id")
    file = lambda k: F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit("_"), (k % 5).cast("string"))
    part = F.floor(n / 7)
    names = baseline.resolved(events.where("event_type = 'click'").select(n.alias("seq"), file(part).alias("old"), file(part + 1 + n % 3).alias("new")))
    author = F.when(n % 6 == 0, "helper[bot]").otherwise(F.concat(F.lit("u"), (n % 4).cast("string")))
    return snapshots.authors(events.where("event_type = 'view'").select(n.alias("seq"), file(n).alias("path"), author.alias("author")), names)


_RULES = [(1, "^com/", "true"), (2, "/fr/", "false"), (3, "/en/1", "true"), (4, "^net/", "unset")]


@query(f"WITH {pages.PAGES_SQL}, rules AS (SELECT * FROM (VALUES {', '.join(map(str, _RULES))}) AS r(ord, pattern, value)) SELECT p.path, max_by(value, ord) AS value FROM (SELECT DISTINCT path FROM paths) p LEFT JOIN rules ON regexp_matches(path, pattern) GROUP BY p.path")
def attribute_rules(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.attribute(pages.paths(spark, sf), [(pattern, value) for _, pattern, value in _RULES])


@query("SELECT o_orderkey, severity || ' ' || path || ':' || line || ' ' || message AS text, '::' || CASE severity WHEN 'MUST-FIX' THEN 'error' WHEN 'FIX' THEN 'warning' ELSE 'notice' END || ' file=' || path || ',line=' || line || '::' || message AS github FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'MUST-FIX' WHEN 1 THEN 'FIX' ELSE 'NIT' END AS severity, 'src/' || o_custkey || '.js' AS path, o_orderkey % 90 AS line, o_orderpriority AS message FROM orders)")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    found = star.read(spark, sf, "orders").select("o_orderkey", F.when(key % 3 == 0, "MUST-FIX").when(key % 3 == 1, "FIX").otherwise("NIT").alias("severity"), F.concat(F.lit("src/"), F.col("o_custkey").cast("string"), F.lit(".js")).alias("path"), (key % 90).alias("line"), F.col("o_orderpriority").alias("message"))
    return found.select("o_orderkey", snapshots.reported(found, "text").alias("text"), snapshots.reported(found, "github").alias("github"))


#: Dimensions over nodes that line items stand for: an order is a file, a line number a place.
_TREE = (
    Dimension("calls", "partial", ("js",), site="n.type = 'Call'", conforming="n.name = 'test'"),
    Dimension("states", "precise", ("js",), site="n.type = 'Var' AND n.depth = 1", conforming="n.attrs['kind'] = 'const'"),
    Dimension("holds", "precise", ("js",), site="n.type = 'Catch'", inner=(("i.type = 'Call'", "n.attrs['param']", "i.name"),), conforming="held"),
    Dimension("single", "partial", ("js",), site="n.type = 'Call'", conforming="names = 1", per_file=True),
    Dimension("base", "precise", ("js",), site="n.type = 'Var'", cls="n.attrs['kind']"),
)
_NODES_SQL = """nodes AS (SELECT l_orderkey::VARCHAR AS rel, l_linenumber AS pre, l_linenumber + (l_partkey % 4)::INT AS post, (l_suppkey % 2)::INT AS depth, ['Call', 'Var', 'Catch'][1 + l_partkey % 3] AS type, CASE WHEN l_tax > 0.04 THEN 'test' ELSE 'it' END AS name,
  CASE WHEN l_quantity > 20 THEN 'const' ELSE 'let' END AS kind, CASE WHEN l_discount > 0.05 THEN 'test' ELSE 'it' END AS param FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem) WHERE nth = 1)"""


@query(f"""WITH {_NODES_SQL}, s AS (SELECT 'calls' AS key, name = 'test' AS conforming FROM nodes WHERE type = 'Call' UNION ALL SELECT 'states', kind = 'const' FROM nodes WHERE type = 'Var' AND depth = 1
UNION ALL SELECT 'holds', EXISTS (SELECT 1 FROM nodes i WHERE i.rel = n.rel AND i.pre > n.pre AND i.pre <= n.post AND i.type = 'Call' AND i.name = n.param) FROM nodes n WHERE type = 'Catch'
UNION ALL SELECT 'single', count(DISTINCT name) = 1 FROM nodes WHERE type = 'Call' GROUP BY rel UNION ALL SELECT 'base', NULL FROM nodes WHERE type = 'Var')
SELECT key, count(*) AS candidates, count(*) FILTER (WHERE conforming) AS conforming FROM s GROUP BY key""")
def tree_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    items = star.read(spark, sf, "lineitem")
    order = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    kept = items.withColumn("nth", F.expr(order)).where("nth = 1")
    attrs = F.create_map(F.lit("kind"), F.when(F.col("l_quantity") > 20, "const").otherwise("let"), F.lit("param"), F.when(F.col("l_discount") > 0.05, "test").otherwise("it"))
    nodes = kept.select(
        F.col("l_orderkey").cast("string").alias("rel"),
        F.col("l_linenumber").alias("pre"),
        (F.col("l_linenumber") + F.col("l_partkey") % 4).cast("int").alias("post"),
        (F.col("l_suppkey") % 2).cast("int").alias("depth"),
        F.element_at(F.array(F.lit("Call"), F.lit("Var"), F.lit("Catch")), (1 + F.col("l_partkey") % 3).cast("int")).alias("type"),
        F.when(F.col("l_tax") > 0.04, "test").otherwise("it").alias("name"),
        F.array().cast("array<string>").alias("above"),
        F.lit(None).cast("int").alias("fn"),
        F.lit(None).cast("int").alias("cls"),
        F.col("l_linenumber").alias("line"),
        attrs.alias("attrs"),
    )
    sites = dimensions.tree_sites(nodes, _TREE)
    return sites.groupBy("key").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("conforming").alias("conforming"))


_CAPABLE = (Dimension("a", "partial", ("js",), site="true", conforming="true", capability="logging"), Dimension("b", "partial", ("js",), site="true", conforming="true", capability="network"))


@query("WITH s AS (SELECT o_orderkey AS rel, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS key, o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' AND o_orderstatus <> 'P' OR o_orderkey = 2 AS conforming FROM orders) SELECT CASE key WHEN 'a' THEN 'logging' ELSE 'network' END AS capability FROM s WHERE conforming GROUP BY key HAVING count(DISTINCT rel) >= 3")
def capability_adoption(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    orders = star.read(spark, sf, "orders").select(F.col("o_orderkey").alias("rel"), F.when(status == "F", "a").otherwise("b").alias("key"), (((F.col("o_orderpriority") == "1-URGENT") & (status == "F")) | (F.col("o_orderkey") == 2)).alias("conforming"))
    return dimensions.capable(orders, _CAPABLE)


@query(f"WITH {pages.PAGES_SQL}, t AS (SELECT DISTINCT path, lang || '/' || number AS tail FROM paths WHERE lang <> 'en'), s AS (SELECT DISTINCT 'en/' || number AS tail FROM paths WHERE lang = 'en') SELECT t.path, replace(replace(replace(t.tail, 'fr/', 'en/'), 'de/', 'en/'), 'es/', 'en/') IN (SELECT tail FROM s) AS mirrored FROM t")
def tests_mirrored(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of other languages, and whether an English one has the same place: a semi-join on the tail of the path."""
    there = pages.paths(spark, sf)
    sources = there.where("lang = 'en'").select(F.concat_ws("/", "lang", "number").alias("path"))
    tests = there.where("lang <> 'en'").select("path", "number").distinct()
    return companions.companions(tests, sources, F.concat(F.lit("en/"), F.col("number"))).select("path", F.col("there").alias("mirrored"))
