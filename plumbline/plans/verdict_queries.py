"""Queries over verdicts, obligations, names and what was left uncounted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.api import Engine, Scan
from plumbline.functions import claims, paths
from plumbline.operators import check, companions, dimensions, gates, hierarchy, layout, render, tallies, verdict
from plumbline.plans.path_queries import _TEST_SQL, root_facts
from plumbline.plans.registry import query
from plumbline.plans.slot_queries import _CLAIM, _COUNTER, _COUNTER_OWN, _OWN, FULL_SQL, JUDGED_SQL, full_slots, judged
from plumbline.sources import files as tree
from plumbline.sources import ledger, pages, snapshots, star


def _pick(n: Column, *values: str | None) -> Column:
    """The value whose place is `n` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


_SIDE = f"CASE WHEN has_counter AND (states = 'counter' OR (states IS NULL AND ((candidates > 1 AND conforming = 0) OR {_COUNTER_OWN} > 0.5::DOUBLE))) THEN 'counter' ELSE 'claim' END"


@query(f"WITH {JUDGED_SQL}, s AS (SELECT *, {_SIDE} AS side FROM judged) SELECT area, key, side, CASE side WHEN 'counter' THEN candidates - conforming ELSE conforming END AS side_conforming FROM s")
def slot_sides(spark: SparkSession, sf: str) -> DataFrame:
    return gates.sided(judged(spark, sf)).select("area", "key", "side", "side_conforming")


_BASE_KEPT = "applicability % 4 <> 0"
_VERDICT_SQL = f"""{FULL_SQL}, now AS (SELECT *, CASE WHEN key = 'tax_cap' THEN 'a' END AS learned FROM full_slots),
old AS (SELECT area, key, conforming - conforming // 5 AS conforming, CASE WHEN key = 'tax_cap' THEN CASE WHEN dirs % 2 = 0 THEN 'a' ELSE 'b' END END AS learned FROM now WHERE {_BASE_KEPT}),
read AS (SELECT n.* REPLACE (coalesce(o.conforming, n.conforming) AS conforming), n.conforming AS now_conforming, o.area IS NOT NULL AS has_base, o.area IS NOT NULL AND o.learned IS DISTINCT FROM n.learned AS learned_moved FROM now n LEFT JOIN old o ON n.area = o.area AND n.key = o.key),
gated AS (SELECT *, {_CLAIM} AS claim_failed, {_COUNTER} AS counter_failed, CASE WHEN area_files % 11 = 0 THEN 'corpus-truncated' WHEN area_files % 7 = 0 THEN 'degraded-semantic' WHEN NOT has_base THEN 'postdates-baseline' WHEN learned_moved THEN 'learned-moved' END AS block FROM read),
told AS (SELECT *, CASE WHEN block IS NOT NULL THEN NULL WHEN claim_failed IS NULL THEN 'claim' WHEN has_counter AND counter_failed IS NULL THEN 'counter' END AS states FROM gated)"""


@query(f"WITH {_VERDICT_SQL} SELECT area, key, conforming, now_conforming, block, coalesce(block, claim_failed) AS failed, states, states IS NOT NULL AND coalesce(CASE WHEN learned IS NOT NULL THEN learned = 'a' ELSE states = 'claim' END, false) AS matches_default FROM told")
def slot_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Gates on a baseline's counts: today's slots with a fifth fewer conforming sites, and none for a quarter of them."""
    now = full_slots(spark, sf).withColumn("learned", F.when(F.col("key") == "tax_cap", "a"))
    old = now.where("applicability % 4 <> 0").withColumns({"conforming": F.col("conforming") - F.floor(F.col("conforming") / 5), "learned": F.when(F.col("key") == "tax_cap", F.when(F.col("dirs") % 2 == 0, "a").otherwise("b"))})
    defaults = spark.createDataFrame([(k, "claim", "a") for k in star.DIMENSIONS], "key string, default_side string, default_class string")
    files = F.col("area_files")
    out = verdict.verdicts(verdict.read_counts(now, old), defaults, files % 11 == 0, files % 7 == 0, F.when(~F.col("has_base"), F.lit("postdates-baseline")))
    return out.select("area", "key", "conforming", "now_conforming", "block", "failed", "states", "matches_default")


def _defaults(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("n_nationkey")
    nation = star.read(spark, sf, "nation")
    table = nation.where(n % 3 != 0).select(F.col("n_name").alias("key"), _pick(n, "claim", "counter", "none", "odd").alias("default_side"), _pick(n, None, "camelCase", "none", "loud", None).alias("default_class"), _pick(n, "measured", "literature", "seed", "guess", "measured", "literature", "seed").alias("method"), F.when(n % 2 == 0, "a paper").alias("source"))
    return table, nation.where(n % 8 != 1).select(F.col("n_name").alias("key"))


_DEFAULTS_SQL = """t AS (SELECT n_name AS key, ['claim', 'counter', 'none', 'odd'][n_nationkey % 4 + 1] AS default_side, [NULL, 'camelCase', 'none', 'loud', NULL][n_nationkey % 5 + 1] AS default_class, ['measured', 'literature', 'seed', 'guess', 'measured', 'literature', 'seed'][n_nationkey % 7 + 1] AS method, CASE WHEN n_nationkey % 2 = 0 THEN 'a paper' END AS source FROM nation WHERE n_nationkey % 3 <> 0),
k AS (SELECT n_name AS key FROM nation WHERE n_nationkey % 8 <> 1)"""


@query(f"WITH {_DEFAULTS_SQL} SELECT key, fault FROM (SELECT key, CASE WHEN key NOT IN (SELECT key FROM k) THEN 'unknown-key' WHEN default_side = 'odd' THEN 'side' WHEN default_class = 'loud' THEN 'class' WHEN method = 'guess' THEN 'method' WHEN method = 'literature' AND source IS NULL THEN 'source' END AS fault FROM t) WHERE fault IS NOT NULL")
def default_faults(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.faulty_defaults(*_defaults(spark, sf), tuple(c for c, _ in paths.NAMING_CLASSES))


@query(f"WITH {_DEFAULTS_SQL} SELECT * FROM t UNION ALL SELECT key, 'none', NULL, 'seed', NULL FROM k WHERE key NOT IN (SELECT key FROM t)")
def default_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.seeded(*_defaults(spark, sf))


@query("WITH c AS (SELECT source AS key, lang AS side, count(*) AS n FROM documents GROUP BY ALL) SELECT key, sum(n)::BIGINT AS samples, CASE WHEN sum(n) >= 20 AND max(n) >= 0.8::DOUBLE * sum(n) THEN first(side ORDER BY n DESC, side) ELSE 'none' END AS side FROM c GROUP BY key")
def decided_sides(spark: SparkSession, sf: str) -> DataFrame:
    """A source's language, from counts of two halves of the documents, which add up."""
    docs = star.read(spark, sf, "documents").select("doc_id", F.col("source").alias("key"), F.col("lang").alias("side"))
    return verdict.decided_sides(docs.groupBy("key", "side", F.col("doc_id") % 2).agg(F.count(F.lit(1)).alias("n")).select("key", "side", "n"))


@query("""WITH c AS (SELECT l_suppkey AS key, l_returnflag AS flag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS k FROM lineitem WHERE l_suppkey % 10 <> 3 OR l_returnflag <> 'R' GROUP BY ALL), a AS (SELECT key, round(k / n, 3) AS a FROM c WHERE flag = 'R'), b AS (SELECT key, round(k / n, 3) AS b FROM c WHERE flag = 'N')
SELECT coalesce(a.key, b.key) AS key, a, b, CASE WHEN a IS NULL AND b IS NULL THEN 'no-site' WHEN a IS NULL OR b IS NULL THEN 'one-arm' WHEN a = b AND a = 1 THEN 'both-perfect' WHEN a = b THEN 'equal' WHEN a > b THEN 'better-with' ELSE 'better-without' END AS reading FROM a FULL JOIN b ON a.key = b.key""")
def arms_reading(spark: SparkSession, sf: str) -> DataFrame:
    items = star.read(spark, sf, "lineitem").where("l_suppkey % 10 <> 3 OR l_returnflag <> 'R'")
    counted = items.groupBy(F.col("l_suppkey").alias("key"), "l_returnflag").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("l_discount") > 0.05).alias("conforming"))
    return verdict.arms(counted.where("l_returnflag = 'R'"), counted.where("l_returnflag = 'N'"))


_KIND = "CASE o_orderkey % 9 WHEN 0 THEN 'crashed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'oversize' WHEN 3 THEN 'unreadable' ELSE 'ok' END"


@query(f"SELECT {_KIND} AS kind, count(*) AS n FROM orders WHERE o_orderkey % 9 BETWEEN 1 AND 3 GROUP BY 1")
def unexamined_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return tallies.unexamined(star.read(spark, sf, "orders").select(F.expr(_KIND).alias("kind")), stable=True)


_EXT = "CASE o_custkey % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'md' WHEN 3 THEN 'js' WHEN 4 THEN 'rs' ELSE 'png' END"


@query(f"SELECT {_EXT} AS ext, count(*) AS n FROM orders WHERE o_custkey % 6 IN (0, 1, 4) AND o_orderkey % 5 <> 0 GROUP BY 1")
def unread_languages(spark: SparkSession, sf: str) -> DataFrame:
    return tallies.unread_languages(star.read(spark, sf, "orders").select(F.expr(_EXT).alias("ext"), F.when(F.col("o_orderkey") % 5 == 0, "js").alias("lang")))


@query("WITH o AS (SELECT o_orderkey AS rel, o_custkey % 50 AS area FROM orders WHERE o_orderkey % 3 <> 0) SELECT (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey % 3 = 0) AS orphaned, count(DISTINCT rel) FILTER (WHERE area % 7 = 0) AS barren FROM o")
def uncovered_files(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.read(spark, sf, "orders").select(F.col("o_orderkey").alias("rel"), (F.col("o_custkey") % 50).alias("area"))
    return tallies.uncovered(orders, orders.where("rel % 3 <> 0"), orders.where("area % 7 <> 0"))


@query("WITH r AS (SELECT o_orderpriority AS root, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS tests, 0 AS jsx, count(*) AS siblings FROM orders GROUP BY 1) SELECT bool_or(tests > 0) AS test_shape, bool_or(jsx > 0 AND siblings > 0) AS granularity FROM r")
def principle_flags(spark: SparkSession, sf: str) -> DataFrame:
    roots = star.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderkey") % 5 == 0).alias("tests"), F.lit(0).alias("jsx"), F.count(F.lit(1)).alias("siblings"))
    return tallies.principles(roots)


@query("SELECT l_suppkey AS file, count(*) AS calls, count(*) FILTER (WHERE l_quantity > 11) / count(*) AS rate, count(*) FILTER (WHERE l_quantity > 11) / count(*) < 0.8::DOUBLE AS degraded FROM lineitem GROUP BY 1")
def resolution_rate(spark: SparkSession, sf: str) -> DataFrame:
    calls = star.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_quantity") > 11).alias("resolved"))
    return tallies.resolution(calls, ["file"])


@query("SELECT o_orderkey AS rel, 'plain' AS key, o_orderstatus = 'F' AS conforming FROM orders UNION ALL SELECT o_orderkey, 'typed', o_custkey % 2 = 0 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P'")
def merged_tiers(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.read(spark, sf, "orders").withColumn("rel", F.col("o_orderkey"))
    plain = orders.select("rel", F.lit("plain").alias("key"), (F.col("o_orderstatus") == "F").alias("conforming"))
    typed = orders.where("rel % 3 = 0").select("rel", F.lit("typed").alias("key"), (F.col("o_custkey") % 2 == 0).alias("conforming"))
    return tallies.merged_tiers(plain, typed, orders.select("rel", (F.col("o_orderstatus") != "P").alias("ok")))


_REFS = "SELECT l_orderkey AS id, l_linenumber AS ord, CASE l_partkey % 4 WHEN 0 THEN '-x' WHEN 1 THEN 'origin/main' WHEN 2 THEN 'main' ELSE 'master' END AS ref, l_quantity > 30 AS resolved, l_suppkey % 2 = 0 AS fork FROM lineitem"
_REFS_ONE = f"SELECT id, ord, min(ref) AS ref, bool_or(resolved) AS resolved, bool_or(fork) AS fork FROM ({_REFS}) GROUP BY id, ord"


@query(f"WITH r AS ({_REFS_ONE}), f AS (SELECT id, first(ref ORDER BY ord) AS ref, first(fork ORDER BY ord) AS fork FROM r WHERE resolved AND NOT starts_with(ref, '-') GROUP BY id) SELECT i.id, ref, CASE WHEN fork THEN 'fork-point' WHEN NOT fork THEN 'added-lines' ELSE 'none' END AS mode FROM (SELECT DISTINCT id FROM r) i LEFT JOIN f ON i.id = f.id")
def base_ref(spark: SparkSession, sf: str) -> DataFrame:
    refs = _REFS_ONE.replace("FROM lineitem", "FROM {lineitem}").replace("l_partkey % 4", "CAST(l_partkey % 4 AS INT)")
    return tallies.chosen_base(spark.sql(refs, lineitem=star.read(spark, sf, "lineitem")))


_RULE_SQL = "p AS (SELECT DISTINCT 'map-' || (c_custkey % 40) || '.md' AS name FROM customer), d AS (SELECT CASE n % 3 WHEN 0 THEN 'map-' ELSE 'own-' END || n || CASE WHEN n % 10 = 9 THEN '.txt' ELSE '.md' END AS name, CASE n % 8 WHEN 1 THEN 'other' WHEN 2 THEN 'unreadable' ELSE 'file' END AS kind, n % 5 <> 0 AS owned FROM (SELECT DISTINCT s_suppkey % 60 AS n FROM supplier))"


@query(f"WITH {_RULE_SQL}, b AS (SELECT coalesce(p.name, d.name) AS name, p.name IS NOT NULL AS planned, kind, owned FROM p FULL JOIN (SELECT * FROM d WHERE ends_with(name, '.md')) d ON p.name = d.name) SELECT name, CASE WHEN kind IS NULL THEN 'missing' WHEN kind = 'other' THEN 'occupied' WHEN kind = 'unreadable' THEN 'unreadable' WHEN NOT (starts_with(name, 'map-') AND owned) THEN 'foreign' WHEN NOT planned THEN 'unknown' ELSE 'ours' END AS state FROM b")
def rule_audit(spark: SparkSession, sf: str) -> DataFrame:
    planned = star.read(spark, sf, "customer").select(F.concat(F.lit("map-"), (F.col("c_custkey") % 40).cast("string"), F.lit(".md")).alias("name"))
    n = F.col("n")
    disk = star.read(spark, sf, "supplier").select((F.col("s_suppkey") % 60).alias("n")).distinct()
    disk = disk.select(F.concat(F.when(n % 3 == 0, "map-").otherwise("own-"), n.cast("string"), F.when(n % 10 == 9, ".txt").otherwise(".md")).alias("name"), F.when(n % 8 == 1, "other").when(n % 8 == 2, "unreadable").otherwise("file").alias("kind"), (n % 5 != 0).alias("owned"))
    return tallies.audited(planned, disk, "map-")


_NAMES = "['a-b.rb', 'aB.rb', 'a_b.rb', 'AB.rb', 'A_B.rb', 'ab.rb']"
_CHANGES_SQL = f"c AS (SELECT p_partkey, {_NAMES}[p_partkey % 6 + 1] AS name, CASE WHEN p_partkey % 2 = 0 THEN {_NAMES}[p_size % 6 + 1] END AS from_name, CASE WHEN p_partkey % 5 <> 0 THEN 'snake_case' END AS learned, CASE WHEN p_partkey % 7 = 0 THEN 'claim' END AS states FROM part), k AS (SELECT * FROM (VALUES ('a-b.rb', 'kebab-case', true), ('aB.rb', 'camelCase', true), ('a_b.rb', 'snake_case', true), ('AB.rb', 'PascalCase', true), ('A_B.rb', NULL, true), ('ab.rb', NULL, false)) AS k(name, cls, site))"


@query(f"WITH {_CHANGES_SQL} SELECT p_partkey || '/' || c.name AS path, CASE WHEN k.cls IS NULL THEN 'no-class' ELSE 'other-class' END AS reason FROM c JOIN k ON c.name = k.name LEFT JOIN k f ON f.name = from_name WHERE learned IS NOT NULL AND k.site AND (from_name IS NULL OR (from_name <> c.name AND (f.site <> k.site OR f.cls IS DISTINCT FROM k.cls))) AND k.cls IS DISTINCT FROM learned AND (k.cls IS NOT NULL OR states IS NOT NULL)")
def filename_changes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    names = ("a-b.rb", "aB.rb", "a_b.rb", "AB.rb", "A_B.rb", "ab.rb")
    place = lambda name: F.concat(n.cast("string"), F.lit("/"), name)
    part = star.read(spark, sf, "part").select(place(_pick(n, *names)).alias("path"), F.when(n % 2 == 0, place(_pick(F.col("p_size"), *names))).alias("from_path"), F.when(n % 5 != 0, "snake_case").alias("learned"), F.when(n % 7 == 0, "claim").alias("states"))
    there = part.withColumns({"cls": paths.classify_basename(F.col("path")), "from_cls": paths.classify_basename(F.col("from_path")), "site": paths.names_a_site(F.col("path")), "from_site": paths.names_a_site(F.col("from_path"))})
    return tallies.filename_findings(there)


_OBLIGED_SQL = "c AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'app/models' WHEN 1 THEN 'app' ELSE 'lib' END || '/m' || c_custkey || CASE WHEN c_custkey % 11 = 0 THEN '_spec.rb' ELSE '.rb' END AS path FROM customer), t AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'spec/models' WHEN 1 THEN 'spec/app' ELSE 'spec/other' END || '/m' || (s_suppkey + s_suppkey % 2) || CASE WHEN s_suppkey % 4 = 0 THEN '_model_spec.rb' ELSE '_spec.rb' END AS path FROM supplier)"


@query(f"""WITH {_OBLIGED_SQL}, w AS (SELECT path, CASE WHEN starts_with(path, 'app/models/') THEN 'spec/models' ELSE 'spec/app' END || regexp_replace(regexp_replace(path, '^app(/models)?', ''), '[.]rb$', '') AS bare FROM c WHERE starts_with(path, 'app/') AND NOT ends_with(path, '_spec.rb'))
SELECT path, bare || '_spec.rb' AS companion, split_part(bare || '_spec.rb', '/', -1) IN (SELECT split_part(path, '/', -1) FROM t) AS elsewhere FROM w WHERE bare || '_spec.rb' NOT IN (SELECT path FROM t) AND bare || '_model_spec.rb' NOT IN (SELECT path FROM t)""")
def companion_obligations(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("c_custkey"), F.col("s_suppkey")
    changed = star.read(spark, sf, "customer").select(F.concat(F.when(n % 3 == 0, "app/models").when(n % 3 == 1, "app").otherwise("lib"), F.lit("/m"), n.cast("string"), F.when(n % 11 == 0, "_spec.rb").otherwise(".rb")).alias("path"))
    there = star.read(spark, sf, "supplier").select(F.concat(F.when(s % 3 == 0, "spec/models").when(s % 3 == 1, "spec/app").otherwise("spec/other"), F.lit("/m"), (s + s % 2).cast("string"), F.when(s % 4 == 0, "_model_spec.rb").otherwise("_spec.rb")).alias("path"))
    packages = spark.createDataFrame([(1, "app/models", "spec/models", "rb", ["_spec.rb", "_model_spec.rb"]), (2, "app", "spec/app", "rb", ["_spec.rb", "_model_spec.rb"])], "ord int, from string, to string, ext string, suffixes array<string>")
    return companions.missing(changed, there, packages)


@query("""WITH s AS (SELECT DISTINCT 'n' || (p_partkey % 300) AS stem FROM part WHERE p_size > 20), t AS (SELECT p_partkey, p_brand AS dir, 'n' || (p_partkey % 400) || CASE p_partkey % 5 WHEN 0 THEN '_model' WHEN 1 THEN '-test' WHEN 2 THEN 'x' ELSE '' END AS stem FROM part),
l AS (SELECT t.*, max(length(s.stem)) AS n FROM t JOIN s ON starts_with(t.stem, s.stem) AND length(s.stem) < length(t.stem) WHERE t.stem NOT IN (SELECT stem FROM s) GROUP BY ALL), c AS (SELECT dir, substr(stem, n + 1) AS extra, count(*) AS n FROM l GROUP BY ALL), d AS (SELECT dir, count(*) AS tests FROM t GROUP BY dir)
SELECT c.dir, 'ruby' AS lang, extra, c.n FROM c JOIN d ON c.dir = d.dir WHERE regexp_matches(extra, '^[._-]') AND c.n >= 3 AND c.n >= 0.2::DOUBLE * tests""")
def test_stem_extras(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    part = star.read(spark, sf, "part").withColumn("lang", F.lit("ruby"))
    sources = part.where("p_size > 20").select("lang", F.concat(F.lit("n"), (n % 300).cast("string")).alias("stem"))
    tests = part.select(F.col("p_brand").alias("dir"), "lang", F.concat(F.lit("n"), (n % 400).cast("string"), _pick(n, "_model", "-test", "x", "", "")).alias("stem"))
    return companions.stem_extras(tests, sources)


@query("WITH a AS (SELECT p_brand AS root, p_size > 15 AS answered, CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 < 4 THEN 'spec' ELSE 'test' END AS place FROM part), v AS (SELECT root, place, count(*) AS n FROM a WHERE answered AND place IS NOT NULL GROUP BY ALL), t AS (SELECT root, first(place ORDER BY n DESC, place) AS place, max(n) AS n FROM v GROUP BY root), c AS (SELECT root, count(*) AS \"of\", count(*) FILTER (WHERE answered) AS answered FROM a GROUP BY root) SELECT c.root AS dir, \"of\", answered, CASE WHEN answered > 1 AND 2 * t.n >= answered THEN place END AS root FROM c LEFT JOIN t ON c.root = t.root")
def namesake_ratio(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    answers = star.read(spark, sf, "part").select(F.col("p_brand").alias("dir"), (size > 15).alias("answered"), F.when(size % 6 != 0, F.when(size % 6 < 4, "spec").otherwise("test")).alias("place"))
    return companions.namesake_ratio(answers, ["dir"])


@query("WITH c AS (SELECT doc_id AS rel, md5(text) AS hash FROM documents WHERE doc_id % 6 <> 0), t AS (SELECT doc_id AS rel, md5(CASE WHEN doc_id % 9 = 1 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 8 <> 0) SELECT coalesce(c.rel, t.rel) AS rel, t.hash, t.hash IS NULL AS deleted FROM c FULL JOIN t ON c.rel = t.rel WHERE c.hash IS DISTINCT FROM t.hash")
def pending_tree(spark: SparkSession, sf: str) -> DataFrame:
    docs, n = star.read(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    committed = docs.where(n % 6 != 0).select(n.alias("rel"), F.md5("text").alias("hash"))
    return snapshots.pending(committed, docs.where(n % 8 != 0).select(n.alias("rel"), F.md5(F.when(n % 9 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash")))


@query("SELECT count(DISTINCT doc_id) AS n FROM documents WHERE doc_id % 4 IN (0, 2) AND doc_id % 3 <> 0")
def untracked_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    there = star.read(spark, sf, "documents").select(F.concat(_pick(n, "src/f", "vendor/f", "f", ".git/f"), n.cast("string"), F.lit(".ts")).alias("rel"), "doc_id")
    return tree.untracked(there, there.where("doc_id % 3 = 0"))


_WALK = "CASE o_orderkey % 5 WHEN 0 THEN 'a/../b' WHEN 1 THEN '../a' WHEN 2 THEN 'a/../../a/b' WHEN 3 THEN '/a' ELSE './a//b/..' END"


@query(f"SELECT o_orderkey, {_WALK} AS path, o_orderkey % 5 IN (0, 4) AS inside FROM orders")
def contained_paths(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.read(spark, sf, "orders").select("o_orderkey", F.expr(_WALK).alias("path"))
    return orders.withColumn("inside", tree.contained(F.col("path")))


_CONSTANTS = "CASE l_suppkey % 3 WHEN 0 THEN 'Base' WHEN 1 THEN 'Api::Base' ELSE 'Api::V1::Base' END"


@query(f"WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS w, l_partkey % 3 AS l, l_quantity > 25 AS nested, l_suppkey, l_partkey FROM lineitem) SELECT l_suppkey, l_partkey, nested, bool_or(w = l OR (nested AND least(w, l) = 0 AND greatest(w, l) = 1)) AS same FROM c GROUP BY ALL")
def same_constants(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers write a constant and parts learn one, in a nesting of `Api` or in none."""
    items = star.read(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_quantity") > 25).alias("nested")).distinct()
    names = ("Base", "Api::Base", "Api::V1::Base")
    same = claims.same_constant(_pick(F.col("l_suppkey"), *names), _pick(F.col("l_partkey"), *names), F.when(F.col("nested"), F.array(F.lit("Api"))))
    return items.withColumn("same", same)


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_partkey % 2 = 0 THEN 'No prefix here' ELSE 'Named in ' || ['none', 'camelCase', 'I', 'x''y'][p_size % 4 + 1] END AS claim, CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 2 = 0 THEN p_size % 4 IN (0, 2) ELSE p_size % 4 = 1 END AS enforceable FROM part")
def learned_claims(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    cls, none = _pick(F.col("p_size"), "none", "camelCase", "I", "x'y"), F.when(n % 2 == 0, "No prefix here")
    part = star.read(spark, sf, "part")
    return part.select("p_partkey", claims.claim_for(F.lit("Named in <style>"), none, cls).alias("claim"), claims.enforceable(cls, n % 3 == 0, none).alias("enforceable"))


@query("SELECT 'rails' AS framework FROM orders WHERE o_orderkey % 50 = 0 AND o_custkey % 2 = 0 HAVING count(*) > 0")
def frameworks_seen(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.read(spark, sf, "orders").select(F.concat(F.when(F.col("o_orderkey") % 50 == 0, "app/models/").otherwise("app/model/"), F.col("o_orderkey").cast("string"), F.lit(".rb")).alias("rel"), F.when(F.col("o_custkey") % 2 == 0, "ruby").otherwise("js").alias("lang"))
    return dimensions.frameworks(orders)


@query("SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'logging' WHEN 1 THEN 'network' ELSE 'env' END AS capability FROM part WHERE p_size % 5 < 3 AND p_size <> 2 AND p_size <> 7 OR p_size % 5 = 4")
def capabilities_seen(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rel = F.when(size % 5 == 0, "src/logging/index.ts").when(size % 5 == 1, "src/apiClient.ts").when(size % 5 == 2, "src/configured/a.ts").when(size % 5 == 3, "src/blog.ts").otherwise("src/app-settings.test.ts")
    return dimensions.capabilities(star.read(spark, sf, "part").select(rel.alias("rel")))


_FOUND = "CASE o_orderkey % 3 WHEN 0 THEN 'NIT' WHEN 1 THEN 'MUST-FIX' ELSE 'FIX' END"


@query(f"SELECT o_orderkey, severity, path, line, row_number() OVER (ORDER BY CASE severity WHEN 'MUST-FIX' THEN 1 WHEN 'FIX' THEN 2 ELSE 3 END, path, line, o_orderkey) AS rank FROM (SELECT o_orderkey, {_FOUND} AS severity, 'src/' || o_custkey || '.js' AS path, o_orderkey % 90 AS line FROM orders)")
def findings_order(spark: SparkSession, sf: str) -> DataFrame:
    return check.ordered(_findings(spark, sf))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return star.read(spark, sf, "orders").select("o_orderkey", F.expr(_FOUND).alias("severity"), F.concat(F.lit("src/"), F.col("o_custkey").cast("string"), F.lit(".js")).alias("path"), (F.col("o_orderkey") % 90).alias("line"))


@query(f"SELECT {_FOUND} AS severity, o_orderstatus AS reason, count(*) AS n FROM orders GROUP BY ALL")
def findings_tally(spark: SparkSession, sf: str) -> DataFrame:
    return check.tallied(star.read(spark, sf, "orders").select(F.expr(_FOUND).alias("severity"), F.col("o_orderstatus").alias("reason")))


@query("""WITH b AS (SELECT p_brand AS grp, p_partkey AS ord, 1 + p_size % 3 AS height FROM part), w AS (SELECT *, sum(height) OVER (PARTITION BY grp ORDER BY ord) AS upto, row_number() OVER (PARTITION BY grp ORDER BY ord) AS nth, sum(height) OVER (PARTITION BY grp) AS total, count(*) OVER (PARTITION BY grp) AS n FROM b),
k AS (SELECT *, coalesce(max(CASE WHEN upto + 1 + least(n - nth, 20) <= 40 THEN nth END) OVER (PARTITION BY grp), 0) AS last FROM w) SELECT grp, ord, height, total <= 40 OR nth <= last AS kept, NOT (total <= 40 OR nth <= last) AND nth - last <= 20 AS named FROM k""")
def settled_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = star.read(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("ord"), (1 + F.col("p_size") % 3).alias("height"))
    return layout.settled(blocks, "grp", ["ord"], "height", 40)


@query(f"""WITH {pages.PAGES_SQL}, {pages.ABOVE_SQL}, areas AS (SELECT DISTINCT tld AS area FROM paths UNION SELECT DISTINCT tld || '/' || host FROM paths WHERE length(host) % 2 = 0), o AS (SELECT dir, max_by(area, length(area)) AS owner FROM above a JOIN areas r ON a.path = r.area GROUP BY dir)
SELECT DISTINCT p.path, o.owner AS area FROM paths p JOIN o ON p.dir = o.dir""")
def glob_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Each path and the area whose globs reach it: no other than the area that owns it."""
    there = pages.paths(spark, sf).select(F.regexp_replace("path", "html$", "js").alias("rel"), "dir", "host")
    tld = F.substring_index("host", ".", -1)
    areas = there.select(tld.alias("area")).union(there.where(F.length("host") % 2 == 0).select(F.concat_ws("/", tld, "host"))).distinct()
    owners = hierarchy.deepest(there.select(F.col("dir").alias("path")), areas).select(F.col("path").alias("dir"), F.col("owner").alias("area"))
    found = Scan(areas, there.join(owners, "dir").select("rel", "dir", "area", F.lit("js").alias("lang")), there, there, there.select("dir").distinct(), there)
    reached = hierarchy.reach(there.select(F.col("rel").alias("path")), Engine(spark).globs(found)).where("reached")
    return reached.select(F.regexp_replace("path", "js$", "html").alias("path"), "area")


#: Two snapshots of files of code, one to a customer: a nation is an area, and some catch an error without a look at it.
_BAD_BASE = "(c_nationkey % 5 = 0 AND c_custkey % 40 = 0) OR (c_nationkey % 5 = 1 AND c_custkey % 4 = 0)"
_BAD_HEAD = f"c_custkey % 17 = 0 OR ({_BAD_BASE})"
_CHECK_SQL = f"""f AS (SELECT c_custkey, 'src/n' || c_nationkey AS area, 'src/n' || c_nationkey || '/f' || c_custkey || '.js' AS rel, {_BAD_BASE} AS was_bad, {_BAD_HEAD} AS is_bad FROM customer),
floor AS (SELECT least(greatest(floor(sqrt(count(*)) / 6 + 0.5::DOUBLE), 3), 8) AS least FROM customer),
s AS (SELECT area, count(*) AS candidates, count(*) FILTER (WHERE NOT was_bad) AS conforming, count(*) AS squares, 1 AS top_candidates, (first(NOT was_bad ORDER BY rel))::INT AS top_conforming, count(*) AS lang_files, count(*) AS area_files, count(*) AS applicability, 2 AS authors, 2 AS repo_authors, 1 AS dirs, 1 AS area_dirs, false AS has_counter FROM f GROUP BY area HAVING count(*) >= (SELECT least FROM floor)),
p AS (SELECT *, (sum(candidates) OVER () - candidates)::BIGINT AS rest_candidates, (sum(conforming) OVER () - conforming)::BIGINT AS rest_conforming FROM s),
j AS (SELECT *, {_CLAIM} AS failed, {_OWN} AS bound FROM p),
e AS (SELECT area, rel, row_number() OVER (PARTITION BY area ORDER BY rel) AS nth FROM f WHERE was_bad)"""


@query(f"""WITH {_CHECK_SQL} SELECT f.rel, CASE WHEN j.area IS NULL OR failed IS NOT NULL THEN 'NIT' WHEN bound < 0.9::DOUBLE OR conforming < candidates THEN 'FIX' ELSE 'MUST-FIX' END AS severity,
CASE WHEN j.area IS NULL THEN 'no-dimension' WHEN failed IS NOT NULL THEN 'not-stated' WHEN bound < 0.9::DOUBLE THEN 'borrowed' WHEN conforming < candidates THEN 'imperfect' ELSE 'clear' END AS reason FROM f LEFT JOIN j ON f.area = j.area WHERE is_bad AND NOT was_bad""")
def engine_check(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: files to sites, slots and gates of one snapshot, and the findings of another against them."""
    records = ledger.Ledger(spark)  # what the scan read is not read again: of the other snapshot, what differs is
    engine = Engine(spark, tuple(d for d in Engine(spark).dims if d.key == "swallowed_error"), records)
    customers = star.customers(spark, sf)
    rel = F.concat(F.lit("src/n"), F.col("c_nationkey").cast("string"), F.lit("/f"), F.col("c_custkey").cast("string"), F.lit(".js"))
    text = lambda bad: F.when(F.expr(bad), "try { run(); } catch (e) { count(); }").otherwise("try { run(); } catch (e) { report(e); }")
    files = lambda bad: customers.select(rel.alias("rel"), F.lit("js").alias("lang"), F.lit(False).alias("stripped"), text(bad).alias("content"))
    base, head = files(_BAD_BASE), files(_BAD_HEAD)
    authors = base.select("rel", F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z[bot]"))).alias("author"))
    found = engine.scan(base, authors=authors, frameworks=())
    return engine.check(found, engine.sites(head, frameworks=()), engine.sites(base, frameworks=()), pinned=True).select("rel", "severity", "reason")


_OF = "CASE side WHEN 'counter' THEN candidates - conforming ELSE conforming END || ' of ' || candidates || ' sites'"
_LINES_SQL = f"""{JUDGED_SQL}, s AS (SELECT *, {_SIDE} AS side, applicability % 3 = 0 AND states = 'claim' AS by_default FROM judged),
c AS (SELECT *, coalesce(states IS NOT NULL AND NOT by_default, false) AS told, key || CASE side WHEN 'counter' THEN ' (inverse)' ELSE '' END AS claim FROM s),
b AS (SELECT area, key, candidates, told, states, claim, CASE WHEN told THEN ['- ' || claim, '  ' || replace({_OF}, ' sites', '') || ' sites across ' || applicability || ' of ' || lang_files || ' files, ' || authors || CASE authors WHEN 1 THEN ' author' ELSE ' authors' END]
  ELSE ['- ' || claim || CASE WHEN states IS NOT NULL THEN ': as by default, ' ELSE ': no convention, ' END || {_OF} || CASE WHEN states IS NULL THEN ' (' || CASE side WHEN 'counter' THEN counter_failed ELSE failed END || ')' ELSE '' END] END AS block FROM c),
w AS (SELECT *, sum(len(block)) OVER (PARTITION BY area ORDER BY NOT told, candidates DESC, key) AS upto, row_number() OVER (PARTITION BY area ORDER BY NOT told, candidates DESC, key) AS nth, sum(len(block)) OVER (PARTITION BY area) AS total, count(*) OVER (PARTITION BY area) AS n FROM b),
k AS (SELECT *, coalesce(max(CASE WHEN upto + 1 + least(n - nth, 2) <= 5 THEN nth END) OVER (PARTITION BY area), 0) AS last FROM w),
l AS (SELECT area, 0 AS part, nth, unnest(block) AS line, unnest(range(len(block))) AS i FROM k WHERE total <= 5 OR nth <= last UNION ALL SELECT area, 1, 0, 'and ' || count(*) || ' more not shown here', 0 FROM k WHERE NOT (total <= 5 OR nth <= last) GROUP BY area
  UNION ALL SELECT area, 2, nth, '- ' || claim, 0 FROM k WHERE NOT (total <= 5 OR nth <= last) AND nth - last <= 2 AND states IS NOT NULL)"""


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).withColumns({"learned": F.lit(None).cast("string"), "precision": F.lit("precise"), "matches_default": (F.col("applicability") % 3 == 0) & F.coalesce(F.col("states") == "claim", F.lit(False))})


@query(f"WITH {_LINES_SQL} SELECT area, row_number() OVER (PARTITION BY area ORDER BY part, nth, i) AS nth, line FROM l")
def area_lines(spark: SparkSession, sf: str) -> DataFrame:
    """An area's text of five lines."""
    return render.area_lines(_stated(spark, sf), 5)


@query(f"WITH {JUDGED_SQL}, t AS (SELECT area, count(*) FILTER (WHERE states IS NOT NULL AND NOT coalesce(applicability % 3 = 0 AND states = 'claim', false)) AS stated, max(area_files) AS files FROM judged GROUP BY area), r AS (SELECT *, row_number() OVER (ORDER BY files DESC, area) AS nth FROM t WHERE stated > 0), n AS (SELECT count(*) AS every, least(count(*) FILTER (WHERE stated > 0), 10) AS shown FROM t) SELECT nth, '- ' || area || ': ' || files || CASE files WHEN 1 THEN ' file, ' ELSE ' files, ' END || stated || CASE stated WHEN 1 THEN ' claim' ELSE ' claims' END AS line FROM r WHERE nth <= 10 UNION ALL SELECT shown + 1, '- and ' || (every - shown) || CASE every - shown WHEN 1 THEN ' more area that states nothing shown here' ELSE ' more areas that state nothing shown here' END FROM n WHERE every > shown")
def overview_lines(spark: SparkSession, sf: str) -> DataFrame:
    slots = _stated(spark, sf)
    return render.overview(slots.groupBy("area").agg(F.max("area_files").alias("files")), slots, 10)


@query(f"WITH {_TEST_SQL}, g AS (SELECT split_part(path, '/', 1) AS root, CASE WHEN page_id % 9 = 7 THEN 'tsx' ELSE split_part(path, '.', -1) END AS ext, * FROM t), c AS (SELECT root, ext, count(*) AS n, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, ext) AS rank FROM g GROUP BY root, ext), h AS (SELECT root, count(*) AS files, count(*) FILTER (WHERE is_test) AS tests, count(*) FILTER (WHERE is_story) AS stories FROM g GROUP BY root), e AS (SELECT root, string_agg(n || ' .' || ext, ', ' ORDER BY rank) AS kinds, sum(n) AS told FROM c WHERE rank <= 2 GROUP BY root) SELECT h.root, '- ' || h.root || ': ' || CASE WHEN tests * 2 > files THEN tests || CASE tests WHEN 1 THEN ' test file' ELSE ' test files' END || CASE WHEN files > tests THEN ' and ' || (files - tests) || ' other' ELSE '' END ELSE kinds || CASE WHEN files > told THEN ' and ' || (files - told) || ' other' ELSE '' END || CASE WHEN stories > 0 THEN '; ' || stories || CASE stories WHEN 1 THEN ' story' ELSE ' stories' END ELSE '' END || '; ' || tests || CASE tests WHEN 1 THEN ' test file' ELSE ' test files' END END AS line FROM h JOIN e ON h.root = e.root")
def layout_lines(spark: SparkSession, sf: str) -> DataFrame:
    return render.layout_lines(root_facts(spark, sf), "root")
