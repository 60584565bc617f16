"""Queries over pages as a tree of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths as P
from plumbline.functions import text as T
from plumbline.operators import companions, config, hierarchy, layout, nodes
from plumbline.plans.registry import query
from plumbline.plans.slot_queries import judged
from plumbline.sources import files as tree
from plumbline.sources import pages, star

_P, _L = pages.PAGES_SQL, pages.LINKS_SQL
CUMULATIVE_SQL = f"{_P},\n{pages.ABOVE_SQL},\nby_dir AS (SELECT dir, count(*) AS n FROM paths GROUP BY dir),\ncumulative AS (SELECT above.path, sum(n)::BIGINT AS files FROM above JOIN by_dir ON above.dir = by_dir.dir GROUP BY above.path)"


@query(f"WITH {CUMULATIVE_SQL} SELECT * FROM cumulative")
def hierarchy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.cumulative(pages.paths(spark, sf))


@query(f"WITH {_P}, {pages.ABOVE_SQL}, areas AS (SELECT DISTINCT tld AS area FROM paths UNION SELECT DISTINCT tld || '/' || host FROM paths WHERE length(host) % 2 = 0) SELECT d.dir AS path, (SELECT max_by(area, length(area)) FROM above a JOIN areas r ON a.path = r.area WHERE a.dir = d.dir) AS owner FROM (SELECT DISTINCT dir FROM paths) d")
def deepest_owner(spark: SparkSession, sf: str) -> DataFrame:
    there = pages.paths(spark, sf)
    tld = F.substring_index("host", ".", -1)
    areas = there.select(tld.alias("area")).union(there.where(F.length("host") % 2 == 0).select(F.concat_ws("/", tld, "host")))
    return hierarchy.deepest(there.select(F.col("dir").alias("path")), areas.distinct())


@query(f"WITH {CUMULATIVE_SQL}, least AS (SELECT least(greatest(floor(sqrt(count(*)) / 6 + 0.5::DOUBLE), 3), 8)::BIGINT AS least FROM paths), home AS (SELECT b.dir, b.n, max_by(c.path, length(c.path)) AS area FROM by_dir b JOIN above a ON a.dir = b.dir JOIN cumulative c ON c.path = a.path, least WHERE c.path <> '.' AND c.files >= least GROUP BY b.dir, b.n) SELECT area, sum(n)::BIGINT AS files FROM home, least GROUP BY area, least HAVING sum(n) >= least")
def area_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.discover(pages.paths(spark, sf))


@query(f"WITH {_P}, a AS (SELECT host, dir, count(*) AS n, count(*) OVER (PARTITION BY host) AS areas, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, dir DESC) AS nth FROM paths GROUP BY host, dir), r AS (SELECT host AS tree, CASE WHEN areas <= 2 OR nth = 1 THEN dir ELSE split_part(dir, '/', 1) || '/' || host END AS area, n FROM a) SELECT tree, area, sum(n)::BIGINT AS files FROM r GROUP BY tree, area")
def area_cap_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A site's directories, two to a site: all but its largest fold into their parent where there are more."""
    areas = pages.paths(spark, sf).groupBy(F.col("host").alias("tree"), F.col("dir").alias("area")).agg(F.count(F.lit(1)).alias("files"))
    return hierarchy.folded(areas, 2)


@query(f"""WITH {_P}, globs AS (SELECT DISTINCT tld AS area, tld AS dir, true AS deep, false AS negated FROM paths UNION ALL SELECT DISTINCT tld, tld || '/' || host, true, true FROM paths WHERE length(host) % 3 = 0)
SELECT p.path, g.area, bool_or(NOT negated) AND NOT bool_or(negated) AS reached FROM (SELECT DISTINCT path, dir FROM paths) p JOIN globs g ON p.dir = g.dir OR starts_with(p.dir, g.dir || '/') GROUP BY p.path, g.area""")
def glob_reach(spark: SparkSession, sf: str) -> DataFrame:
    there = pages.paths(spark, sf)
    tld = F.substring_index("host", ".", -1)
    html = F.array(F.lit("html"))
    whole = there.select(tld.alias("area"), tld.alias("dir"), F.lit(True).alias("deep"), html.alias("exts"), F.lit(False).alias("negated"))
    holes = there.where(F.length("host") % 3 == 0).select(tld, F.concat_ws("/", tld, "host"), F.lit(True), html, F.lit(True))
    return hierarchy.reach(there, whole.union(holes).distinct())


@query(f"WITH {_P}, want AS (SELECT path, replace(path, '/en/', '/fr/') AS companion FROM paths WHERE lang = 'en') SELECT w.path, w.companion, p.path IS NOT NULL AS there FROM want w LEFT JOIN (SELECT DISTINCT path FROM paths) p ON w.companion = p.path")
def companion_missing(spark: SparkSession, sf: str) -> DataFrame:
    there = pages.paths(spark, sf)
    return companions.companions(there.where("lang = 'en'").select("path"), there.select("path"), F.replace("path", F.lit("/en/"), F.lit("/fr/")))


@query(f"WITH {_P}, t AS (SELECT DISTINCT host || '/' || lang || '/' || number || '.html' AS tail FROM paths WHERE lang = 'en'), c AS (SELECT path, host || '/' || lang || '/' || number || '.html' AS tail, split_part(host, '.', -1) AS root FROM paths), v AS (SELECT root, count(*) AS n FROM c JOIN t ON c.tail = t.tail GROUP BY root), b AS (SELECT max(n) AS n FROM v) SELECT CASE WHEN count(*) = 1 THEN min(root) WHEN bool_or(root = 'net') THEN 'net' END AS root, max(v.n) AS votes FROM v JOIN b ON v.n = b.n HAVING count(*) > 0")
def companion_root_vote(spark: SparkSession, sf: str) -> DataFrame:
    there = pages.paths(spark, sf)
    tail = F.concat_ws("/", "host", "lang", F.concat("number", F.lit(".html")))
    return companions.root_vote(there.where("lang = 'en'").select(tail.alias("tail")), there.select("path"), "net")


@query(f"WITH {_P}, e AS (SELECT lang, number[-1:] AS suffix FROM paths), t AS (SELECT lang, count(*) AS producers FROM e GROUP BY lang), c AS (SELECT lang, suffix, count(*) AS n FROM e GROUP BY ALL) SELECT c.lang, suffix, n, producers FROM c JOIN t ON c.lang = t.lang WHERE n >= 3 AND n >= 0.1::DOUBLE * producers")
def companion_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    endings = pages.paths(spark, sf).select("lang", F.substring("number", -1, 1).alias("suffix"))
    return companions.learned_suffixes(endings, ["lang"], share=0.1)


_STEMS = "SELECT p_name AS stem, p_brand || '/' || p_type AS dir, p_brand || '/' || p_type || '/' || p_name || '.' || p_partkey AS path FROM part"


@query(f"""WITH s AS (SELECT stem, path AS source, dir FROM ({_STEMS} WHERE p_size <= 25)), t AS (SELECT stem, path AS test, dir FROM ({_STEMS} WHERE p_size > 25)),
b AS (SELECT test, source, CASE WHEN s.dir = t.dir THEN 0 WHEN split_part(s.dir, '/', -1) = split_part(t.dir, '/', -1) THEN 1 ELSE 2 END AS how FROM s JOIN t ON s.stem = t.stem)
SELECT test, first(source ORDER BY how, source) AS source, ['whole', 'mirrored', 'stem'][min(how) + 1] AS how FROM b GROUP BY test""")
def namesake_match(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files: a part's name is the stem, its brand and type the directory; larger parts are the tests."""
    dir_ = F.concat_ws("/", "p_brand", "p_type")
    there = star.read(spark, sf, "part").select(F.col("p_name").alias("stem"), F.concat(dir_, F.lit("/"), "p_name", F.lit("."), F.col("p_partkey").cast("string")).alias("path"), dir_.alias("dir"), "p_size")
    return companions.namesakes(there.where("p_size <= 25"), there.where("p_size > 25"))


@query(f"WITH {_P}, i AS (SELECT DISTINCT path AS importer, lang || '/' || number || '.html' AS specifier FROM paths), x AS (SELECT specifier, CASE WHEN count(DISTINCT importer) = 1 THEN min(importer) END AS target FROM i GROUP BY specifier) SELECT importer, i.specifier, target FROM i LEFT JOIN x ON i.specifier = x.specifier")
def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    there = pages.paths(spark, sf).select("path", "lang", "number").distinct()
    imports = there.select(F.col("path").alias("importer"), F.concat(F.col("lang"), F.lit("/"), F.col("number"), F.lit(".html")).alias("specifier"))
    return companions.resolved_imports(imports, there.select("path"))


@query(f"WITH {_P}, i AS (SELECT DISTINCT path AS importer, '../' || ['fr', 'en', 'de'][1 + number::INT % 3] || '/./' || number || '?q=1' AS specifier, tld || '/' || host || '/' || ['fr', 'en', 'de'][1 + number::INT % 3] || '/' || number || '.html' AS wanted FROM paths) SELECT importer, specifier, p.path AS target FROM i LEFT JOIN (SELECT DISTINCT path FROM paths) p ON p.path = wanted")
def relative_import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    there = pages.paths(spark, sf).select("path", "dir", "number").distinct()
    other = F.element_at(F.array(F.lit("fr"), F.lit("en"), F.lit("de")), 1 + F.col("number").cast("int") % 3)
    imports = there.select(F.col("path").alias("importer"), "dir", F.concat(F.lit("../"), other, F.lit("/./"), F.col("number"), F.lit("?q=1")).alias("specifier"))
    return companions.relative_imports(imports, there.select("path"), ("html", "js"))


@query("WITH o AS (SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS module FROM documents), f AS (SELECT lang, count(DISTINCT doc_id) AS files FROM o GROUP BY lang HAVING count(DISTINCT doc_id) >= 5), c AS (SELECT o.lang, module, count(*) AS importers, files, count(*) / files AS share FROM o JOIN f ON o.lang = f.lang GROUP BY o.lang, module, files), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY importers DESC, module) AS rank FROM c WHERE share >= 0.6) SELECT lang, module, importers, files, share, rank FROM r WHERE rank <= 3")
def common_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files and their words as what they import: the words that most documents of a language share."""
    words = F.explode(F.array_distinct(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    imports = star.read(spark, sf, "documents").select("lang", F.col("doc_id").alias("importer"), words.alias("module"))
    return companions.common_imports(imports, "lang").select("lang", "module", "importers", "files", "share", "rank")


@query(f"WITH {_L}, o AS (SELECT DISTINCT lower(module[:1]) AS grp, module, page_id FROM links WHERE lower(module[:1]) <> lang[:1]), c AS (SELECT grp, module, count(*) AS importers FROM o GROUP BY grp, module HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY importers DESC, module) AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def most_imported(spark: SparkSession, sf: str) -> DataFrame:
    links = pages.links(spark, sf).select(F.lower(F.substring("module", 1, 1)).alias("grp"), "module", F.col("page_id").alias("importer"), F.substring("lang", 1, 1).alias("importer_group"))
    return companions.most_imported(links, "grp")


@query(f"WITH {_P}, c AS (SELECT lang AS value, count(*) AS n FROM paths GROUP BY lang) SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c")
def layout_tally(spark: SparkSession, sf: str) -> DataFrame:
    return layout.tally(pages.paths(spark, sf).select(F.col("lang").alias("value")), "value")


#: Pages as a tree with shells: `net` is `src`, `com` lies in `packages`, and hosts of even length are `lib`.
_TREE_DIR = "CASE tld WHEN 'com' THEN 'packages/com' WHEN 'net' THEN 'src' ELSE tld END || '/' || CASE WHEN length(host) % 2 = 0 THEN 'lib' ELSE host END || CASE WHEN CAST(number AS INT) % 5 = 0 THEN '' ELSE '/' || lang END"
_SOURCE = "CASE WHEN CAST(number AS INT) % 4 <> 0 THEN 'js' END"
_ROOTS_SQL = f"""{_P}, f AS (SELECT {_TREE_DIR} AS dir, {_SOURCE} AS source FROM paths), d AS (SELECT dir, count(*) AS direct, count(source) AS direct_source FROM f GROUP BY dir),
up AS (SELECT dir, direct, direct_source, dir AS path FROM d UNION ALL SELECT dir, direct, direct_source, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END FROM up WHERE path <> '.'),
total AS (SELECT path, sum(direct)::BIGINT AS files, sum(direct_source)::BIGINT AS source, CASE WHEN path = '.' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent FROM up GROUP BY path),
n AS (SELECT t.*, coalesce(direct, 0) AS direct, coalesce(direct_source, 0) AS direct_source, (SELECT max(files) FROM total c WHERE c.parent = t.path) AS largest, greatest(3, ceil((SELECT count(*) FROM f) * 0.01::DOUBLE)) AS floor FROM total t LEFT JOIN d ON d.dir = t.path),
o AS (SELECT *, path = '.' OR split_part(path, '/', -1) IN ('src', 'lib', 'app', 'apps', 'packages', 'source') OR coalesce(largest >= 0.8::DOUBLE * files, false) AS opened FROM n),
visit AS (SELECT * FROM o WHERE path = '.' UNION ALL SELECT c.* FROM visit v JOIN o c ON c.parent = v.path WHERE v.opened AND c.files >= c.floor),
l AS (SELECT path, files, source FROM visit WHERE path <> '.' AND (NOT opened OR largest IS NULL OR (direct < floor AND largest < floor))
  UNION ALL SELECT path || ' (files at this level)', direct, direct_source FROM visit WHERE path <> '.' AND opened AND largest IS NOT NULL AND direct >= floor),
r AS (SELECT *, row_number() OVER (ORDER BY source DESC, files DESC, path) AS rank FROM l)"""


def _tree_files(spark: SparkSession, sf: str) -> DataFrame:
    there = pages.paths(spark, sf).withColumn("tld", F.substring_index("host", ".", -1))
    return there.select("page_id", F.expr(_TREE_DIR).alias("dir"), F.expr(_SOURCE).alias("lang"))


@query(f"WITH RECURSIVE {_ROOTS_SQL} SELECT path, files, source, rank FROM r WHERE rank <= 7")
def layout_roots(spark: SparkSession, sf: str) -> DataFrame:
    return layout.roots(_tree_files(spark, sf))[0]


@query(f"WITH RECURSIVE {_ROOTS_SQL} SELECT count(*) FILTER (WHERE rank > 7) AS more_roots, ((SELECT count(*) FROM f) - coalesce(sum(files) FILTER (WHERE rank <= 7), 0))::BIGINT AS more_files FROM r")
def layout_more(spark: SparkSession, sf: str) -> DataFrame:
    return layout.roots(_tree_files(spark, sf))[1]


_TEST_DIR = "'spec/' || CASE WHEN page_id % 10 < 9 THEN 'models' ELSE 'other' END || '/' || CASE WHEN lang = 'en' THEN host ELSE lang END"


@query(f"WITH {_P}, t AS (SELECT lang AS runner, {_TEST_DIR} AS dir FROM paths), u AS (SELECT runner, unnest(['spec', regexp_replace(dir, '/[^/]*$', ''), dir]) AS up FROM t), s AS (SELECT runner, count(*) AS files FROM t GROUP BY runner), c AS (SELECT runner, up, count(*) AS under FROM u GROUP BY runner, up), b AS (SELECT c.runner, max_by(up, length(up)) AS dir, max_by(under, length(up)) AS under FROM c JOIN s ON c.runner = s.runner WHERE under >= 0.8::DOUBLE * files GROUP BY c.runner) SELECT s.runner, files, b.dir, coalesce(under, files) AS under FROM s LEFT JOIN b ON s.runner = b.runner")
def tests_line(spark: SparkSession, sf: str) -> DataFrame:
    return layout.majority_dirs(pages.paths(spark, sf).select(F.col("lang").alias("runner"), F.expr(_TEST_DIR).alias("dir")), ["runner"])


_TEST_PATH = "CASE page_id % 9 WHEN 0 THEN 'src/a' || number || '.js' WHEN 1 THEN 'src/a' || number || '.test.js' WHEN 2 THEN 'test/a/b' || (page_id % 50) || '.js' WHEN 3 THEN 'lib/a/b' || (page_id % 50) || '.js' WHEN 4 THEN 'src/__tests__/x' || number || '.js' WHEN 5 THEN 'cypress/e2e/' || number || '.js' WHEN 6 THEN 'app/m' || number || '_spec.rb' WHEN 7 THEN 'src/b' || number || '.stories.tsx' ELSE 'spec/support/c' || number || '.rb' END"
_TEST_SQL = f"""{_P}, f AS (SELECT page_id, {_TEST_PATH} AS path, CASE WHEN page_id % 13 <> 0 THEN 'js' END AS lang, CASE WHEN page_id % 5 = 0 THEN 'vitest' END AS runner, page_id % 7 = 0 AS calls, page_id % 11 = 0 AS empty FROM paths),
outside AS (SELECT DISTINCT 'a/b' || (page_id % 50) AS tail FROM f WHERE page_id % 9 = 3 AND lang IS NOT NULL),
t AS (SELECT *, lang IS NOT NULL AND (runner IS NOT NULL OR calls OR (NOT empty AND (page_id % 9 IN (1, 4, 6) OR (page_id % 9 = 2 AND 'a/b' || (page_id % 50) IN (SELECT tail FROM outside))))) AS is_test, page_id % 9 = 7 AS is_story, coalesce(runner, CASE WHEN page_id % 9 = 5 THEN 'cypress' END, 'test files') AS runner_name FROM f)"""


def _tested(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    files = pages.paths(spark, sf).select("page_id", F.expr(_TEST_PATH).alias("path"), F.when(n % 13 != 0, "js").alias("lang"), F.when(n % 5 == 0, "vitest").alias("runner"), (n % 7 == 0).alias("test_calls"), (n % 11 == 0).alias("empty"))
    return layout.test_files(files)


@query(f"WITH {_TEST_SQL} SELECT page_id, path, is_test, is_story, runner_name FROM t")
def test_files(spark: SparkSession, sf: str) -> DataFrame:
    return _tested(spark, sf).select("page_id", "path", "is_test", "is_story", "runner_name")


@query(f"WITH {_TEST_SQL}, g AS (SELECT split_part(path, '/', 1) AS root, CASE WHEN page_id % 9 = 7 THEN 'tsx' ELSE split_part(path, '.', -1) END AS ext, * FROM t), c AS (SELECT root, ext, count(*) AS n, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, ext) AS rank FROM g GROUP BY root, ext) SELECT g.root, count(*) AS files, count(lang) AS source, (SELECT string_agg(ext || ':' || n, ',' ORDER BY rank) FROM c WHERE c.root = g.root AND rank <= 2) AS exts, (count(*) - (SELECT sum(n) FROM c WHERE c.root = g.root AND rank <= 2))::BIGINT AS other, count(*) FILTER (WHERE page_id % 3 = 0) AS jsx, count(*) FILTER (WHERE is_test) AS tests, count(*) FILTER (WHERE is_story) AS stories, count(*) FILTER (WHERE is_test) * 2 > count(*) AS test_root FROM g GROUP BY g.root")
def root_facts(spark: SparkSession, sf: str) -> DataFrame:
    files = _tested(spark, sf).withColumns({"root": F.substring_index("path", "/", 1), "ext": P.extension(F.col("path")), "jsx": F.col("page_id") % 3 == 0})
    return layout.root_facts(files, "root")


@query(f"WITH {_TEST_SQL} SELECT page_id, regexp_matches(path, '^(test|tests|spec|cypress|e2e|__tests__)/') OR contains(path, '/__tests__/') OR contains(path, '/e2e/') AS under FROM t")
def test_trees(spark: SparkSession, sf: str) -> DataFrame:
    return _tested(spark, sf).select("page_id", layout.under_test_tree(F.col("path")).alias("under"))


_NAME = "CASE p_size % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN split_part(p_name, ' ', 1) || upper(split_part(p_name, ' ', 2)[1:1]) || substr(split_part(p_name, ' ', 2), 2) WHEN 3 THEN upper(p_name[1:1]) || substr(split_part(p_name, ' ', 1), 2) ELSE split_part(p_name, ' ', 1) END || '.rb'"
_NAMED_SQL = f"named AS (SELECT p_partkey, p_brand, {_NAME} AS path FROM part)"
_STEM = "split_part(path, '.', 1)"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches({_STEM}, '{p}') THEN '{c}'" for c, p in P.NAMING_CLASSES) + " END"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    part = star.read(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    one, two = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    kind = F.col("p_size") % 5
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
    name = F.when(kind == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).when(kind == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(kind == 2, F.concat(one, capital(two))).when(kind == 3, capital(one)).otherwise(one)
    return part.select("p_partkey", "p_brand", F.concat(name, F.lit(".rb")).alias("path"))


@query(f"WITH {_NAMED_SQL} SELECT p_partkey, path, {_CLASS} AS class, NOT regexp_matches({_STEM}, '^[a-z0-9]+$') AS site FROM named")
def naming_class(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("p_partkey", "path", P.classify_basename(F.col("path")).alias("class"), P.names_a_site(F.col("path")).alias("site"))


@query(f"WITH {_NAMED_SQL} SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace({_STEM}, '([A-Z])', '-\\1', 'g')), '[-_.]+'), lambda w: w <> ''), ' ') AS words FROM named")
def stem_words(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("p_partkey", F.array_join(P.stem_words(F.col("path")), " ").alias("words"))


@query(f"WITH {_P} SELECT page_id, path, split_part(path, '/', -1) AS base, dir, 'html' AS ext, number AS stem, CASE (regexp_matches(number[-1:], '[0-9]'))::INT WHEN 1 THEN 'js' END AS lang FROM paths")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return pages.paths(spark, sf).select("page_id", "path", P.base(path).alias("base"), P.directory(path).alias("dir"), P.extension(path).alias("ext"), P.stem(path).alias("stem"), P.language(path).alias("lang"))


_DROP_PATH = "CASE doc_id % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'vendor/' WHEN 2 THEN 'src/build/' WHEN 3 THEN 'build/' WHEN 4 THEN '.git/' WHEN 5 THEN 'testdata/' ELSE 'app/' END || 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.rb' WHEN 1 THEN '.ts' ELSE '.md' END"


@query(f"WITH p AS (SELECT doc_id, {_DROP_PATH} AS path, doc_id % 10 = 7 AS escaped, CASE WHEN doc_id % 9 = 0 THEN '// Code generated by x' ELSE text END AS content FROM documents), r AS (SELECT CASE WHEN path LIKE '.git/%' THEN 'denied' WHEN path LIKE 'vendor/%' OR path LIKE 'testdata/%' OR path LIKE 'build/%' THEN 'excluded' WHEN path LIKE '%.md' THEN 'not-source' WHEN escaped THEN 'escaped' WHEN content LIKE '// Code generated by%' THEN 'generated' ELSE 'kept' END AS reason FROM p) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def drop_tally(spark: SparkSession, sf: str) -> DataFrame:
    docs = star.read(spark, sf, "documents").select("doc_id", "text")
    rows = docs.select(F.expr(_DROP_PATH).alias("path"), (F.col("doc_id") % 10 == 7).alias("escaped"), F.when(F.col("doc_id") % 9 == 0, "// Code generated by x").otherwise(F.col("text")).alias("content"))
    return rows.groupBy(F.coalesce(tree.drop_reason(F.col("path"), F.col("content"), F.col("escaped")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH i AS (SELECT page_id AS rel, unnest(regexp_extract_all(html, '(?s)<li[ >].*?</li>')) AS item FROM pages) SELECT rel, count(*) AS candidates, count(*) FILTER (WHERE regexp_matches(item, '<a[ >]')) AS conforming FROM i GROUP BY rel")
def node_predicates_html(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of list items by page, conforming where they hold a link, from trees of tags."""
    html = star.read(spark, sf, "pages").select(F.col("page_id").alias("rel"), F.col("html").alias("content"))
    return nodes.holding(nodes.extract(html), "li", "a").groupBy("rel").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("conforming").alias("conforming"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE page_id % 4 WHEN 0 THEN ' --- `x` | y' WHEN 1 THEN '  <!-- z -->' ELSE '' END"
_MARKED = f"CASE page_id % 5 WHEN 0 THEN '## ' WHEN 1 THEN '1. > ' WHEN 2 THEN '-- ' ELSE '' END || {_TITLE}"
_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{M}\\p{N}\\p{P}\\p{S} ]', ' ', 'g'), '-{3,}|~{3,}|<!--|--!?>|`+|[|]', ' ', 'g'), ' {2,}', ' ', 'g'), ' ')"


@query(f"WITH t AS (SELECT page_id, {_MARKED} AS title, CASE page_id % 3 WHEN 0 THEN 'src/' || page_id || '.js' WHEN 1 THEN 'src/п' || page_id ELSE '' END AS path FROM pages), s AS (SELECT page_id, path, regexp_replace({_STRIPPED}, '^(([#>*+-]+|[0-9]+[.)])[ ]*)+', '') AS title FROM t) SELECT page_id, CASE WHEN length(title) > 200 THEN left(title, 200) || '…' ELSE title END AS title, CASE WHEN contains(path, 'п') THEN '\"<path with mixed scripts, ' || length(path) || ' chars>\"' ELSE '\"' || path || '\"' END AS path FROM s")
def encoded_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with marks that a page would be structured by, and paths, some in more than one script."""
    n = F.col("page_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("src/"), n.cast("string"), F.lit(".js"))).when(n % 3 == 1, F.concat(F.lit("src/п"), n.cast("string"))).otherwise("")
    return star.read(spark, sf, "pages").select("page_id", T.encoded(F.expr(_MARKED)).alias("title"), T.encoded_path(path).alias("path"))


@query("WITH n AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS normal FROM documents) SELECT doc_id, md5(normal) AS normal_md5, length(normal)::BIGINT AS normal_length, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS line_at_end, CASE WHEN contains(text, '@') THEN (length(split_part(text, '@', 1)) - length(replace(split_part(text, '@', 1), chr(10), '')) + 1)::BIGINT END AS line_at_mark FROM n")
def text_positions_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, normalised, and the lines of two offsets of their own: the end and the first at sign."""
    docs = star.read(spark, sf, "documents").select("doc_id", "text", T.normalised(F.col("text")).alias("normal"))
    mark = F.instr("text", "@")
    return docs.select("doc_id", F.md5("normal").alias("normal_md5"), F.length("normal").cast("long").alias("normal_length"), T.line_at(F.col("text"), F.length("text")).alias("line_at_end"), F.when(mark > 0, T.line_at(F.col("text"), mark - 1)).alias("line_at_mark"))


@query("SELECT o_orderkey, (o_orderkey % 7) || '.' || (o_custkey % 12) || '.0' AS version, [o_orderkey % 7, o_custkey % 12, 0] >= [3, 2, 1] AS new_enough FROM orders")
def version_compare(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.read(spark, sf, "orders").select("o_orderkey", F.concat_ws(".", F.col("o_orderkey") % 7, F.col("o_custkey") % 12, F.lit(0)).alias("version"))
    return orders.withColumn("new_enough", P.version(F.col("version")) >= P.version(F.lit("3.2.1")))


def _with_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Judged slots, with a region's own slots as areas above its nations': those of discount_cap state at the region."""
    slots = judged(spark, sf).select("area", "key", "states")
    above = slots.select(F.substring_index("area", "/", 1).alias("area"), "key").distinct().where("key = 'returned_none'").withColumn("states", F.lit("claim"))
    return slots.union(above)


def _ancestor_sql() -> str:
    from plumbline.plans.slot_queries import JUDGED_SQL

    return f"WITH {JUDGED_SQL}, s AS (SELECT area, key, states FROM judged UNION ALL SELECT DISTINCT split_part(area, '/', 1), key, 'claim' FROM judged WHERE key = 'returned_none'), a AS (SELECT DISTINCT area FROM judged) SELECT a.area, s.key, max_by(s.area, length(s.area)) AS from_area FROM a JOIN s ON s.area = a.area OR starts_with(a.area, s.area || '/') WHERE states IS NOT NULL GROUP BY a.area, s.key"


@query(_ancestor_sql())
def ancestor_fallback(spark: SparkSession, sf: str) -> DataFrame:
    slots = _with_ancestors(spark, sf)
    return hierarchy.nearest_stating(slots, slots.where(F.col("area").contains("/")))


_OWN_SQL = """f AS (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'js' ELSE 'ruby' END AS lang, 's' || (p_partkey % 97) AS stem, p_brand || '/' || replace(p_type, ' ', '/') AS bare, p_size <= 30 AS is_source FROM part),
s AS (SELECT *, bare || '/' || stem || '.' || p_partkey AS path FROM f WHERE is_source), t AS (SELECT *, bare || '/' || stem || '.' || p_partkey AS path FROM f WHERE NOT is_source),
c AS (SELECT t.path AS test, s.path FROM t JOIN s ON s.lang = t.lang AND s.stem = t.stem AND (t.p_partkey % 3 = 0 AND s.p_partkey = t.p_partkey - 194 OR t.p_partkey % 5 = 0 AND s.p_partkey = t.p_partkey + 194)),
p AS (SELECT t.path AS test, s.path, list_reverse(string_split(t.bare, '/')) AS a, list_reverse(string_split(s.bare, '/')) AS b FROM t JOIN s ON s.lang = t.lang AND s.stem = t.stem),
n AS (SELECT test, path, len(list_filter(range(1, 1 + least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS shared FROM p),
b AS (SELECT test, max(shared) AS best, count(*) AS sources FROM n GROUP BY test),
w AS (SELECT n.test, count(*) AS winners, min(n.path) AS first, list(n.path) AS won FROM n JOIN b ON n.test = b.test AND n.shared = b.best AND b.sources > 1 GROUP BY n.test),
i AS (SELECT test, count(*) AS imports, min(path) AS import, list(path) AS imported FROM c GROUP BY test)"""


@query(f"WITH {_OWN_SQL} SELECT t.path AS test, CASE WHEN winners = 1 AND (imports IS NULL OR list_contains(imported, first)) THEN first WHEN winners > 1 AND imports = 1 AND list_contains(won, import) THEN import END AS owner FROM t LEFT JOIN w ON w.test = t.path LEFT JOIN i ON i.test = t.path")
def namesake_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files: the smaller are sources, the larger tests; of sources of one stem, the one that a test is for."""
    bare = F.concat(F.col("p_brand"), F.lit("/"), F.replace(F.col("p_type"), F.lit(" "), F.lit("/")))
    stem = F.concat(F.lit("s"), (F.col("p_partkey") % 97).cast("string"))
    there = star.read(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, "js").otherwise("ruby").alias("lang"), stem.alias("stem"), bare.alias("bare")).withColumn("path", F.concat("bare", F.lit("/"), "stem", F.lit("."), F.col("p_partkey").cast("string")))
    sources, tests = there.where("p_size <= 30"), there.where("p_size > 30")
    other = F.explode(F.array_compact(F.array(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") - 194), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") + 194))))
    covers = tests.select(F.col("path").alias("test"), other.alias("p_partkey")).join(sources.select("p_partkey", "path"), "p_partkey").select("test", "path")
    return companions.owners(sources, tests, covers)


_CHAIN_SQL = """k AS (SELECT c_nationkey AS root, c_custkey AS c, 'conf/c' || c_custkey || '.json' AS path, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '../../outside.json' WHEN 2 THEN c_custkey::VARCHAR WHEN 3 THEN '0' ELSE (c_custkey + (SELECT count(*) FROM customer) // 7 * (c_custkey % 3) + 1)::VARCHAR END AS said FROM customer),
e AS (SELECT k.root, k.path, said, CASE WHEN said IS NULL THEN 'ok' WHEN starts_with(said, '..') THEN 'escaped' END AS status, CASE WHEN NOT starts_with(said, '..') THEN 'conf/c' || said || '.json' END AS target FROM k),
w AS (SELECT root, path, path AS last, target, 0 AS hops, [path] AS seen, status FROM e UNION ALL
  SELECT w.root, w.path, w.target, e.target, w.hops + 1, list_append(w.seen, w.target), CASE WHEN list_contains(w.seen, w.target) THEN 'cycle' WHEN e.path IS NULL THEN 'missing' ELSE e.status END FROM w LEFT JOIN e ON e.root = w.root AND e.path = w.target WHERE w.status IS NULL)"""


@query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT root, path, last, hops, status FROM w WHERE status IS NOT NULL")
def config_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations, one to a customer and a root to a nation, that extend others: to an end, in a circle, to one that is not
    there, or out of their root."""
    customers = star.read(spark, sf, "customer").select(F.col("c_nationkey").alias("root"), F.col("c_custkey").alias("c"))
    n = customers.agg((F.floor(F.count(F.lit(1)) / 7)).alias("_seventh"))  # one row
    other = lambda c: F.concat(F.lit("./x/../c"), c.cast("string"))
    c, by = F.col("c"), F.col("c") % 7
    said = F.when(by == 1, "../../outside.json").when(by == 2, other(c)).when(by == 3, other(F.lit(0))).when(by > 3, other(c + F.col("_seventh") * (c % 3) + 1))
    return config.resolved(customers.crossJoin(F.broadcast(n)).select("root", F.concat(F.lit("conf/c"), c.cast("string"), F.lit(".json")).alias("path"), said.alias("extends")))
