import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.api import Engine, facts, rendered, write_map
from plumbline.operators import dimensions
from plumbline.sources import lexical

GOOD = "import {a} from './b';\nexport const x%d = 1;\nlet n%d = null ?? 'd';\nfunction goodName() { try { a(); } catch (e) { throw e; } return null; }\ntest('x', () => { expect(1); });\n"


def tree(spark, n=48, bad=()):
    rows = [(f"src/{'ab'[i % 2]}/some-file-{i}.js", "js", False, (GOOD % (i, i)) if i not in bad else (GOOD % (i, i)).replace("throw e;", "")) for i in range(n)]
    rows += [("app/models/user.rb", "ruby", False, "class User < ApplicationRecord\nend\n"), ("app/models/post.rb", "ruby", False, "class Post < ApplicationRecord\n  before_save :x\nend"), ("spec/models/user_spec.rb", "ruby", False, ""), ("odd.js", "js", False, None)]
    return spark.createDataFrame(rows, "rel string, lang string, stripped boolean, content string")


@pytest.fixture(scope="module")
def scanned(spark):
    files = tree(spark)
    authors = files.select("rel", F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z[bot]"))).alias("author"))
    return Engine(spark).scan(files, authors=authors)


def test_registry_is_whole():
    assert len(registry.DIMENSIONS) == 58 and sum(d.counter for d in registry.DIMENSIONS) == 13
    with pytest.raises(ValueError, match="unique"):
        registry.validate((*registry.DIMENSIONS, registry.DIMENSIONS[0]))
    with pytest.raises(ValueError, match="predicate"):
        registry.validate((registry.Dimension("k", "precise", ("js",), site="true"),))


def sites_of(spark, text, lang="js"):
    nodes = lexical.extract(spark.createDataFrame([("f", lang, text)], "rel string, lang string, content string"))
    return sorted((r.key, r.conforming, r["class"]) for r in dimensions.tree_sites(nodes).collect() if r.conforming is not None or r["class"] is not None)


@pytest.mark.parametrize(
    ("lang", "text", "site"),
    [
        ("js", "try { a() } catch (e) { log(e) }", ("swallowed_error", True, None)),
        ("js", "try { a() } catch (e) { b() }", ("swallowed_error", False, None)),
        ("js", "try { a() } catch {}", ("swallowed_error", False, None)),
        ("js", "const a = 1;", ("module_state_const", True, None)),
        ("js", "let a = 1;", ("module_state_const", False, None)),
        ("js", "async function f() { try { x() } finally {} }", ("async_error_handling", True, None)),
        ("js", "async function f() { x() }", ("async_error_handling", False, None)),
        ("js", "x = opts.a", ("optional_chaining", False, None)),
        ("js", "x = opts?.a", ("optional_chaining", True, None)),
        ("js", "export function useA() {}", ("hook_per_module", True, None)),
        ("js", "export function useA() {} export const useB = () => 1", ("hook_per_module", False, None)),
        ("js", "import a from './x.js'", ("import_extension", True, None)),
        ("js", "x = a || 'b'", ("nullish_default", False, None)),
        ("js", "return undefined", ("absent_is_null", False, None)),
        ("js", "for (const a of b) {}", ("iterate_with_for_of", True, None)),
        ("js", "it('a', f)", ("test_call_style", False, None)),
        ("js", "class A extends B.C {}", ("extends_base", None, "B.C")),
        ("js", "interface IName {}", ("interface_prefix", None, "I")),
        ("js", "function getThing() {}", ("function_naming_case", None, "camelCase")),
        ("ruby", "def a\nrescue X => e\n  log(e)\nend", ("rescue_uses_error", True, None)),
        ("ruby", "def a\nrescue X => e\nend", ("rescue_uses_error", False, None)),
        ("ruby", "def a(b, c:, d:)\nend", ("keyword_params", False, None)),
        ("ruby", "User.find_by(id: 1)", ("record_lookup", True, None)),
        ("ruby", "Time.zone.now", ("zone_aware_time", True, None)),
        ("ruby", "Time.now", ("zone_aware_time", False, None)),
        ("ruby", "class A < ApplicationRecord\nend", ("model_callbacks", True, None)),
    ],
)
def test_sites_of_dimensions(spark, lang, text, site):
    assert site in sites_of(spark, text, lang)


MIGRATION = "class A < ActiveRecord::Migration[7.0]\n  def change\n    %s\n  end\nend"
TABLE = MIGRATION % "create_table :pets%s do |t|\n      %s\n    end"


@pytest.mark.parametrize(
    ("lang", "text", "site"),
    [
        ("js", "return { ok: true, value: { a } }", ("error_shape", True, None)),
        ("js", "return Result.err(a)", ("error_shape", True, None)),
        ("js", "/** Adds. */\nexport function add() {}", ("doc_comment_style", True, None)),
        ("js", "const s = 'longer text';\n// Adds.\n// eslint-disable-next-line x\nexport const add = () => 1", ("doc_comment_style", True, None)),
        ("js", "// eslint-disable-next-line x\nexport function add() {}", ("doc_comment_style", False, None)),
        ("js", "a(); // that was a\nexport function add() {}", ("doc_comment_style", False, None)),
        ("js", "x = a!.b", ("non_null_assertion", False, None)),
        ("js", "x = a?.b", ("non_null_assertion", True, None)),
        ("js", "export const f = (a: string): number => 1", ("explicit_return_type", True, None)),
        ("js", "import { log as note } from './lib/app-logger';\nnote.info('a')", ("route_logging", True, None)),
        ("js", "console.log('a')", ("route_logging", False, None)),
        ("js", "import api from '../apiClient';\nawait api.users.get(1)", ("route_network", True, None)),
        ("js", "fetch('/a')", ("route_network", False, None)),
        ("js", "x = process.env.PORT", ("route_env", False, None)),
        ("js", "const { PORT } = process.env", ("route_env", False, None)),
        ("js", "import config from './config';\nx = config.db.host", ("route_env", True, None)),
        ("jsx", "x = <a onClick={() => { b() }}>c</a>", ("handler_is_named", False, None)),
        ("jsx", "x = <a onClick={this.b} />", ("handler_is_named", True, None)),
        ("jsx", "const h = useCallback(() => 1, []);\nx = <B onClick={h} />", ("handler_memoised", True, None)),
        ("jsx", "function C() { function h() {}\n return (<p><B onClick={h} /></p>) }", ("handler_memoised", False, None)),
        ("jsx", "x = <B {...props} />", ("spread_on_component", True, None)),
        ("jsx", "x = <b {...props} />", ("spread_on_component", False, None)),
        ("jsx", "import { t } from 'i18next';\nx = <p>Hello</p>", ("text_translated", False, None)),
        ("jsx", "import { t } from 'i18next';\nx = <p>{t('a')}</p>", ("text_translated", True, None)),
        ("ruby", "class A < ApplicationRecord\n  before_save :x\nend", ("model_callbacks", False, None)),
        ("ruby", MIGRATION % "User.update_all(a: 1)", ("migration_schema_only", False, None)),
        ("ruby", MIGRATION % "execute <<~SQL\n      UPDATE pets SET a = 1\n    SQL", ("migration_schema_only", False, None)),
        ("ruby", MIGRATION % "execute 'CREATE INDEX a ON b (c)'", ("migration_schema_only", True, None)),
        ("ruby", TABLE % ("", "t.string :name, null: false"), ("column_null_declared", True, None)),
        ("ruby", TABLE % ("", "t.string :name, limit: 9"), ("column_null_declared", False, None)),
        ("ruby", TABLE % (", id: :uuid", ""), ("table_primary_key_declared", True, None)),
        ("ruby", TABLE % ("", ""), ("table_primary_key_declared", False, None)),
        ("ruby", TABLE % ("", "t.references :owner, foreign_key: { to_table: :users }"), ("reference_foreign_key", True, None)),
        ("ruby", MIGRATION % "add_reference :pets, :owner", ("reference_foreign_key", False, None)),
        ("ruby", MIGRATION % "add_reference :pets, :owner\n    add_foreign_key :pets, :owners", ("reference_foreign_key", True, None)),
        ("ruby", "Time.zone.parse(a)", ("zone_aware_time", True, None)),
    ],
)
def test_both_sides_of_dimensions(spark, lang, text, site):
    assert site in sites_of(spark, text, lang)


@pytest.mark.parametrize(
    ("lang", "text", "key"),
    [
        ("js", "x = !a && b !== c; return!(d)", "non_null_assertion"),
        ("js", "a!.b = 1", "non_null_assertion"),
        ("js", "return { value: { ok: 1 } }", "error_shape"),
        ("jsx", "function B({ a, ...rest }) { return <b {...rest} /> }", "spread_on_component"),
        ("jsx", "x = <p>Hello</p>", "text_translated"),
        ("jsx", "x = <a onClick={undefined} />", "handler_is_named"),
        ("ruby", "class A < ApplicationRecord\n  belongs_to :b\nend", "reference_foreign_key"),
        ("ruby", MIGRATION % "execute sql", "migration_schema_only"),
        ("ruby", TABLE % ("", "t.string :name, null: allowed"), "column_null_declared"),
        ("ruby", TABLE % ("", "t.string :name, **options"), "column_null_declared"),
        ("ruby", TABLE % ("", "t.references :owner, polymorphic: true"), "reference_foreign_key"),
    ],
)
def test_what_is_no_site(spark, lang, text, key):
    assert not [s for s in sites_of(spark, text, lang) if s[0] == key]


def test_the_module_of_a_concern_is_no_site_of_its_own(spark):
    rows = [("src/logger.js", "js", "console.log('a')"), ("src/other.js", "js", "console.log('a')")]
    nodes = lexical.extract(spark.createDataFrame(rows, "rel string, lang string, content string"))
    assert [r.rel for r in dimensions.tree_sites(nodes).where("key = 'route_logging'").collect()] == ["src/other.js"]


def test_unseen_dimensions_are_not_offered(spark):
    """Over the extractor's own nodes; a parser's nodes are asked for every dimension."""
    assert set(lexical.UNSEEN) <= {d.key for d in registry.DIMENSIONS}
    node = ("a.ts", 0, 0, 0, "CallChain", None, [], None, None, 1, {"length": "2", "receiver_types": "2"})
    files = spark.createDataFrame([("a.ts", "js", False, "a.b().c()")], "rel string, lang string, stripped boolean, content string")
    nodes = spark.createDataFrame([node], dimensions.NODES)
    keys = lambda found: {r.key for r in found.where("pre IS NOT NULL").collect()}
    assert keys(Engine(spark).sites(files, nodes)) == {"law_of_demeter"} and not keys(Engine(spark).sites(files)) & set(lexical.UNSEEN)


def test_let_that_changes_is_no_site(spark):
    assert not [s for s in sites_of(spark, "let a = 1; a = 2;") if s[0] == "module_state_const"]


def test_scan_states_what_the_counts_support(scanned):
    by_key = {(r.area, r.key): r for r in scanned.slots.collect()}
    assert {a for a, _ in by_key} == {"src/a", "src/b"} and {r.area: r.files for r in scanned.areas.collect()} == {"src/a": 24, "src/b": 24}
    slot = by_key["src/a", "swallowed_error"]
    assert (slot.candidates, slot.conforming, slot.applicability, slot.lang_files, slot.authors) == (24, 24, 24, 24, 2)
    assert slot.failed == "evidence"  # 24 of 24 bounds at 0.86, and the pool of another 24 at no more
    assert by_key["src/a", "file_naming_case"].learned == "kebab-case"


def test_no_more_areas_than_a_tree_may_have(spark):
    """Of 130 directories, 120 areas and their parents are left, and every file has its home."""
    rows = [(f"src/p{d % 10}/dir{d}/f{i}.js", "js", False, "const a = 1;") for d in range(130) for i in range(8 + d % 2)]
    found = Engine(spark, tuple(d for d in registry.DIMENSIONS if d.key == "module_state_const")).scan(spark.createDataFrame(rows, "rel string, lang string, stripped boolean, content string"))
    assert found.areas.count() == 120 and found.owned.count() == len(rows)


def test_pairing_sites(spark):
    found = {r.rel: r.conforming for r in dimensions.pairing_sites(tree(spark)).where("key = 'model_spec'").collect()}
    assert found == {"app/models/user.rb": True, "app/models/post.rb": False}


def test_check_finds_the_planted_violation(spark):
    engine = Engine(spark)
    files = tree(spark, 100)
    authors = files.select("rel", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("author"))
    base = engine.scan(files, authors=authors)
    now, before = engine.sites(tree(spark, 100, bad=(7,))), engine.sites(files)
    of = lambda **options: [(r.rel, r.key, r.severity, r.reason) for r in engine.check(base, now, before, **options).collect()]
    bad = ("src/b/some-file-7.js", "swallowed_error")
    assert of(pinned=True) == [(*bad, "MUST-FIX", "clear")]
    assert of() == [(*bad, "FIX", "no-baseline")] and of(pinned=True, stale=True) == [(*bad, "FIX", "stale")]
    assert of(pinned=True, budget=2) == [(*bad, "FIX", "dropped")]
    assert engine.check(base, before, before).count() == 0
    ranges = spark.createDataFrame([("src/b/some-file-7.js", 4, 5), ("src/b/some-file-9.js", 1, 1)], "path string, low int, high int")
    assert [(r.rel, r.key) for r in engine.check(base, now, before.limit(0), added=ranges).collect()] == [bad]


def test_check_reads_the_pinned_counts_and_the_areas_above(spark):
    """A thin population, one that is not perfect, a listed exception, a directory of an area above, and a place outside all."""
    ok, bad = "try { a(); } catch (e) { log(e); }\n", "try { a(); } catch (e) { b(); }\n"
    rows = [(f"src/{d}/f{i}.js", ok) for d, n in (("thin", 20), ("full", 60), ("part", 80), ("full/deep", 2)) for i in range(n)]
    rows = [(rel, bad if rel in ("src/part/f1.js", "src/part/f2.js") else text) for rel, text in rows]
    frame = lambda x: spark.createDataFrame([(rel, "js", False, text) for rel, text in x], "rel string, lang string, stripped boolean, content string")
    engine = Engine(spark, tuple(d for d in registry.DIMENSIONS if d.key == "swallowed_error"))
    authors = frame(rows).select("rel", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("author"))
    found = engine.scan(frame(rows), authors=authors, min_files=F.lit(5))
    assert {r.area: r.states for r in found.slots.collect()} == {"src/thin": "claim", "src/full": "claim", "src/part": "claim"}
    head = frame([("src/thin/f3.js", bad), ("src/full/f3.js", bad), ("src/part/f3.js", bad), ("src/part/f1.js", bad * 2), ("src/full/new/g.js", bad), ("odd/g.js", bad)])
    out = {r.rel: (r.severity, r.reason) for r in engine.check(found, engine.sites(head), engine.sites(frame(rows)), pinned=True).collect()}
    assert out == {"src/thin/f3.js": ("FIX", "borrowed"), "src/full/f3.js": ("MUST-FIX", "clear"), "src/part/f3.js": ("FIX", "imperfect"), "src/part/f1.js": ("FIX", "exception-listed"), "src/full/new/g.js": ("MUST-FIX", "clear"), "odd/g.js": ("NIT", "no-dimension")}


def test_pin_and_exports(spark, scanned, tmp_path):
    now, delta = Engine(spark).pin(scanned)
    assert {(r.area, r.change) for r in delta.collect()} == {("src/a", "new"), ("src/b", "new")}
    assert {r.change for r in Engine(spark).pin(scanned, now)[1].collect()} == {"same"}
    facts(scanned).write.parquet(f"{tmp_path}/facts")
    assert '"area":"src/a"' in spark.read.parquet(f"{tmp_path}/facts").where("area = 'src/a'").first().json
    texts = {r.area: r.text.split("\n") for r in rendered(scanned, 5).collect()}
    assert set(texts) == {"src/a", "src/b"} and all(len(t) <= 5 for t in texts.values())
    paths = write_map(scanned, f"file://{tmp_path}/map")
    assert len(paths) == 2 and not list((tmp_path / "map").glob(".*.draft"))
    assert any((tmp_path / "map" / p.rpartition("/")[2]).read_text().startswith("# src/a\n") for p in paths)


def test_customers_of_one_split_are_dealt(spark, tmp_path):
    """Files that customers stand for are made by as many tasks as there are cores, though the table is one row group."""
    from plumbline.plans import engine_queries
    from plumbline.sources import samples

    spark.range(4000).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for made in (samples.files(spark, str(tmp_path)), engine_queries._customers(spark, str(tmp_path))):
        assert made.count() == 4000
        assert len([n for n in made.rdd.glom().map(len).collect() if n]) >= spark.sparkContext.defaultParallelism
