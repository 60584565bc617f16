"""Short files of code, one to a customer, with what each dimension is to count in them.

A sample's counts are what its dimensions say of it, written down by hand; queries hold the extractor, the registry and the
engine against them. Of a learned dimension, the classes of its sites are given instead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import star


class Sample(NamedTuple):
    family: str
    name: str  # of the file, below `src/<customer>/`, or from the root if it begins with a slash; {n} is the customer
    lang: str
    text: str
    counts: dict[str, tuple[int, int]]  # by dimension: candidates, conforming
    classes: dict[str, str] = {}  # by learned dimension: the sites' classes, sorted, `-` for none


_F, _V = "function_style", "module_state_const"
_RUBY_MODEL = "class Post < ApplicationRecord\n"

SAMPLES = (
    # errors, state and functions
    Sample("js", "a.js", "js", "try { run(); } catch (e) { report(e); }\n", {"swallowed_error": (1, 1)}),
    Sample("js", "a.js", "js", "try { run(); } catch (e) { count(); }\n", {"swallowed_error": (1, 0)}),
    Sample("js", "a.js", "js", "try { run(); } catch { throw new Problem(); }\n", {"swallowed_error": (1, 1)}),
    Sample("js", "a.js", "js", "try { run(); } catch (e) { }\n", {"swallowed_error": (1, 0)}),
    Sample("js", "a.js", "js", "function f() { throw new Problem(); }\n", {"error_shape": (1, 0), _F: (1, 1)}),
    Sample("js", "a.js", "js", "function f() { return { ok: true }; }\n", {"error_shape": (1, 1), _F: (1, 1)}),
    Sample("js", "a.js", "js", "const a = 1;\nlet b = 2;\nlet c = 3;\nc = 4;\n", {_V: (2, 1)}),
    Sample("js", "a.js", "js", "for (const x of xs) { let y = 1; go(x, y); }\n", {"iterate_with_for_of": (1, 1)}),
    Sample("js", "a.js", "js", "xs.forEach(go);\n", {"iterate_with_for_of": (1, 0)}),
    Sample("js", "a.js", "js", "async function f() { try { await x(); } catch (e) { y(e); } }\n", {"async_error_handling": (1, 1), "swallowed_error": (1, 1), _F: (1, 1)}),
    Sample("js", "a.js", "js", "async function f() { const g = () => { try { a(); } catch (e) { b(e); } }; }\n", {"async_error_handling": (1, 0), "swallowed_error": (1, 1), _F: (1, 1)}),
    Sample("js", "a.js", "js", "call(options.name);\ncall(options[name]);\n", {"optional_chaining": (1, 0)}),
    Sample("js", "a.js", "js", "call(options?.name);\n", {"optional_chaining": (1, 1), "non_null_assertion": (1, 1)}),
    Sample("js", "a.ts", "js", "go(x!.y);\ngo(!x.y);\n", {"non_null_assertion": (1, 0)}),
    Sample("js", "a.js", "js", "const f = () => 1;\n", {_F: (1, 0), _V: (1, 1)}),
    Sample("js", "a.js", "js", "go(a ?? 1);\ngo(a || b);\n", {"nullish_default": (1, 1)}),
    Sample("js", "a.js", "js", "go(a || []);\ngo(a || 'x');\n", {"nullish_default": (2, 0)}),
    Sample("js", "a.js", "js", "function f() { return null; }\n", {"absent_is_null": (1, 1), _F: (1, 1)}),
    Sample("js", "a.js", "js", "function f() { return undefined; }\n", {"absent_is_null": (1, 0), _F: (1, 1)}),
    # exports, types and imports
    Sample("modules", "a.ts", "js", "export function useOne() { return 1; }\n", {"hook_per_module": (1, 1), _F: (1, 1), "explicit_return_type": (1, 0), "doc_comment_style": (1, 0)}, {"function_naming_case": "camelCase", "exported_symbol_case": "camelCase"}),
    Sample("modules", "a.ts", "js", "export function useOne(): number { return 1; }\nexport function useTwo(): number { return 2; }\n", {"hook_per_module": (1, 0), _F: (2, 2), "explicit_return_type": (2, 2), "doc_comment_style": (2, 0)}, {"function_naming_case": "camelCase,camelCase", "exported_symbol_case": "camelCase,camelCase"}),
    Sample("modules", "a.ts", "js", "/** What it does. */\nexport function go(): void { }\n", {_F: (1, 1), "explicit_return_type": (1, 1), "doc_comment_style": (1, 1)}),
    Sample("modules", "a.ts", "js", "// eslint-disable-next-line\nexport function go(): void { }\n", {_F: (1, 1), "explicit_return_type": (1, 1), "doc_comment_style": (1, 0)}),
    Sample("modules", "a.ts", "js", "export const go = (): number => 1;\n", {_F: (1, 0), "explicit_return_type": (1, 1), "doc_comment_style": (1, 0), _V: (1, 1)}),
    Sample("modules", "a.js", "js", "import a from './a.js';\nimport b from '../b';\nimport c from 'c';\nimport './d.css';\n", {"import_extension": (2, 1)}),
    Sample("modules", "a.test.js", "js", "test('a', () => { expect(a).toBe(1); });\n", {"test_call_style": (1, 1), "assertion_style": (1, 1)}),
    Sample("modules", "a.test.js", "js", "it('a', () => { assert.equal(a, 1); assert(b); });\n", {"test_call_style": (1, 0), "assertion_style": (2, 0)}),
    # components
    Sample("jsx", "a.jsx", "jsx", "go(useState(0));\ngo(React.useMemo(f));\ngo(useThing());\n", {"hook_call_style": (2, 1)}),
    Sample("jsx", "a.jsx", "jsx", "show(<b onClick={() => go()} onFocus={this.go} title={x} />);\n", {"handler_is_named": (2, 1)}),
    Sample("jsx", "a.jsx", "jsx", "show(<Thing {...props} />);\nshow(<div {...attrs} />);\n", {"spread_on_component": (2, 1)}),
    Sample("jsx", "a.jsx", "jsx", "import { t } from 'i18next';\nshow(<p>Hello there</p>);\nshow(<p>{t('key')}</p>);\n", {"text_translated": (2, 1)}),
    Sample("jsx", "a.jsx", "jsx", "show(<p>Hello there</p>);\n", {}),
    Sample("jsx", "a.jsx", "jsx", "const go = useCallback(() => 1, []);\nshow(<b onClick={go} />);\n", {"handler_memoised": (1, 1), "handler_is_named": (1, 1), "hook_call_style": (1, 1), _V: (1, 1)}),
    Sample("jsx", "a.jsx", "jsx", "const go = () => 1;\nshow(<b onClick={go} />);\n", {"handler_memoised": (1, 0), "handler_is_named": (1, 1), _F: (1, 0), _V: (1, 1)}),
    # names
    Sample("naming", "my-file.js", "js", "function fooBar() { }\nfunction foo_bar() { }\n", {_F: (2, 2)}, {"file_naming_case": "kebab-case", "function_naming_case": "camelCase,snake_case"}),
    Sample("naming", "01-myFile.js", "js", "export class FooBar { }\nexport class fooBar { }\n", {"doc_comment_style": (2, 0)}, {"file_naming_case": "camelCase", "exported_class_case": "PascalCase,camelCase"}),
    Sample("naming", "MyFile.ts", "js", "export interface IUser { }\nexport interface Item { }\nexport type TName = string;\nexport enum Kind { A }\n", {}, {"file_naming_case": "PascalCase", "exported_type_case": "PascalCase,PascalCase,PascalCase,PascalCase", "interface_prefix": "I,none", "type_alias_prefix": "T"}),
    Sample("naming", "my_file.rb", "ruby", "class Foo < Bar::Base\nend\n", {}, {"file_naming_case": "snake_case", "class_base": "Bar::Base", "module_include": "-"}),
    Sample("naming", "a.js", "js", "class A extends Base { }\nclass B extends React.Component { }\n", {}, {"extends_base": "Base,React.Component"}),
    Sample("naming", "a.js", "js", "export const fooBar = 1;\nexport const x = 2;\n", {_V: (2, 2)}, {"exported_symbol_case": "camelCase"}),
    # migrations
    Sample("rails", "a.rb", "ruby", "class M < ActiveRecord::Migration[7.0]\n  def change\n    create_table :a, id: :uuid do |t|\n      t.string :n, null: false\n      t.text :m\n    end\n  end\nend\n", {"migration_reversible": (1, 1), "migration_schema_only": (1, 1), "table_primary_key_declared": (1, 1), "column_null_declared": (2, 1)}, {"class_base": "ActiveRecord::Migration[7.0]", "module_include": "-"}),
    Sample("rails", "a.rb", "ruby", "class M < ActiveRecord::Migration[7.0]\n  def up\n    create_table :a do |t|\n      t.references :b, foreign_key: true\n    end\n    add_reference :a, :c\n  end\n  def down\n    drop_table :a\n  end\nend\n", {"migration_reversible": (1, 0), "migration_schema_only": (1, 1), "table_primary_key_declared": (1, 0), "reference_foreign_key": (2, 1)}, {"class_base": "ActiveRecord::Migration[7.0]", "module_include": "-"}),
    Sample("rails", "a.rb", "ruby", "class M < ActiveRecord::Migration[7.0]\n  def change\n    User.update_all(a: 1)\n  end\nend\n", {"migration_schema_only": (1, 0)}, {"class_base": "ActiveRecord::Migration[7.0]", "module_include": "-"}),
    Sample("rails", "a.rb", "ruby", _RUBY_MODEL + "  before_save :x\nend\n", {"model_callbacks": (1, 0)}, {"class_base": "ApplicationRecord", "module_include": "-"}),
    Sample("rails", "a.rb", "ruby", _RUBY_MODEL + "  def go\n    User.find(1)\n    User.find_by(id: 1)\n  end\nend\n", {"model_callbacks": (1, 1), "record_lookup": (2, 1)}, {"class_base": "ApplicationRecord", "module_include": "-"}),
    # other Ruby
    Sample("ruby", "a.rb", "ruby", "def go\n  run\nrescue Oops => e\n  report(e)\nend\n", {"rescue_uses_error": (1, 1)}),
    Sample("ruby", "a.rb", "ruby", "def go\n  run\nrescue Oops => e\n  count\nend\n", {"rescue_uses_error": (1, 0)}),
    Sample("ruby", "a.rb", "ruby", "def go\n  run\nrescue Oops\n  raise\nend\n", {"rescue_uses_error": (1, 1)}),
    Sample("ruby", "a.rb", "ruby", "class Pay < Base\n  def call(a, b, c)\n    raise Oops\n  end\nend\n", {"service_result_shape": (1, 0), "keyword_params": (1, 0)}, {"class_base": "Base", "module_include": "-"}),
    Sample("ruby", "a.rb", "ruby", "class Pay < Base\n  def call(a:, b:, c: 1)\n    done\n  end\nend\n", {"service_result_shape": (1, 1), "keyword_params": (1, 1)}, {"class_base": "Base", "module_include": "-"}),
    Sample("ruby", "a.rb", "ruby", "def go\n  [Time.now, Time.current, Time.zone.now, Date.today]\nend\n", {"zone_aware_time": (4, 2)}),
    Sample("ruby", "a.rb", "ruby", "def go\n  puts 'a'\n  logger.info('b')\n  Rails.logger.warn('c')\nend\n", {"logger_over_puts": (3, 2)}),
    Sample("ruby", "a.rb", "ruby", "def go\n  Net::HTTP.get(u)\n  client.post(u)\nend\n", {"http_through_client": (2, 1)}),
    Sample("ruby", "a.rb", "ruby", "class A < Oops::Error\n  include Comparable\n  include Help\nend\n", {}, {"module_include": "Comparable,Help"}),
    Sample("ruby", "a.rb", "ruby", "module Outer\n  class Inner < Oops::Error\n    include Help\n  end\nend\n", {}, {"module_include": "-,Help"}),
    # capabilities
    Sample("capability", "a.js", "js", "import { logger } from './logger';\nconsole.log(1);\nlogger.info(2);\n", {"route_logging": (2, 1), "import_extension": (1, 0)}),
    Sample("capability", "a.js", "js", "import client from '../http/client.js';\nfetch(u);\nclient.get(u);\n", {"route_network": (2, 1), "import_extension": (1, 1)}),
    Sample("capability", "a.js", "js", "import { config } from './config.js';\ngo(process.env.HOME);\ngo(config.home);\n", {"route_env": (2, 1), "import_extension": (1, 1), "optional_chaining": (1, 0)}),
    Sample("capability", "logger.js", "js", "console.log(1);\n", {}),
    # companions: the file itself is what counts
    *(
        Sample("pairing", name, "ruby", "x = 1\n", counts, {"file_naming_case": case[0]} if case else {})
        for name, counts, *case in (
            ("/lib/tasks/t{n}.rake", {"rake_task_spec": (1, 0)}),
            ("/app/models/m{n}.rb", {"model_spec": (1, 1), "model_test": (1, 0)}),
            ("/spec/models/m{before}_spec.rb", {}, "snake_case"),
            ("/app/services/s{n}.rb", {"service_spec": (1, 0)}),
            ("/app/jobs/j{n}.rb", {"job_spec": (1, 0), "job_test": (1, 1)}),
            ("/test/jobs/j{before}_test.rb", {}, "snake_case"),
            ("/app/workers/w{n}.rb", {"worker_spec": (1, 1)}),
            ("/spec/workers/w{before}_spec.rb", {}, "snake_case"),
            ("/app/controllers/c{n}.rb", {"controller_spec": (1, 0)}),
            ("/app/serializers/z{n}.rb", {"serializer_spec": (1, 0)}),
        )
    ),
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, lang, stripped, content, sample: a file for each customer, of the sample that its number says."""
    n = F.col("c_custkey")
    rows = [(i, s.name if s.name.startswith("/") else "/src/{n}/" + s.name, s.lang, s.text) for i, s in enumerate(SAMPLES)]
    table = spark.createDataFrame(rows, "sample int, name string, lang string, content string")  # one row a sample
    customers = star.customers(spark, sf_dir).select("c_custkey", F.pmod(n, F.lit(len(SAMPLES))).cast("int").alias("sample"))
    rel = F.replace(F.replace(F.expr("substring(name, 2)"), F.lit("{n}"), n.cast("string")), F.lit("{before}"), (n - 1).cast("string"))
    return customers.join(F.broadcast(table), "sample").select(rel.alias("rel"), "lang", (n % 7 == 0).alias("stripped"), "content", "sample")


#: Files and what they are: imports as module=names, exports, jsx, typed, test calls, runner, empty, helpers of their own.
FACETS = (
    ("a.test.ts", "js", "import a, { b as c, d } from './x';\nimport * as q from 'vitest';\nimport type { T } from 'jest';\nimport './s.css';\ntest('a', () => {});\n", "./s.css= ./x=default+b+d jest=T vitest=*", "", False, False, True, "vitest", False, 0),
    ("a.js", "js", "const { a, b: c } = require('mocha');\ndescribe('x', () => { it('y', () => {}); });\nmodule.exports = { a };\nexports.k = 2;\n", "mocha=a+b", "a,k", False, False, True, "mocha", False, 0),
    ("a.js", "js", "export const z = 1;\nexport default function () { }\nfunction helper() { }\nfunction shown() { }\nexport { shown as other };\n", "", "default,other,z", False, False, False, None, False, 1),
    ("a.jsx", "jsx", "import { test } from 'jest';\nexport function Page() { return <p>Hi</p>; }\n", "jest=test", "Page", True, False, False, None, False, 0),
    ("a.ts", "js", "const x: number = 1;\nconst f = () => { it('a', b); };\n", "", "", False, True, False, None, False, 1),
    ("a.js", "js", "// nothing but a note\n", "", "", False, False, False, None, True, 0),
    ("a_spec.rb", "ruby", "RSpec.describe Foo do\n  it 'a' do\n  end\nend\n", "", "", False, False, True, "rspec", False, 0),
    ("a.rb", "ruby", "class FooTest < ActiveSupport::TestCase\n  test 'a' do\n  end\nend\n", "", "", False, False, True, "minitest", False, 0),
    ("a.rb", "ruby", "class Foo\n  def test_x\n  end\nend\n", "", "", False, False, False, None, False, 0),
    ("a_test.rb", "ruby", "class Foo\n  def test_x\n  end\nend\n", "", "", False, False, True, "minitest", False, 0),
    ("a.rb", "ruby", "# nothing but a note\n", "", "", False, False, False, None, True, 0),
)


def facet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, lang, content: a file for each customer, of FACETS in turn."""
    n = F.col("c_custkey")
    table = spark.createDataFrame([(i, f[0], f[1], f[2]) for i, f in enumerate(FACETS)], "sample int, name string, lang string, content string")  # one row a sample
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.pmod(n, F.lit(len(FACETS))).cast("int").alias("sample"))
    return customers.join(F.broadcast(table), "sample").select(F.concat(F.lit("src/"), n.cast("string"), F.lit("/"), "name").alias("rel"), "lang", "content")
