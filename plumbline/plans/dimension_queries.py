"""The registry's dimensions over sample files of code, each family against what its samples are known to count."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.api import Engine
from plumbline.plans.registry import QUERIES, SQL, query
from plumbline.registry import DIMENSIONS
from plumbline.sources import facets, samples

_BLIND = {d.key for d in DIMENSIONS if d.blind}
FAMILIES = {
    "js": [d.key for d in DIMENSIONS if d.key in ("swallowed_error", "error_shape", "module_state_const", "async_error_handling", "optional_chaining", "function_style", "nullish_default", "non_null_assertion", "absent_is_null", "iterate_with_for_of")],
    "modules": ["hook_per_module", "explicit_return_type", "import_extension", "test_call_style", "assertion_style", "doc_comment_style"],
    "jsx": ["hook_call_style", "handler_is_named", "spread_on_component", "text_translated", "handler_memoised"],
    "naming": ["file_naming_case", "function_naming_case", "exported_symbol_case", "exported_class_case", "exported_type_case", "extends_base", "interface_prefix", "type_alias_prefix"],
    "rails": ["migration_reversible", "migration_schema_only", "column_null_declared", "table_primary_key_declared", "reference_foreign_key", "record_lookup", "model_callbacks"],
    "ruby": ["rescue_uses_error", "service_result_shape", "keyword_params", "zone_aware_time", "logger_over_puts", "http_through_client", "class_base", "module_include"],
    "capability": ["route_logging", "route_network", "route_env"],
    "pairing": [d.key for d in DIMENSIONS if d.kind == "pairing"],
}


def _expected(keys: list[str]) -> str:
    """SQL: what the samples say of some dimensions, for each file that a customer stands for."""
    rows = []
    for i, s in enumerate(samples.SAMPLES):
        for key in keys:
            if key in s.counts:
                rows.append(f"({i}, '{key}', {s.counts[key][0]}, {s.counts[key][1]}, NULL)")
            elif key in s.classes:
                rows.append(f"({i}, '{key}', {s.classes[key].count(',') + 1}, 0, '{s.classes[key]}')")
    names = ", ".join(f"({i}, '{s.name if s.name.startswith('/') else '/src/{n}/' + s.name}')" for i, s in enumerate(samples.SAMPLES))
    blind = ", ".join(f"'{k}'" for k in sorted(_BLIND))
    return f"""WITH want AS (SELECT * FROM (VALUES {", ".join(rows)}) AS w(sample, key, candidates, conforming, classes)), named AS (SELECT * FROM (VALUES {names}) AS n(sample, name)),
files AS (SELECT replace(replace(substr(name, 2), '{{n}}', c_custkey::VARCHAR), '{{before}}', (c_custkey - 1)::VARCHAR) AS rel, sample, c_custkey % 7 = 0 AS stripped FROM customer JOIN named ON sample = c_custkey % {len(samples.SAMPLES)})
SELECT rel, key, candidates::BIGINT AS candidates, conforming::BIGINT AS conforming, classes FROM files JOIN want USING (sample) WHERE NOT (stripped AND key IN ({blind}))"""


def _pairing() -> str:
    """SQL: producers by their paths alone, and whether the path that a companion would have is there."""
    names = ", ".join(f"({i}, '{s.name if s.name.startswith('/') else '/src/{n}/' + s.name}')" for i, s in enumerate(samples.SAMPLES))
    rules = ", ".join(f"('{d.key}', '{d.from_}/', '.{d.ext}', '{d.to}/', '{d.suffix}')" for d in DIMENSIONS if d.kind == "pairing")
    return f"""WITH named AS (SELECT * FROM (VALUES {names}) AS n(sample, name)), rules AS (SELECT * FROM (VALUES {rules}) AS r(key, source, ext, target, suffix)),
files AS (SELECT replace(replace(substr(name, 2), '{{n}}', c_custkey::VARCHAR), '{{before}}', (c_custkey - 1)::VARCHAR) AS rel FROM customer JOIN named ON sample = c_custkey % {len(samples.SAMPLES)})
SELECT f.rel, key, 1::BIGINT AS candidates, (c.rel IS NOT NULL)::BIGINT AS conforming, NULL::VARCHAR AS classes FROM files f JOIN rules ON starts_with(f.rel, source) AND ends_with(f.rel, ext) AND NOT ends_with(f.rel, suffix) LEFT JOIN (SELECT DISTINCT rel FROM files) c ON c.rel = target || replace(substr(f.rel, length(source) + 1), ext, suffix)"""


def dimension_family(spark: SparkSession, sf: str, family: str) -> DataFrame:
    """rel, key, candidates, conforming and, of learned dimensions, the sites' classes."""
    keys = set(FAMILIES[family])
    engine = Engine(spark, tuple(d for d in DIMENSIONS if d.key in keys))
    sites = engine.sites(samples.files(spark, sf).drop("sample"), frameworks=("rails",)).where(F.col("key").isin(*keys))
    learned = F.col("key").isin(*[d.key for d in DIMENSIONS if d.learned])
    classes = F.array_join(F.array_sort(F.collect_list(F.coalesce("class", F.lit("-")))), ",")
    return sites.groupBy("rel", "key").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("conforming").alias("conforming"), classes.alias("_c")).select("rel", "key", "candidates", "conforming", F.when(learned, F.col("_c")).alias("classes"))


for _family in FAMILIES:
    QUERIES[f"dimensions_{_family}"] = partial(dimension_family, family=_family)
    SQL[f"dimensions_{_family}"] = _pairing() if _family == "pairing" else _expected(FAMILIES[_family])


_PARSED = ("type_only_import", "law_of_demeter")


@query("""WITH n AS (SELECT 'f' || c_custkey || '.ts' AS rel, c_custkey AS k, c_custkey % 7 = 0 AS stripped FROM customer)
SELECT rel, 'type_only_import' AS key, k % 3 = 0 AS conforming FROM n WHERE k % 2 = 0 AND k % 5 <> 0 AND NOT stripped UNION ALL SELECT rel, 'law_of_demeter', k % 4 <= 1 FROM n WHERE k % 3 >= 1""")
def dimensions_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The two dimensions that take a parser and a type checker, over nodes as these would give them: an import specifier and
    a chain of calls for each customer."""
    k = F.col("c_custkey")
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat(F.lit("f"), k.cast("string"), F.lit(".ts")).alias("rel"))
    files = customers.select("rel", F.lit("js").alias("lang"), (k % 7 == 0).alias("stripped"), F.lit("").alias("content"))
    flag = lambda holds: F.when(holds, "1")
    imported = F.create_map(F.lit("as_type"), flag(k % 2 == 0), F.lit("as_value"), flag(k % 5 == 0), F.lit("type_only"), flag(k % 3 == 0))
    chain = F.create_map(F.lit("length"), (k % 3 + 1).cast("string"), F.lit("receiver_types"), (k % 4).cast("string"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("pre"), F.lit("ImportSpecifier").alias("type"), imported.alias("attrs")), F.struct(F.lit(1).alias("pre"), F.lit("CallChain").alias("type"), chain.alias("attrs"))))
    none = lambda kind: F.lit(None).cast(kind)
    made = customers.select("rel", each.alias("n")).select("rel", "n.*")
    nodes = made.select("rel", "pre", F.col("pre").alias("post"), F.lit(0).alias("depth"), "type", none("string").alias("name"), F.array().cast("array<string>").alias("above"), none("int").alias("fn"), none("int").alias("cls"), F.lit(1).alias("line"), "attrs")
    return Engine(spark, tuple(d for d in DIMENSIONS if d.key in _PARSED)).sites(files, nodes).where(F.col("key").isin(*_PARSED)).select("rel", "key", "conforming")


_SAID = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'"
_FACETS_SQL = "(VALUES " + ", ".join(f"({i}, '{f[0]}', {', '.join(map(_SAID, f[3:]))})" for i, f in enumerate(samples.FACETS)) + ") AS f(sample, name, imports, exports, jsx, typed, test_calls, runner, empty, inline_helpers)"


@query(f"SELECT 'src/' || c_custkey || '/' || name AS rel, f.* EXCLUDE (sample, name) FROM customer JOIN {_FACETS_SQL} ON sample = c_custkey % {len(samples.FACETS)}")
def facet_columns(spark: SparkSession, sf: str) -> DataFrame:
    """What files are, from their text: modules and names that they import, what they export, components, types and tests."""
    found = facets.extract(samples.facet_files(spark, sf))
    imports = F.array_join(F.array_sort(F.transform("imports", lambda i: F.concat(i["module"], F.lit("="), F.array_join(i["names"], "+")))), " ")
    return found.select("rel", imports.alias("imports"), F.array_join(F.array_sort("exports"), ",").alias("exports"), "jsx", "typed", "test_calls", "runner", "empty", "inline_helpers")
