"""The registry of dimensions: what is a site, and what it takes to conform.

A tree dimension is told over nodes of syntax trees (`plumbline.operators.nodes`): `site` and `conforming` are SQL
predicates over a node `n`; with `inner`, the column `held` says whether a node `i` within the site satisfies it. A
learned dimension gives each site a `cls`, and the majority's class is the claim. A corpus dimension reads paths alone,
a pairing dimension asks for a companion file.
"""

from __future__ import annotations

from dataclasses import dataclass

JS, JSX_ONLY, RUBY = ("js", "jsx"), ("jsx",), ("ruby",)
PRECISE, PARTIAL = "precise", "partial"


@dataclass(frozen=True)
class Dimension:
    key: str
    precision: str
    langs: tuple[str, ...]
    kind: str = "tree"
    site: str = ""
    conforming: str = ""
    inner: tuple[tuple[str, str, str], ...] = ()  # what a site may hold: a predicate over `i`, and keys of `n` and `i` that agree, if any
    cls: str = ""
    counter: bool = False
    blind: bool = False  # cannot be seen in a file whose type syntax was stripped
    needs_types: bool = False  # only files with type syntax could show it
    per_file: bool = False  # one site a file
    split: bool = False  # a class is learned from files that hold JSX or from those that do not, whichever are more
    constants: bool = False  # classes are constants, which a scope around a site may shorten
    grouped: str = ""  # sites with the same value are one site
    framework: str = ""
    capability: str = ""
    from_: str = ""  # pairing: directory of the producers
    to: str = ""
    ext: str = ""
    suffix: str = ""

    @property
    def learned(self) -> bool:
        return bool(self.cls)


def _top(node: str = "n") -> str:
    return f"NOT arrays_overlap({node}.above, array('Function', 'Loop', 'TSModuleDeclaration'))"


def _attr(key: str, node: str = "n") -> str:
    return f"{node}.attrs['{key}']"


def _has(key: str, word: str) -> str:
    """Whether an attribute of words between blanks has one; a module may be the wrapper of several concerns."""
    return f"array_contains(split(coalesce({_attr(key)}, ''), ' '), '{word}')"


def _exported(kinds: str) -> str:
    return f"n.type IN ({kinds}) AND {_attr('exported')} = '1'"


_WORD_CLASS = "CASE WHEN n.name RLIKE '^[a-z0-9]+(-[a-z0-9]+)+$' THEN 'kebab-case' WHEN n.name RLIKE '^[a-z0-9]+(_[a-z0-9]+)+$' THEN 'snake_case' WHEN n.name RLIKE '^[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*$' THEN 'camelCase' WHEN n.name RLIKE '^[A-Z][a-zA-Z0-9]*$' THEN 'PascalCase' END"
_PREFIX_CLASS = "coalesce(nullif(regexp_extract(n.name, '^([A-Z])[A-Z][a-z]', 1), ''), 'none')"
_NOT_COMPONENT = f"{_attr('component')} IS NULL"
_MIGRATION = f"n.type = 'Class' AND {_attr('super')} LIKE 'ActiveRecord::Migration%'"
_BODY = "n.type IN ('Class', 'Module')"

#: Names that rows look for.
OPTION_NAMES = "'opts', 'options', 'params', 'props', 'config', 'input'"
REACT_HOOKS = "'useCallback', 'useContext', 'useEffect', 'useId', 'useLayoutEffect', 'useMemo', 'useReducer', 'useRef', 'useState'"
CLOCK_CALLS = "'Time.now', 'Time.new', 'Time.current', 'DateTime.now', 'DateTime.new', 'DateTime.current', 'Date.today', 'Date.current', 'Time.zone.now', 'Time.zone.today', 'Time.zone.local', 'Time.zone.parse', 'Time.zone.at'"
CALLBACKS = "^(before|after|around)_(validation|save|create|update|destroy|commit|rollback|initialize|find|touch)$"

DIMENSIONS = (
    Dimension("swallowed_error", PRECISE, JS, site="n.type = 'CatchClause'", inner=(("i.type = 'ThrowStatement'", "", ""), ("i.type = 'Identifier'", _attr("param"), "i.name")), conforming=f"held AND {_attr('empty')} IS NULL"),
    Dimension("error_shape", PARTIAL, JS, site=f"(n.type = 'ThrowStatement' AND NOT array_contains(n.above, 'CatchClause')) OR (n.type = 'ReturnStatement' AND {_attr('shape')} = 'result')", conforming="n.type = 'ReturnStatement'"),
    Dimension("module_state_const", PRECISE, JS, site=f"n.type = 'VariableDeclaration' AND {_top()} AND {_attr('declare')} IS NULL AND ({_attr('kind')} = 'const' OR {_attr('reassigned')} IS NULL)", conforming=f"{_attr('kind')} = 'const'"),
    Dimension("async_error_handling", PARTIAL, JS, site=f"n.type = 'Function' AND {_attr('async')} = '1'", inner=(("i.type = 'TryStatement'", "string(n.pre)", "string(i.fn)"),), conforming="held"),
    Dimension("optional_chaining", PARTIAL, JS, site=f"n.type = 'MemberExpression' AND {_attr('computed')} IS NULL AND {_attr('object')} IN ({OPTION_NAMES})", conforming=f"{_attr('optional')} = '1'"),
    Dimension("hook_per_module", PARTIAL, JS, site=f"{_exported("'Function', 'VariableDeclaration'")} AND n.name RLIKE '^use[A-Z]'", conforming="names = 1", per_file=True),
    Dimension("function_style", PRECISE, JS, site=f"n.type = 'Function' AND {_top()} AND {_attr('form')} IS NOT NULL", conforming=f"{_attr('form')} = 'declaration'", counter=True),
    Dimension("explicit_return_type", PARTIAL, JS, site=_exported("'Function'"), conforming=f"{_attr('returns')} = '1'", blind=True, needs_types=True),
    Dimension("type_only_import", PARTIAL, JS, site=f"n.type = 'ImportSpecifier' AND {_attr('as_type')} = '1' AND {_attr('as_value')} IS NULL", conforming=f"{_attr('type_only')} = '1'", counter=True, blind=True),
    Dimension("import_extension", PRECISE, JS, site=f"n.type = 'ImportDeclaration' AND {_attr('source')} RLIKE '^[.][.]?/.*[^/]$' AND NOT {_attr('source')} RLIKE '[.](css|scss|less|svg|png|jpg|json)$'", conforming=f"{_attr('source')} RLIKE '[.](cjs|js|jsx|mjs|cts|mts|ts|tsx)$'", counter=True, blind=True),
    Dimension("nullish_default", PRECISE, JS, site=f"n.type = 'LogicalExpression' AND {_attr('right')} IN ('literal', 'array', 'object') AND {_attr('mixed')} IS NULL", conforming=f"{_attr('op')} = '??'"),
    Dimension("non_null_assertion", PARTIAL, JS, site=f"n.type = 'TSNonNullExpression' OR (n.type IN ('MemberExpression', 'CallExpression') AND {_attr('optional')} = '1')", conforming="n.type <> 'TSNonNullExpression'"),
    Dimension("absent_is_null", PARTIAL, JS, site=f"n.type = 'ReturnStatement' AND {_attr('value')} IN ('null', 'undefined') AND {_attr('effect')} IS NULL", conforming=f"{_attr('value')} = 'null'", counter=True),
    Dimension("iterate_with_for_of", PARTIAL, JS, site=f"n.type = 'ForOfStatement' OR (n.type = 'CallExpression' AND {_attr('property')} = 'forEach')", conforming="n.type = 'ForOfStatement'"),
    Dimension("test_call_style", PRECISE, JS, site=f"n.type = 'CallExpression' AND n.name IN ('it', 'test') AND {_attr('object')} IS NULL", conforming="n.name = 'test'", counter=True),
    Dimension("assertion_style", PARTIAL, JS, site=f"n.type = 'CallExpression' AND (n.name IN ('expect', 'assert') OR {_attr('object')} = 'assert')", conforming="n.name = 'expect'", counter=True),
    Dimension("doc_comment_style", PARTIAL, JS, site=f"{_exported("'Function', 'Class'")} AND {_top()}", conforming=f"{_attr('doc')} = '1'", counter=True, blind=True),
    Dimension("hook_call_style", PRECISE, JSX_ONLY, site=f"n.type = 'CallExpression' AND coalesce({_attr('property')}, n.name) IN ({REACT_HOOKS})", conforming=f"{_attr('object')} IS NULL", counter=True),
    Dimension("handler_is_named", PRECISE, JSX_ONLY, site=f"n.type = 'JSXAttribute' AND n.name RLIKE '^on[A-Z]' AND {_attr('value')} IN ('function', 'identifier', 'member')", conforming=f"{_attr('value')} <> 'function'", counter=True),
    Dimension("spread_on_component", PRECISE, JSX_ONLY, site=f"n.type = 'JSXSpreadAttribute' AND ({_attr('element')} = 'component' OR {_attr('forwarded')} IS NULL)", conforming=f"{_attr('element')} = 'component'"),
    Dimension("text_translated", PARTIAL, JSX_ONLY, site=f"n.type IN ('JSXText', 'Translation') AND {_attr('i18n_file')} = '1'", conforming="n.type = 'Translation'"),
    Dimension("handler_memoised", PARTIAL, JSX_ONLY, site=f"n.type = 'JSXAttribute' AND n.name RLIKE '^on[A-Z]' AND {_attr('bound_by')} IS NOT NULL", conforming=f"{_attr('bound_by')} = 'useCallback'", counter=True),
    Dimension("file_naming_case", PRECISE, (*JS, *RUBY), kind="corpus", cls="path", split=True),
    Dimension("function_naming_case", PRECISE, JS, site=f"n.type = 'Function' AND {_top()} AND n.name IS NOT NULL AND {_NOT_COMPONENT} AND NOT n.name RLIKE '^[a-z0-9]+$'", cls=_WORD_CLASS, split=True),
    Dimension("exported_symbol_case", PRECISE, JS, site=f"{_exported("'VariableDeclaration', 'Function'")} AND {_NOT_COMPONENT} AND NOT n.name RLIKE '^[a-z0-9]+$'", cls=_WORD_CLASS, split=True),
    Dimension("exported_class_case", PRECISE, JS, site=_exported("'Class'"), cls=_WORD_CLASS),
    Dimension("exported_type_case", PRECISE, JS, site=_exported("'TSInterfaceDeclaration', 'TSTypeAliasDeclaration', 'TSEnumDeclaration'"), cls=_WORD_CLASS, blind=True),
    Dimension("extends_base", PRECISE, JS, site=f"n.type = 'Class' AND {_attr('super')} IS NOT NULL", cls=_attr("super")),
    Dimension("interface_prefix", PRECISE, JS, site="n.type = 'TSInterfaceDeclaration' AND NOT array_contains(n.above, 'TSModuleDeclaration')", cls=_PREFIX_CLASS, blind=True),
    Dimension("type_alias_prefix", PRECISE, JS, site="n.type = 'TSTypeAliasDeclaration'", cls=_PREFIX_CLASS, blind=True),
    Dimension("migration_reversible", PARTIAL, RUBY, site=f"{_MIGRATION} AND {_attr('data_work')} IS NULL", inner=(("i.type = 'Def' AND i.name IN ('up', 'down')", "", ""),), conforming="NOT held"),
    Dimension("migration_schema_only", PARTIAL, RUBY, site=f"{_MIGRATION} AND {_attr('unreadable')} IS NULL", inner=(("i.type = 'Call' AND i.attrs['rows'] = '1'", "", ""),), conforming="NOT held"),
    Dimension("column_null_declared", PARTIAL, RUBY, site=f"n.type = 'Call' AND {_attr('receiver')} = 't' AND {_attr('typed')} = '1' AND {_attr('undecidable')} IS NULL", conforming=f"{_attr('null')} = 'false'"),
    Dimension("table_primary_key_declared", PARTIAL, RUBY, site=f"n.type = 'Call' AND n.name = 'create_table' AND {_attr('undecidable')} IS NULL", conforming=f"{_attr('id')} IS NOT NULL"),
    Dimension("reference_foreign_key", PARTIAL, RUBY, site=f"n.type = 'Call' AND n.name IN ('add_reference', 'add_belongs_to', 'references', 'belongs_to') AND {_attr('undecidable')} IS NULL AND {_attr('polymorphic')} IS NULL", conforming=f"{_attr('foreign_key')} = '1'"),
    Dimension("rescue_uses_error", PRECISE, RUBY, site="n.type = 'Rescue'", inner=(("i.type = 'Call' AND i.name = 'raise'", "", ""), ("i.type = 'Identifier'", _attr("param"), "i.name")), conforming=f"held AND {_attr('empty')} IS NULL"),
    Dimension("record_lookup", PARTIAL, RUBY, site=f"n.type = 'Call' AND n.name IN ('find', 'find_by', 'find_by!') AND {_attr('receiver')} RLIKE '^[A-Z]' AND {_attr('block')} IS NULL", conforming="n.name = 'find_by'", counter=True, framework="rails"),
    Dimension("model_callbacks", PARTIAL, RUBY, site=f"n.type = 'Class' AND {_attr('super')} IN ('ApplicationRecord', 'ActiveRecord::Base')", inner=((f"i.type = 'Call' AND i.name RLIKE '{CALLBACKS}' AND i.fn IS NULL", "", ""),), conforming="NOT held", counter=True),
    Dimension("service_result_shape", PARTIAL, RUBY, site=f"n.type = 'Def' AND n.name IN ('call', 'perform', 'execute', 'run') AND {_attr('sidekiq')} IS NULL AND arrays_overlap(n.above, array('Class', 'Module'))", inner=(("i.type = 'Call' AND i.name = 'raise' AND i.attrs['receiver'] IS NULL AND NOT array_contains(i.above, 'Rescue') AND coalesce(i.attrs['argument'], '') <> 'ActiveRecord::Rollback'", "", ""),), conforming="NOT held", counter=True),
    Dimension("keyword_params", PRECISE, RUBY, site=f"n.type = 'Def' AND CAST({_attr('params')} AS INT) >= 3 AND n.name NOT IN ('[]=', 'validate_each') AND {_attr('sidekiq')} IS NULL", conforming=f"{_attr('positional')} = '0'"),
    Dimension("zone_aware_time", PRECISE, RUBY, site=f"n.type = 'Call' AND concat({_attr('receiver')}, '.', n.name) IN ({CLOCK_CALLS})", conforming=f"n.name = 'current' OR {_attr('receiver')} = 'Time.zone'", framework="rails"),
    Dimension("logger_over_puts", PARTIAL, RUBY, site=f"n.type = 'Call' AND ((n.name IN ('puts', 'print', 'p', 'pp', 'warn') AND {_attr('receiver')} IS NULL) OR {_attr('receiver')} RLIKE '(^|[.])(logger|Logger)$')", conforming=f"{_attr('receiver')} IS NOT NULL", capability="logging"),
    Dimension("http_through_client", PARTIAL, RUBY, site=f"n.type = 'Call' AND ({_attr('receiver')} RLIKE '^(Net::HTTP|URI$)' OR ({_attr('receiver')} RLIKE '(?i)client$' AND n.name IN ('delete', 'get', 'head', 'patch', 'post', 'put', 'request')))", conforming=f"NOT {_attr('receiver')} RLIKE '^(Net::HTTP|URI$)'", capability="network"),
    Dimension("class_base", PRECISE, RUBY, site=f"n.type = 'Class' AND NOT coalesce({_attr('super')}, '') RLIKE '(Error|Exception)$'", cls=_attr("super"), constants=True),
    Dimension("module_include", PRECISE, RUBY, site=f"(n.type = 'Call' AND n.name = 'include') OR ({_BODY} AND {_attr('includes')} IS NULL)", cls=_attr("argument"), grouped="CASE WHEN n.type = 'Call' THEN n.cls ELSE n.pre END", constants=True),
    Dimension("route_logging", PARTIAL, JS, site=f"n.type = 'CallExpression' AND ({_attr('object')} = 'console' OR {_has('wrapper', 'logging')}) AND NOT {_has('implements', 'logging')}", conforming=_has("wrapper", "logging"), capability="logging"),
    Dimension("route_network", PARTIAL, JS, site=f"n.type = 'CallExpression' AND (n.name = 'fetch' OR 'axios' IN (n.name, {_attr('object')}) OR {_has('wrapper', 'network')}) AND NOT {_has('implements', 'network')}", conforming=_has("wrapper", "network"), capability="network"),
    Dimension("route_env", PARTIAL, JS, site=f"n.type = 'MemberExpression' AND ({_attr('object')} = 'process.env' OR {_has('wrapper', 'env')}) AND NOT {_has('implements', 'env')}", conforming=_has("wrapper", "env"), capability="env"),
    Dimension("law_of_demeter", PARTIAL, JS, site=f"n.type = 'CallChain' AND CAST({_attr('length')} AS INT) >= 2", conforming=f"CAST({_attr('receiver_types')} AS INT) <= 1"),
    *(
        Dimension(f"{what}_{kind}", PRECISE, RUBY, kind="pairing", from_=from_, to=f"{kind}/{to}", ext=ext, suffix=f"_{kind}.rb")
        for what, kind, from_, to, ext in (
            ("rake_task", "spec", "lib/tasks", "lib/tasks", "rake"),
            ("model", "spec", "app/models", "models", "rb"),
            ("service", "spec", "app/services", "services", "rb"),
            ("job", "spec", "app/jobs", "jobs", "rb"),
            ("worker", "spec", "app/workers", "workers", "rb"),
            ("controller", "spec", "app/controllers", "controllers", "rb"),
            ("serializer", "spec", "app/serializers", "serializers", "rb"),
            ("model", "test", "app/models", "models", "rb"),
            ("job", "test", "app/jobs", "jobs", "rb"),
        )
    ),
)


def validate(dimensions: tuple[Dimension, ...] = DIMENSIONS) -> None:
    """Raise ValueError where a row could not be counted or stated."""
    keys = [d.key for d in dimensions]
    for d in dimensions:
        tree = d.kind == "tree"
        if keys.count(d.key) > 1 or d.precision not in (PRECISE, PARTIAL) or not d.langs:
            raise ValueError(f"{d.key}: keys are unique, with a precision and languages")
        if tree and not (d.site and bool(d.conforming) != bool(d.cls)):
            raise ValueError(f"{d.key}: a tree row has sites and either a predicate or classes")
        if d.learned and d.counter:
            raise ValueError(f"{d.key}: a learned row has one side")
        if d.kind == "pairing" and not (d.from_ and d.to and d.suffix):
            raise ValueError(f"{d.key}: a pairing row names where companions are")


validate()
