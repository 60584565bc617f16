"""What a file is, beside its sites: imports and exports, components, types, tests and their runner, helpers of its own.

As the extractor of nodes, this reads text and not a grammar: strings and comments are put aside, and top-level statements
are those that no bracket holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.sources import ledger
from plumbline.sources.lexical import _ELEMENT, _JS_SKIP, _RB_SKIP, javascript

FACETS = "rel string, imports array<struct<module:string,names:array<string>,relative:boolean>>, exports array<string>, jsx boolean, typed boolean, test_calls boolean, runner string, empty boolean, inline_helpers int"
#: Modules that run tests, calls that declare them, and base classes of test cases.
RUNNERS = {"vitest": "vitest", "jest": "jest", "@jest/globals": "jest", "mocha": "mocha", "chai": "chai", "ava": "ava", "tap": "tap", "node:test": "node:test", "cypress": "cypress", "qunit": "qunit", "@playwright/test": "playwright", "playwright": "playwright"}
TEST_CALLS = ("describe", "it", "test", "cy")
RUBY_CALLS = ("describe", "context", "feature", "shared_examples", "it")
TEST_CASES = ("Minitest::Test", "ActiveSupport::TestCase", "ActionDispatch::IntegrationTest", "ActionController::TestCase", "ActiveJob::TestCase", "ActionMailer::TestCase", "ActionView::TestCase", "ActionDispatch::SystemTestCase", "ActionCable::TestCase", "ActionCable::Channel::TestCase", "ActionCable::Connection::TestCase", "ActionMailbox::TestCase")

_IMPORT = re.compile(r"\bimport\s+(?P<type>type\s+)?(?:(?P<names>[\w$*{][^;'\"()]*?)\s*\bfrom\s*)?S(?P<source>\d+)S")
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(?P<names>\{[^{}]*\}|[\w$]+)\s*=\s*require\s*\(\s*S(?P<source>\d+)S\s*\)")
_EXPORT = re.compile(r"\bexport\s+(?:(?P<default>default\b)|(?:async\s+)?(?:const|let|var|function\*?|class|interface|type|enum)\s+(?P<name>[\w$]+)|\{(?P<list>[^{}]*)\})|(?<![\w$.])(?:module\.)?exports\.(?P<cjs>[\w$]+)\s*=(?!=)|\bmodule\.exports\s*=(?!=)\s*(?:\{(?P<object>[^{}]*)\}|(?P<whole>[\w$]+)?)")
_TYPES = re.compile(r"\b(?:interface|enum|namespace)\s+[A-Z]|\btype\s+[A-Z][\w$]*\s*[<=]|[)\w$]\??\s*:\s*(?:string|number|boolean|void|unknown|any|never|[A-Z][\w$.]*)\b|\bas\s+(?:const|[A-Z][\w$]*)\b|\w!\.")
_CLOSED = re.compile(r"<[A-Za-z][\w.]*(?:\s[^<>]*)?/>|</[A-Za-z][\w.]*>|</>")
_TEST = re.compile(rf"(?:^|[;\n{{}}])[ \t]*(?:{'|'.join(TEST_CALLS)})(?:\.\w+)*\s*\(")


def _names(said: str) -> list[str]:
    """Names of an import: `default`, `*`, or as the module calls them."""
    outside, _, inside = said.partition("{")
    whole = ["*" if w.strip().startswith("*") else "default" for w in outside.split(",") if w.strip()]
    return whole + [words[0] for one in inside.rstrip("} \n").split(",") if (words := [w for w in re.findall(r"[\w$]+", one) if w != "type"])]


def _top(plain: str) -> str:
    """The text without what brackets hold."""
    out, depth = [], 0
    for c in plain:
        if c in ")]}":
            depth = max(0, depth - 1)
        if depth == 0 or c == "\n":
            out.append(c)
        if c in "([{":
            depth += 1
    return "".join(out)


def of_javascript(rel: str, text: str) -> dict:
    kept: list[str] = []

    def aside(m: re.Match) -> str:
        if m[0].startswith(("//", "/*")):
            return re.sub(r"[^\n]", " ", m[0])
        kept.append(m[0][1:-1])
        return f"S{len(kept) - 1}S"

    plain = _JS_SKIP.sub(aside, text)
    imports, values = [], []
    for m in sorted((*_IMPORT.finditer(plain), *_REQUIRE.finditer(plain)), key=lambda m: m.start()):
        module, said = kept[int(m["source"])], m["names"] or ""
        required = m.re is _REQUIRE
        names = (re.findall(r"([\w$]+)\s*(?::[^,}]*)?(?=[,}])", said) if said.startswith("{") else ["default"]) if required else _names(said)
        imports.append({"module": module, "names": names, "relative": bool(re.match(r"\.\.?(/|$)", module))})
        if required or not m["type"]:
            values.append(module)
    exports: list[str] = []
    own: set[str] = set()
    for m in _EXPORT.finditer(plain):
        if m["default"]:
            exports.append("default")
        elif m["list"] is not None or m["object"] is not None:
            for one in (m["list"] or m["object"] or "").split(","):
                if words := re.findall(r"[\w$]+", one):
                    exports.append(words[-1] if m["list"] is not None else words[0])
                    own.add(words[0])
        elif name := m["name"] or m["cjs"] or m["whole"]:
            exports.append("default" if m["whole"] else name)
            own.add(name)
    nodes = javascript(rel, text)
    helpers = {n["name"] for n in nodes if n["type"] == "Function" and n["name"] and not n["above"] and dict(n["attrs"]).get("form")}
    exported = own | {n["name"] for n in nodes if dict(n["attrs"]).get("exported")}
    declares = bool(_TEST.search(plain))
    return {
        "imports": imports,
        "exports": exports,
        "jsx": bool(_ELEMENT.search(plain) and _CLOSED.search(plain)),
        "typed": bool(_TYPES.search(plain)),
        "test_calls": bool(_TEST.search(_top(plain))),
        "runner": next((RUNNERS[m] for m in values if m in RUNNERS), None) if declares else None,
        "empty": not plain.strip(),
        "inline_helpers": len(helpers - exported),
    }


def of_ruby(rel: str, text: str) -> dict:
    plain = _RB_SKIP.sub(lambda m: re.sub(r"[^\n]", " " if m[0].startswith("#") else "s", m[0]), text)
    by_path = bool(re.search(r"(^|/)[^/]*_test\.rb$", rel)) or rel.split("/")[0] == "test"
    cased = any(m[1].endswith(TEST_CASES) for m in re.finditer(r"^[ \t]*class\s+[\w:]+\s*<\s*([\w:]+)", plain, re.M))
    named = bool(re.search(r"^[ \t]*class\s+[\w:]*Test\b", plain, re.M))
    in_class = bool(re.search(r"^[ \t]*class\s", plain, re.M))
    calls = {m[1] for m in re.finditer(r"^[ \t]*(?:RSpec\.)?(\w+)[ (][^\n]*\b(?:do|\{)\s*(?:\|[^|\n]*\|)?\s*$", plain, re.M)}
    case = in_class and "test" in calls and (cased or by_path or named)
    method = in_class and bool(re.search(r"^[ \t]*def\s+test_", plain, re.M)) and (cased or by_path)
    spec, beaker = bool(calls & set(RUBY_CALLS)), "test_name" in calls
    minitest = cased or case or method
    return {"imports": [], "exports": [], "jsx": False, "typed": False, "test_calls": bool(case or method or spec or beaker), "runner": "minitest" if minitest else "rspec" if spec else "beaker" if beaker else None, "empty": not plain.strip(), "inline_helpers": 0}


def extract(files: DataFrame) -> DataFrame:
    """FACETS of files (rel, lang, content) of a language that is read; a file that cannot be read has none."""
    names = [x.split(" ")[0] for x in ("rel", "imports", "exports", "jsx", "typed", "test_calls", "runner", "empty", "inline_helpers")]
    kinds = [pa.string(), pa.list_(pa.struct([("module", pa.string()), ("names", pa.list_(pa.string())), ("relative", pa.bool_())])), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.int32()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in ledger.pieces(whole)):
            found: list[dict] = []
            for rel, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = {"js": of_javascript, "jsx": of_javascript, "ruby": of_ruby}.get(lang)
                if read and text is not None:
                    try:
                        found.append(read(rel, text) | {"rel": rel})
                    except (RecursionError, ValueError, IndexError):  # an odd file is unread, the others are not
                        continue
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)], names)

    return ledger.dealt_out(files.select("rel", "lang", "content"), files.count()).mapInArrow(rows, FACETS)
