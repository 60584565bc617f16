"""A lexical extractor of nodes from JavaScript, TypeScript and Ruby text.

It reads tokens and brackets, not a grammar, so it finds the plainer part of each dimension's sites. A real parser plugs
in with the same schema. A text that cannot be read is rejected and has no nodes; one file never fails a task.
Dimensions whose two sides cannot be told without a grammar or types are UNSEEN and are not offered over these nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import dimensions
from plumbline.sources import ledger

#: Whether a name is used as a type alone takes a grammar, and a receiver's type takes a type checker.
UNSEEN = ("type_only_import", "law_of_demeter")

_JS_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_JS = re.compile(
    r"""(?P<open>[{(\[])|(?P<close>[})\]])
    |(?P<catch>\bcatch\b\s*(?:\(\s*(?P<param>[\w$]+)?[^)]*\))?\s*(?=\{))
    |(?P<try>\btry\b(?=\s*\{))|(?P<throw>\bthrow\b)
    |(?P<export>\bexport\b(?:\s+default\b)?)|(?P<function>(?P<async>\basync\s+)?\bfunction\b\s*\*?\s*(?P<fname>[\w$]+)?)
    |(?P<class>\bclass\s+(?P<cname>[\w$]+)(?:\s+extends\s+(?P<super>[\w$.]+))?)
    |(?P<kindof>\b(?:interface|type|enum)\b)\s+(?P<tname>[A-Z][\w$]*)(?=\s*[<={]|\s+extends)
    |(?P<var>\b(?:const|let|var)\b)\s+(?P<vname>[\w$]+)?(?P<arrow>\s*=\s*(?P<varasync>async\s*)?(?:\([^()]*\)(?P<vreturns>\s*:\s*[^=;{}()]+?)?|[\w$]+)\s*=>)?
    |\bimport\b[^;'"\n]*?(?P<import>S\d+S)
    |(?P<forof>\bfor\s*(?:await\s*)?\(\s*(?:const|let|var)\s+[^;)]*?\bof\b)|(?P<loop>\b(?:for|while|do)\b)
    |\breturn\s+(?P<absent>null|undefined)\b
    |(?P<logic>\?\?|\|\|)\s*(?P<right>[\[{]|S\d+S|\d+|true\b|false\b|null\b)
    |(?:(?P<object>[\w$]+)(?P<chain>\?)?\.)?(?P<call>(?!(?:if|for|while|switch|catch|function|return)\b)[\w$]+)\s*(?=\()
    |(?P<nonnull>(?<=[\w$)\]])!(?=\??\.[\w$(\[]|\[|\())
    |(?P<owner>\b(?:opts|options|params|props|config|input)\b)(?P<maybe>\?)?\.(?P<member>[\w$]+)
    |(?P<any>\?\.)(?=[A-Za-z_$(\[])
    |(?P<word>[A-Za-z_$][\w$]*)""",
    re.X,
)
#: A chain that is written to has no optional form; after these words `!` negates.
_WRITTEN = re.compile(r"!(?:\??\.[\w$]+|\[[^\]]*\]|\([^()]*\))+\s*(?:\+\+|--|(?:[-+*/%&|^]|<<|>>>?|\*\*|\?\?|&&|\|\|)?=(?![=>]))")
_BEFORE_NOT = re.compile(r"\b(?:return|typeof|case|in|of|void|delete|await|yield|else|do)$")
_VALUE = re.compile(r"\{\s*(?:(?P<function>(?:async\b\s*)?(?:\([^()]*\)|[\w$]+)\s*=>|(?:async\s+)?function\b)|(?P<identifier>[A-Za-z_$][\w$]*)\s*\}|(?P<member>[A-Za-z_$][\w$]*(?:\??\.[\w$]+)+)\s*\})")
#: A member and its dot, backwards.
_LINK = re.compile(r"\.\??[\w$]+")
#: A name that is assigned, or counted up or down.
_SET = re.compile(r"(?<![\w$.])(?P<set>[\w$]+)\s*(?:(?:[-+*/%|&^]|\*\*|\?\?|\|\||&&|<<|>>)?=(?![=>])|\+\+|--)|(?:\+\+|--)\s*(?P<count>[\w$]+)\b")
_EMPTY_BLOCK = re.compile(r"\{\s*\}")
_RETURNS = re.compile(r"[^(]*\([^()]*\)\s*:")
_ELEMENT = re.compile(r"(?:[(\[{}>=,?:&|;]|\breturn\b|\bdefault\b|^)\s*(?=<(?:[A-Za-z][\w.:-]*[\s/>]|>))")
_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: Modules of translations, scopes of such modules, and elements that translate.
_I18N_MODULES = ("react-intl", "react-i18next", "i18next", "next-intl", "react-intl-universal")
_I18N_SCOPES = ("@lingui/", "@formatjs/")
_TRANS_ELEMENT = ("FormattedMessage", "FormattedHTMLMessage", "Trans", "Translate")
_TRANS_CALL = re.compile(r"\{\s*(?:[\w$]+\??\.)*(?:t|translate|formatMessage|__|gettext)\s*\(")
#: How a comment begins that speaks to a tool.
_TOOLS = ("/<reference", "eslint-", "@ts-expect-error", "@ts-ignore", "@ts-nocheck", "prettier-ignore", "biome-ignore", "istanbul ignore", "c8 ignore", "v8 ignore", "#region", "#endregion")
_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?P<names>[\w$*{][^;'\"()]*?)\s*\bfrom\s*S(?P<source>\d+)S")
#: Words of a file's name that make it the repository's own module for a concern.
CAPABILITY_WORDS = {concern: set(words) for concern, words in dimensions.CAPABILITY_WORDS.items()}
_CALLBACK = r"(?:before|after|around)_(?:validation|save|create|update|destroy|commit|rollback|initialize|find|touch)"
#: Methods that add a column.
_COLUMNS = ("string", "text", "integer", "bigint", "float", "decimal", "numeric", "datetime", "timestamp", "time", "date", "binary", "boolean", "json", "jsonb", "uuid", "inet", "cidr", "macaddr", "citext", "interval", "money", "hstore", "vector", "daterange", "tsvector", "xml", "column", "primary_key", "enum")
_RB_SKIP = re.compile(r"#[^\n]*|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"")
_RB = re.compile(
    r"""^[ \t]*(?:(?P<class>class)\s+(?P<cname>[A-Z][\w:]*)(?:\s*<\s*(?P<super>[A-Z][\w:]*(?:\[[^\]]*\])?))?|(?P<module>module)\s+(?P<mname>[A-Z][\w:]*)|(?P<def>def)\s+(?P<dname>[\w.?!=\[\]]+)(?:\((?P<dparams>[^)]*)\))?)
    |(?P<rescue>^[ \t]*rescue\b(?:[^\n=]*=>\s*(?P<param>\w+))?)
    |(?P<block>^[ \t]*(?:if|unless|case|while|until|begin|for)\b|\bdo\b(?:\s*\|[^|\n]*\|)?)|(?P<end>\bend\b)
    |(?:(?P<receiver>[A-Za-z_][\w:]*(?:\.(?:zone|logger))?)\.)?(?P<call>\b(?:puts|print|pp|warn|raise|include|find_by!?|find|now|today|new|current|local|parse|at|info|debug|error|get|post|put|patch|delete|head|request|start|execute|create_table|change_table|add_reference|add_belongs_to|add_foreign_key|CALLBACK)\b)(?P<arg>\s+[A-Z][\w:]*)?
    |(?<![\w:.])(?P<model>[A-Z]\w*(?:::[A-Z]\w*)*)\.(?P<sent>[a-z_]\w*[!?]?)
    |\b(?P<block_param>[a-z_]\w*)\.(?P<column>(?:COLUMN|references|belongs_to|foreign_key)\b)
    |(?P<word>\b[a-z_]\w*\b)""".replace("CALLBACK", _CALLBACK).replace("COLUMN", "|".join(_COLUMNS)),
    re.X | re.M,
)


_MIGRATION = re.compile(r"^ActiveRecord::Migration(?:\[|$)")
_DML = re.compile(r"(?:update|insert|delete|truncate|with)\b", re.I)
#: Constants whose calls touch no rows.
_FRAMEWORK = ("ActiveRecord", "ActiveStorage", "ActionText", "ActiveSupport", "Arel", "Rails", "Time", "Date", "DateTime", "SecureRandom", "JSON", "YAML", "File", "Dir", "String", "Integer", "Float", "Numeric", "BigDecimal", "Array", "Hash", "Set", "Symbol", "Range", "Regexp", "Struct", "Math", "Kernel", "Object", "Comparable", "Enumerable", "URI", "Digest", "Base64", "Logger", "Marshal", "Process", "IO", "StringIO", "Pathname", "Tempfile", "OpenStruct", "Random", "Encoding")


class _Nodes:
    def __init__(self, rel: str, text: str):
        self.rel, self.rows = rel, []
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.open: list[tuple[str, int]] = []  # (kind of bracket or keyword, its node or -1)

    def above(self) -> list[int]:
        return [n for _, n in self.open if n >= 0]

    def add(self, type_: str, name: str | None, at: int, /, **attrs: str | None) -> int:
        above = self.above()
        last = lambda *kinds: next((n for n in reversed(above) if self.rows[n]["type"] in kinds), None)
        pre = len(self.rows)
        self.rows.append({"rel": self.rel, "pre": pre, "post": pre, "depth": len(above), "type": type_, "name": name, "above": [self.rows[n]["type"] for n in above], "fn": last("Function", "Def"), "cls": last("Class", "Module"), "line": bisect_left(self.lines, at) + 1, "attrs": [(k, v) for k, v in attrs.items() if v is not None]})
        return pre

    def close(self) -> None:
        if self.open:
            _, node = self.open.pop()
            if node >= 0:
                self.rows[node]["post"] = len(self.rows) - 1

    def done(self) -> list[dict]:
        while self.open:
            self.close()
        return self.rows


def _translates(module: str) -> bool:
    return module in _I18N_MODULES or module.startswith(_I18N_SCOPES)


def _for_a_tool(comment: str) -> bool:
    """Whether a comment's text speaks to a tool rather than to a reader: words apart by one blank, and nothing that goes on
    as a word behind a whole one."""
    said = " ".join(comment[:80].split())
    return any(said.startswith(t) and (t.endswith("-") or not (said[len(t) : len(t) + 1].isalnum() or said[len(t) : len(t) + 1] == "_")) for t in _TOOLS)


def _closing(plain: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; the text's end if none does."""
    depth = 0
    for m in re.compile(r"[{(\[]|[})\]]").finditer(plain, at):
        depth += 1 if m[0] in "{([" else -1
        if not depth:
            return m.end()
    return len(plain)


def _words(path: str) -> list[str]:
    """Words of a file's name up to its first dot."""
    name = path.rsplit("/", 1)[-1]
    dot = name.find(".")
    return [w.lower() for part in re.split("[-_.]", name[:dot] if dot > 0 else name) for w in re.split("(?=[A-Z])", part) if w]


def _imported(plain: str, kept: list[str]) -> list[tuple[str, str]]:
    """(local name, source) of the file's imports."""
    found: list[tuple[str, str]] = []
    for m in _IMPORT.finditer(plain):
        for part in re.split("[{},]", m["names"]):
            if names := re.findall(r"[\w$]+", part):
                found.append((names[-1], kept[int(m["source"])]))
    return found


class _Jsx:
    """(place, type, name, attributes) of a file's JSX attributes, spreads, texts and translations."""

    def __init__(self, plain: str, kept: list[str], i18n: bool):
        self.plain, self.kept, self.found = plain, kept, []
        self.rest = set(re.findall(r"\.\.\.\s*([\w$]+)\s*\}\s*(?:=(?![=>])|(?::[^()=]*)?\)\s*(?::[^(){};=]*)?(?:=>|\{))", plain))
        for names in re.findall(r"\b(?:const|let|var)\s+(\{[^{}]*\}|[\w$]+)\s*=\s*(?:await\s+)?[\w$.]+\(", plain):
            self.rest |= set(re.findall(r"[\w$]+", names))
        self.within(0, len(plain), False)
        i18n = i18n or any(f[1] == "Translation" and f[2] in _TRANS_ELEMENT for f in self.found)
        self.found = [(at, type_, name, attrs | ({"i18n_file": "1"} if i18n and type_ in ("JSXText", "Translation") else {})) for at, type_, name, attrs in self.found]

    def within(self, at: int, end: int, translated: bool) -> None:
        while (m := _ELEMENT.search(self.plain, at, end)):
            n = len(self.found)
            after = self.element(m.end(), end, translated)
            if after < 0:
                del self.found[n:]
            at = after if after > 0 else m.end() + 1

    def element(self, at: int, end: int, translated: bool) -> int:
        """The place after the element at `at`; -1 if what is there has no end."""
        plain, at = self.plain, at + 1
        tag = _NAME.match(plain, at, end)
        name = tag[0] if tag else ""
        last = name.rsplit(".", 1)[-1]
        component = bool(name) and ("." in name or (":" not in name and not name[0].islower()))
        if last in _TRANS_ELEMENT:
            self.found.append((at, "Translation", last, {}))
            translated = True
        at = tag.end() if tag else at
        while True:
            while at < end and plain[at].isspace():
                at += 1
            if at >= end:
                return -1
            if plain.startswith("/>", at):
                return at + 2
            if plain[at] == ">":
                return self.children(at + 1, end, name, translated)
            if plain[at] == "{":
                close = _closing(plain, at)
                if spread := re.compile(r"\{\s*\.\.\.\s*([^{}]*?)\s*\}").fullmatch(plain, at, close):
                    forwarded = "1" if spread[1] in self.rest or re.fullmatch(r"[\w$.?]+\(.*\)", spread[1], re.S) else None
                    self.found.append((at, "JSXSpreadAttribute", None, {"element": "component" if component else "host", "forwarded": forwarded}))
                self.within(at + 1, close, translated)
                at = close
            elif attribute := _NAME.match(plain, at, end):
                start, at = at, attribute.end()
                if plain.startswith("={", at):
                    close = _closing(plain, at + 1)
                    value = _VALUE.match(plain, at + 1, close)
                    kind = value.lastgroup if value and value["identifier"] != "undefined" else None
                    self.found.append((start, "JSXAttribute", attribute[0], {"value": kind, "handler": value["identifier"] if kind == "identifier" else None}))
                    self.within(at + 2, close, translated)
                    at = close
                elif text := re.compile(r"=\s*S\d+S\s*").match(plain, at, end):
                    at = text.end()
            else:
                return -1

    def children(self, at: int, end: int, name: str, translated: bool) -> int:
        plain = self.plain
        while at < end:
            if plain.startswith("</", at):
                close = plain.find(">", at, end)
                return close + 1 if close >= 0 and plain[at + 2 : close].strip() == name else -1
            if plain[at] == "<":
                at = self.element(at, end, translated)
                if at < 0:
                    return -1
            elif plain[at] == "{":
                if not translated and _TRANS_CALL.match(plain, at, end):
                    self.found.append((at, "Translation", None, {}))
                close = _closing(plain, at)
                self.within(at + 1, close, translated)
                at = close
            else:
                until = re.compile(r"[<{]").search(plain, at, end)
                stop = until.start() if until else end
                text = re.sub(r"S(\d+)S", lambda m: self.kept[int(m[1])] if int(m[1]) < len(self.kept) else m[0], plain[at:stop])
                if not translated and re.search(r"[^\W\d_]{2}", re.sub("&[a-zA-Z0-9#]+;", " ", text)):
                    self.found.append((at + len(plain[at:stop]) - len(plain[at:stop].lstrip()), "JSXText", None, {}))
                at = stop
        return -1


def _aside(plain: str, kept: list[str]) -> list[tuple[int, str, str | None, dict[str, str | None]]]:
    """(place, type, name, attributes) of nodes that are read apart from the tokens: JSX, results, the environment."""
    imports = _imported(plain, kept)
    found = _Jsx(plain, kept, any(_translates(kept[int(x)]) for x in re.findall(r"\b(?:import|from)\s*S(\d+)S", plain))).found
    for m in re.finditer(r"\breturn\s*(?:(?P<call>(?:await\s+)?(?:Result\??\.[\w$]+|ok|err|Ok|Err)\s*\()|(?=\{))", plain):
        if m["call"] or {"ok", "error"} & set(_keys(plain, m.end(), kept)):
            found.append((m.start(), "ReturnStatement", None, {"shape": "result"}))
    for m in re.finditer(r"(?<![\w$.])process\.env(?:\??\.(?P<name>[A-Za-z_$][\w$]*)|\??\.?\[)", plain):
        found.append((m.start(), "MemberExpression", m["name"], {"object": "process.env"}))
    for m in re.finditer(r"\b(?:const|let|var)\s*\{(?P<names>[^{}]*)\}\s*(?::[^=]*)?=\s*process\.env\b(?!\s*\??[.\[])", plain):
        found += [(m.start(), "MemberExpression", name.strip(), {"object": "process.env"}) for name in m["names"].split(",") if name.strip()]
    own = {name for name, source in imports if source.startswith(".") and CAPABILITY_WORDS["env"] & set(_words(source))}
    if own:
        for m in re.finditer(rf"(?<![\w$.])(?:{'|'.join(map(re.escape, sorted(own)))})\s*(?:\??\.\s*[\w$]|\??\.?\[)", plain):
            found.append((m.start(), "MemberExpression", None, {"wrapper": "env"}))
    return sorted(found, key=lambda f: f[0])


def _keys(plain: str, at: int, kept: list[str]) -> list[str]:
    """Keys of the object literal at `at`, those of inner ones apart."""
    end, start, keys = _closing(plain, at) - 1, at + 1, []
    while start < end:
        part = re.compile(r"[,{(\[]").search(plain, start, end)
        stop = part.start() if part else end
        if key := re.match(r"\s*(?:S(\d+)S|([A-Za-z_$][\w$]*))\s*(?=$|:|\()", plain[start:stop] if not part or plain[stop] != "(" else plain[start : stop + 1]):
            keys.append(kept[int(key[1])] if key[1] else key[2])
        while part and part[0] != ",":
            part = re.compile(r"[,{(\[]").search(plain, _closing(plain, part.start()), end)
        start = part.end() if part else end
    return keys


def javascript(rel: str, text: str) -> list[dict]:
    kept: list[str] = []
    comments: list[tuple[int, int, bool]] = []  # (start, end, whether for a tool), as places of `plain`
    moved = 0

    def stand_in(m: re.Match) -> str:
        nonlocal moved
        if m[0].startswith(("//", "/*")):
            comments.append((m.start() + moved, m.end() + moved, _for_a_tool(m[0][2:])))
            return re.sub(r"[^\n]", " ", m[0])
        kept.append(m[0][1:-1])
        new = f"S{len(kept) - 1}S" + "\n" * m[0].count("\n")
        moved += len(new) - len(m[0])
        return new

    plain = _JS_SKIP.sub(stand_in, text)
    by_end = {end: (start, tool) for start, end, tool in comments}

    def documented(at: int) -> str | None:
        while True:
            edge = at
            while edge not in by_end and edge > 0 and plain[edge - 1].isspace():
                edge -= 1
            if edge not in by_end:
                return None
            start, tool = by_end[edge]
            if plain[plain.rfind("\n", 0, start) + 1 : start].strip():
                return None
            if not tool:
                return "1"
            at = start

    def root(at: int, end: int) -> str | None:
        """The first name of the chain of members that is called at `at`."""
        while (link := _LINK.match(plain[max(0, at - 1024) : at][::-1])) and link[0]:
            at -= len(link[0])
            if link.end() == 1024:  # a member longer than that goes on before it
                while at and (plain[at - 1].isalnum() or plain[at - 1] in "_$"):
                    at -= 1
        return None if at and plain[at - 1] in ".)]" else re.compile(r"[\w$]+").match(plain, at)[0]

    imports = _imported(plain, kept)
    own = {c: {n for n, source in imports if source.startswith(".") and words & set(_words(source))} for c, words in CAPABILITY_WORDS.items()}
    stem = _words(rel)
    implements = " ".join(c for c, words in CAPABILITY_WORDS.items() if stem and set(stem) <= words) or None
    out, waiting, exported, export_at = _Nodes(rel, plain), -1, None, 0
    aside, bound, handlers = _aside(plain, kept), [], []
    nth = 0
    last_set: dict[str, int] = {}
    for m in _SET.finditer(plain):
        last_set[m["set"] or m["count"]] = m.start("set" if m["set"] else "count")

    def flush(until: int) -> None:
        nonlocal nth
        while nth < len(aside) and aside[nth][0] <= until:
            place, type_, name, attrs = aside[nth]
            handler = attrs.get("handler")
            attrs = {k: v for k, v in attrs.items() if k != "handler"}
            node = out.add(type_, name, place, implements=implements if type_ == "MemberExpression" else None, **attrs)
            if handler:
                handlers.append((node, handler, set(out.above())))
            nth += 1

    for m in _JS.finditer(plain):
        at, one = m.start(), "1"
        flush(at)
        if m["open"]:
            out.open.append((m["open"], waiting if m["open"] == "{" else -1))
            if m["open"] == "{":
                if waiting >= 0 and out.rows[waiting]["type"] == "CatchClause" and _EMPTY_BLOCK.match(plain, at):
                    out.rows[waiting]["attrs"].append(("empty", one))
                waiting = -1
        elif m["close"]:
            out.close()
        elif m["catch"]:
            waiting = out.add("CatchClause", None, at, param=m["param"])
        elif m["try"]:
            waiting = out.add("TryStatement", None, at)
        elif m["throw"]:
            out.add("ThrowStatement", None, at)
        elif m["export"]:
            exported, export_at = one, at
            continue
        elif m["function"]:
            typed = _RETURNS.match(plain, at)
            if m["fname"]:
                bound.append((m["fname"], "function", next((n for n in reversed(out.above()) if out.rows[n]["type"] == "Function"), None)))
            waiting = out.add("Function", m["fname"], at, exported=exported, doc=documented(export_at) if exported else None, form="declaration" if m["fname"] else None, returns=one if typed else None, **{"async": one if m["async"] else None})
        elif m["class"]:
            waiting = out.add("Class", m["cname"], at, exported=exported, doc=documented(export_at) if exported else None, super=m["super"])
        elif m["kindof"]:
            waiting = out.add({"interface": "TSInterfaceDeclaration", "type": "TSTypeAliasDeclaration", "enum": "TSEnumDeclaration"}[m["kindof"]], m["tname"], at, exported=exported)
        elif m["var"]:
            name = m["vname"]
            again = one if name and last_set.get(name, -1) >= m.end("vname") else None
            out.add("VariableDeclaration", name, at, kind=m["var"], exported=exported, reassigned=again)
            memo = re.compile(r"\s*=\s*(?:[\w$]+\.)?useCallback\s*\(").match(plain, m.end())
            if name and (memo or m["arrow"] or re.compile(r"\s*=\s*(?:async\s+)?function\b").match(plain, m.end())):
                bound.append((name, "useCallback" if memo else "function", next((n for n in reversed(out.above()) if out.rows[n]["type"] == "Function"), None)))
            if m["arrow"]:
                waiting = out.add("Function", name, at, form="expression", exported=exported, doc=documented(export_at) if exported else None, returns=one if m["vreturns"] else None, **{"async": one if m["varasync"] else None})
        elif m["import"]:
            out.add("ImportDeclaration", None, at, source=kept[int(m["import"][1:-1])])
        elif m["forof"]:
            out.add("ForOfStatement", None, at)
            out.open.append(("(", -1))
            waiting = out.add("Loop", None, at)
        elif m["loop"]:
            waiting = out.add("Loop", None, at)
        elif m["absent"]:
            out.add("ReturnStatement", None, at, value=m["absent"])
        elif m["logic"]:
            kind = {"[": "array", "{": "object"}.get(m["right"], "literal")
            out.add("LogicalExpression", None, at, op=m["logic"], right=kind)
            if m["right"] in "[{":
                out.open.append((m["right"], -1))
        elif m["call"]:
            first = root(at, m.end())
            wrapper = " ".join(c for c in ("logging", "network") if first in own[c]) or None
            out.add("CallExpression", m["call"], at, object=m["object"], property=m["call"] if m["object"] else None, optional=one if m["chain"] else None, wrapper=wrapper, implements=implements)
        elif m["nonnull"]:
            if not _WRITTEN.match(plain, at) and not _BEFORE_NOT.search(plain, max(0, at - 8), at):
                out.add("TSNonNullExpression", None, at)
        elif m["any"]:
            out.add("MemberExpression", None, at, optional=one)
        elif m["owner"]:
            out.add("MemberExpression", m["member"], at, object=m["owner"], optional=one if m["maybe"] else None)
        elif m["word"] and any(r["type"] == "CatchClause" and ("param", m["word"]) in r["attrs"] for r in (out.rows[n] for n in out.above())):
            out.add("Identifier", m["word"], at)
        exported = None
    flush(len(plain))
    for node, name, above in handlers:
        seen = [how for n, how, scope in bound if n == name and (scope is None or scope in above)]
        if seen:
            out.rows[node]["attrs"].append(("bound_by", seen[-1]))
    return out.done()


def _statement(plain: str, at: int) -> int:
    """The end of the statement at `at`: its line's, or a later line's where a bracket or comma goes on."""
    depth, last = 0, ""
    for i in range(at, len(plain)):
        c = plain[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return i
        elif c == "\n" and depth == 0 and last not in ",\\":
            return i
        elif c == ";" and depth == 0:
            return i
        if not c.isspace():
            last = c
    return len(plain)


def _options(text: str, plain: str, at: int) -> dict[str, str] | None:
    """The written-out options of the call whose arguments begin at `at`; None where they cannot be read."""
    while plain[at : at + 1] in (" ", "("):
        at += 1
    said = plain[at : _statement(plain, at)]
    said = re.sub(r"\s+do\b(?:\s*\|[^|\n]*\|)?\s*$", lambda m: " " * len(m[0]), said)
    while True:  # what inner brackets hold is not this call's
        flat = re.sub(r"[({\[][^(){}\[\]]*[)}\]]", lambda m: "<" + " " * (len(m[0]) - 2) + ">", said)
        if flat == said:
            break
        said = flat
    if "**" in said:
        return None
    found = {m[1] or m[2]: text[at + m.end() : at + m.end() + 200] for m in re.finditer(r"(?:(?<![\w:])([a-z_]\w*):(?!:)|:([a-z_]\w*)\s*=>)\s*", said)}
    last = said.rsplit(",", 1)
    # a variable in the options' place may hold any of them
    return None if len(last) == 2 and re.fullmatch(r"\s*(?:[a-z_]\w*(?:\.\w+)*|[A-Z]\w*)\s*", last[1]) and text[at + len(last[0]) + 1 :].lstrip()[:1] not in "\"'" else found


def _undecided(value: str | None) -> bool:
    return value is not None and not re.match(r"true\b|false\b|nil\b|-?\d|[\"':{\[%]", value)


def _literal(text: str, at: int, n: int = 0) -> str | None:
    """The name that is written as a symbol or string in the n-th place of the arguments at `at`."""
    name = r"(?::(\w+)|[\"']([\w.]+)[\"'])"
    m = re.compile(r"[ \t]*\(?\s*" + (name + r"\s*,\s*" if n else "") + name).match(text, at)
    return (m[3] or m[4] if n else m[1] or m[2]) if m else None


def _sql(text: str, at: int) -> str | None:
    """The first string among the arguments of `execute`; None if none is written there."""
    if here := re.compile(r"[ \t]*\(?\s*<<[~-]?([\"']?)(\w+)\1[^\n]*\n").match(text, at):
        end = re.compile(rf"^[ \t]*{here[2]}\b", re.M).search(text, here.end())
        return text[here.end() : end.start()] if end else None
    said = re.compile(r"[ \t]*\(?\s*(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)')", re.S).match(text, at)
    return (said[1] if said[1] is not None else said[2]) if said else None


def ruby(rel: str, text: str) -> list[dict]:
    plain = _RB_SKIP.sub(lambda m: re.sub(r"[^\n]", " " if m[0].startswith("#") else "s", m[0]), text)
    out = _Nodes(rel, plain)
    rescue, table = -1, None
    tables: list[tuple[int, str, str, str | None]] = []  # (depth of the block, its parameter, call, table)
    framework = frozenset(_FRAMEWORK)
    constants = set(re.findall(r"^[ \t]*([A-Z]\w*)\s*=(?![=~])", plain, re.M))
    keys: list[tuple[int, bool, str | None, str | None, str | None, bool]] = []  # foreign keys declared apart
    references: list[tuple[int, int, bool, str | None, str | None]] = []

    def end_rescue() -> None:
        nonlocal rescue
        if rescue >= 0 and out.open and out.open[-1] == ("rescue", rescue):
            out.rows[rescue]["attrs"] += [("empty", "1")] if len(out.rows) - 1 == rescue else []
            out.close()
        rescue = -1

    def migration() -> int:
        return next((n for n in reversed(out.above()) if out.rows[n]["type"] == "Class" and any(k == "super" and _MIGRATION.match(v) for k, v in out.rows[n]["attrs"])), -1)

    def mark(node: int, *names: str) -> None:
        have = {k for k, _ in out.rows[node]["attrs"]}
        out.rows[node]["attrs"] += [(n, "1") for n in names if n not in have]

    def down() -> bool:
        return any(out.rows[n]["type"] == "Def" and out.rows[n]["name"] == "down" for n in out.above())

    def caught(name: str | None, at: int) -> None:
        if rescue >= 0 and name and ("param", name) in out.rows[rescue]["attrs"]:
            out.add("Identifier", name, at)

    def reference(name: str, at: int, end: int, of: str | None, column: str | None) -> None:
        options = _options(text, plain, end)
        key, poly = (options or {}).get("foreign_key"), (options or {}).get("polymorphic")
        inline = key is not None and not re.match(r"(?:false|nil)\b", key)
        loose = poly is not None and not re.match(r"(?:false|nil)\b", poly) and not (inline and poly.startswith("["))
        node = out.add("Call", name, at, undecidable="1" if options is None or _undecided(key) else None, polymorphic="1" if loose else None, foreign_key="1" if inline else None)
        if not inline:
            references.append((node, migration(), down(), of, column))

    def apart(at: int, from_: str | None, to: str | None) -> None:
        options = _options(text, plain, at)
        column = re.match(r"[:\"'](\w+)", (options or {}).get("column", ""))
        unknown = options is None or (column is None if "column" in options else to is None)
        keys.append((migration(), down(), from_, to, column[1] if column else None, unknown))

    for m in _RB.finditer(plain):
        at = m.start()
        if m["class"] or m["module"]:
            node = out.add("Class" if m["class"] else "Module", m["cname"] or m["mname"], at, super=m["super"])
            out.open.append(("class", node))
        elif m["def"]:
            params = [p.strip() for p in (m["dparams"] or "").split(",") if p.strip()]
            keyword = sum(bool(re.match(r"\w+:", p)) for p in params)
            out.open.append(("def", out.add("Def", m["dname"], at, params=str(len(params)), positional=str(len(params) - keyword))))
        elif m["rescue"]:
            end_rescue()
            rescue = out.add("Rescue", None, at, param=m["param"])
            out.open.append(("rescue", rescue))
        elif m["block"]:
            if table and (given := re.match(r"do\s*\|\s*(\w+)", m["block"])):
                tables.append((len(out.open), given[1], *table))
            table = None
            out.open.append(("block", -1))
        elif m["end"]:
            end_rescue()
            out.close()
            tables = [t for t in tables if t[0] < len(out.open)]
        elif m["call"]:
            name, receiver, within = m["call"], m["receiver"], migration()
            caught(receiver, at)
            if name in ("create_table", "change_table"):
                if within >= 0 and not receiver:
                    table = (name, _literal(text, m.end("call")))
                    if name == "create_table":
                        options = _options(text, plain, m.end("call"))
                        out.add("Call", name, at, undecidable="1" if options is None or table[1] is None else None, id="1" if options and "id" in options else None)
            elif name in ("add_reference", "add_belongs_to"):
                if within >= 0 and not receiver:
                    reference(name, at, m.end("call"), _literal(text, m.end("call")), _literal(text, m.end("call"), 1))
            elif name == "add_foreign_key":
                if within >= 0 and not receiver:
                    apart(m.end("call"), _literal(text, m.end("call")), _literal(text, m.end("call"), 1))
            else:
                rows = bool(within >= 0 and receiver and receiver[0].isupper() and receiver.split("::")[0].split(".")[0] not in framework | constants)
                if within >= 0 and name == "execute":
                    sql = _sql(text, m.end("call"))
                    if not (sql or "").strip():
                        mark(within, "unreadable", "data_work")
                    rows = rows or bool(_DML.match((sql or "").lstrip()))
                node = out.add("Call", name, at, receiver=receiver, argument=(m["arg"] or "").strip() or None, rows="1" if rows else None)
                if name == "include" and out.rows[node]["cls"] is not None and out.rows[node]["fn"] is None:
                    mark(out.rows[node]["cls"], "includes")
                if rows:
                    mark(within, "data_work")
        elif m["model"]:
            within = migration()
            if within >= 0 and m["model"].split("::")[0] not in framework | constants:
                out.add("Call", m["sent"], at, receiver=m["model"], rows="1")
                mark(within, "data_work")
        elif m["column"]:
            block = next((t for t in reversed(tables) if t[1] == m["block_param"]), None)
            caught(m["block_param"], at)
            if block and m["column"] in ("references", "belongs_to"):
                reference(m["column"], at, m.end(), block[3], _literal(text, m.end()))
            elif block and m["column"] == "foreign_key":
                apart(m.end(), block[3], _literal(text, m.end()))
            elif block and block[2] == "create_table":
                options = _options(text, plain, m.end())
                null = (options or {}).get("null")
                # the registry calls the block's parameter `t`, whatever its name
                out.add("Call", m["column"], at, receiver="t", typed="1", undecidable="1" if options is None or _undecided(null) else None, null="false" if null and re.match(r"false\b", null) else None)
        else:
            caught(m["word"], at)
    for node, within, rolled, of, column in references:
        own = [k for k in keys if k[:2] == (within, rolled)]
        names = {column, _plural(column)} if column else set()
        covers = lambda k: k[4] == f"{column}_id" if k[4] is not None else k[3] in names
        if of and column and any(not k[5] and k[2] == of and covers(k) for k in own):
            mark(node, "foreign_key")
        elif any((k[2] is None or of is None or k[2] == of) and (column is None or k[5] or covers(k)) for k in own):
            mark(node, "undecidable")
    return out.done()


def _plural(name: str) -> str:
    return f"{name[:-1]}ies" if re.search("[^aeiou]y$", name) else f"{name}es" if re.search("(s|x|z|ch|sh)$", name) else f"{name}s"


READERS = {"js": javascript, "jsx": javascript, "ruby": ruby}


def read(rel: str, lang: str, text: str, attempt: int = 1) -> tuple[str, list[dict]]:
    """(kind, nodes) of a file; languages that are not read have none."""
    return "ok", READERS[lang](rel, text) if lang in READERS and text else []


def extract(files: DataFrame) -> DataFrame:
    """Nodes of files (rel, lang, content); files of other languages and files that cannot be read have none."""
    keyed = files.select("rel", F.lit("").alias("hash"), "lang", "content", F.lit(1).alias("attempt")).where("content IS NOT NULL")
    return ledger.nodes(ledger.reading(read)(keyed))
