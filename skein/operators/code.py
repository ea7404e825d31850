"""Code files as tables: chunks, symbols, calls, imports, aliases, supertypes, type references, events and constants.

Python is read by its own `ast`; other languages by a scan of the text in which comments and the insides of strings are
blanked, so that brackets, definitions and calls can be found by pattern. There is no grammar for each language: arrow
functions belong to the symbol that they stand in, and a file that does not parse is one chunk. Edges are then built by joins.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.parsers import exploded_lines
from skein.sources.storage import dealt, written

c = F.col
SCHEMA = "path string, tag string, a string, b string, kind string, start_line int, end_line int, body string"
# Methods that publish and subscribe, and decorators that subscribe.
EMITS = frozenset(("emit", "emitSync", "emit_sync", "publish", "dispatch", "fire", "trigger", "broadcast"))
SUBSCRIBES = frozenset(("on", "once", "addListener", "add_listener", "addEventListener", "subscribe", "listen", "observe"))
PYTHON_DECORATORS = frozenset(("subscribe", "on_event", "on", "event_handler", "listens_to", "event_listener"))
SCRIPT_DECORATORS = frozenset(("OnEvent", "EventPattern", "MessagePattern", "Subscribe"))
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go"}

_STRINGS = {
    "rust": r'//[^\n]*|/\*.*?\*/|b?r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]{1,8}?|[^\'\\\n])\'',
    "javascript": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_VISIBLE = r"(?:\bpub(?:\([^)]*\))?\s+)?"
#: language -> (kind of symbol, pattern of what begins its definition, with the name as a group where it has one)
_DEFINITIONS = {
    "rust": [
        ("Function", _VISIBLE + r"(?:\b(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*\bfn\s+(?P<name>\w+)"),
        ("Type", _VISIBLE + r"\b(?:struct|enum|union)\s+(?P<name>[A-Za-z_]\w*)"),
        ("Trait", _VISIBLE + r"(?:\bunsafe\s+)?\btrait\s+(?P<name>\w+)"),
        ("Type", r"(?:\bunsafe\s+)?(?<![\w>&(,:] )(?<!-> )\bimpl\b(?=\s*[<A-Za-z!])"),
        ("Module", _VISIBLE + r"\bmod\s+(?P<name>\w+)"),
        ("Binding", _VISIBLE + r"\b(?:const|static(?:\s+mut)?)\s+(?P<name>[A-Za-z_]\w*)\s*:"),
    ],
    "javascript": [
        ("Function", r"\b(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)(?=\s*\()"),
        ("Type", r"\bclass\s+(?P<name>[\w$]+)"),
        ("Method", r"(?:^|(?<=[{};\n]))[ \t]*(?:@\w+(?:\([^()]*\))?\s+)*(?P<def>(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^<>()]*>)?\((?:[^()]|\([^()]*\))*\)[^{};=\n]*(?=\{))"),
    ],
    "go": [
        ("Function", r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)"),
        ("Type", r"^type\s+(?P<name>\w+)"),
    ],
}
_DEFINITIONS["typescript"] = [*_DEFINITIONS["javascript"], ("Trait", r"\binterface\s+(?P<name>[\w$]+)")]
_IMPORTS = {
    "rust": r"(?:\bpub(?:\([^)]*\))?\s+)?\b(?:use|extern\s+crate)\s[^;]*;",
    "javascript": r"^import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?",
    "go": r"^import\s*(?:\([^)]*\)|[^\n]+)",
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
_NOT_CALLS = frozenset("if while for match return switch catch function fn let const new await typeof super loop in else yield throw import func go defer select case struct enum impl where move unsafe as mut ref pub use mod type trait class interface static async".split())
_CALL = re.compile(r"(?P<name>[A-Za-z_$][\w$]*(?:\s*(?:::|\?\.|\.)\s*(?:<[^<>()]*>\s*::\s*)?[A-Za-z_$#][\w$]*)*)\s*(?:::\s*<[^()]*?>)?\s*(?P<macro>!?)\s*(?P<open>[(\[{])")

_PARAMETERS = re.compile(r"\s*[<(]")
#: Rows, and characters of text, of a batch that goes back to Spark.
BATCH_ROWS, BATCH_CHARS = 10_000, 8 << 20


def blanked(text: str, language: str) -> str:
    """The text with comments, and what stands inside string literals, as spaces; line ends and places stay."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def one(m: re.Match) -> str:
        s = m.group()
        if s.startswith(("//", "/*")):
            return blank(s)
        a = next(i for i, x in enumerate(s) if x in "\"'`")
        return s[: a + 1] + blank(s[a + 1 : -1]) + s[-1]

    return re.sub(_STRINGS[language], one, text, flags=re.S)


def plain(name: str) -> str:
    """A name without what it is generic over."""
    return name.split("<", 1)[0].strip()


def callee(raw: str) -> str:
    """The last two segments of a called path, joined by `::`; white space, generics and `?.` are no part of them."""
    path = re.sub(r"\s+", "", raw).replace("?.", ".").replace(".", "::")
    return "::".join([s for s in plain(path).split("::") if s][-2:])


def split_outside(text: str, separator: str) -> list[str]:
    """Pieces between separators that stand in no bracket."""
    out, depth, start = [], 0, 0
    for i, x in enumerate(text):
        if x in "{[(<":
            depth += 1
        elif x in "}])>" and depth:
            depth -= 1
        elif x == separator and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def aliases(text: str, language: str) -> list[tuple[str, str]]:
    """(local name, what it stands for) of an import statement."""
    text = text.strip()
    named = lambda piece: (piece.split(" as ", 1) + [piece])[:2] if " as " in piece else [piece, None]
    if language == "rust":
        body = re.sub(r"^pub(\([^)]*\))?\s+", "", text).rstrip(";").strip()
        if m := re.match(r"extern\s+crate\s+(.*)", body, re.S):
            name, local = (x and x.strip() for x in named(m[1].strip()))
            return [(local or name, name)]
        return _use_tree("", re.sub(r"^use\s+", "", body))
    out = []
    if language == "python":
        if m := re.match(r"from\s+(\S+)\s+import\s+(.*)", text, re.S):
            for piece in re.sub(r"[()\\]", " ", m[2]).split(","):
                name, local = (x and x.strip() for x in named(piece.strip()))
                if name and name != "*":
                    out.append((local or name, f"{m[1]}::{name}"))
        elif m := re.match(r"import\s+(.*)", text, re.S):
            for piece in m[1].split(","):
                name, local = (x and x.strip() for x in named(piece.strip()))
                if name:
                    out.append((local or name.split(".")[0], name))
    elif language in ("javascript", "typescript"):
        if m := re.match(r"import\s+(.*)\sfrom\s+['\"`]([^'\"`]+)['\"`]", text.rstrip(";"), re.S):
            for part in map(str.strip, split_outside(m[1], ",")):
                if part.startswith("* as "):
                    out.append((part[5:].strip(), m[2]))
                elif part.startswith("{"):
                    for spec in filter(None, map(str.strip, part.strip("{}").split(","))):
                        name, local = (x and x.strip() for x in named(spec))
                        out.append((local or name, f"{m[2]}::{name}"))
                elif part:
                    out.append((part, f"{m[2]}::default"))
    elif language == "go":
        for lead, target in re.findall(r'^[ \t]*(?:import\b[ \t]*\(?)?[ \t]*([\w.]*)[ \t]*"([^"]+)"', text, re.M):
            if lead not in ("_", "."):
                out.append((lead or target.rsplit("/", 1)[-1], target))
    return out


def _use_tree(prefix: str, tree: str) -> list[tuple[str, str]]:
    tree = tree.strip()
    joined = lambda tail: "::".join(x for x in (prefix, tail) if x)
    if tree.startswith("{") and tree.endswith("}"):
        return [x for piece in split_outside(tree[1:-1], ",") for x in _use_tree(prefix, piece)]
    if "{" in tree:
        head, rest = tree.split("{", 1)
        return _use_tree(joined(head.strip().removesuffix("::")), "{" + rest)
    path, _, local = (x.strip() for x in tree.partition(" as "))
    if not path or path.endswith("*"):
        return []
    if path == "self":
        return [(local or prefix.rsplit("::", 1)[-1], prefix)] if prefix else []
    full = joined(path)
    return [(local or full.rsplit("::", 1)[-1], full)]


@dataclass
class Definition:
    start: int
    end: int
    kind: str
    name: str
    header: str
    fqn: str = ""
    outer: Definition | None = None

    def inside_function(self) -> bool:
        return self.outer is not None and (self.outer.kind == "Function" or self.outer.inside_function())


@dataclass
class Parsed:
    """Rows of one file; lines count from 1."""

    path: str
    text: str
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.ends = [m.start() for m in re.finditer("\n", self.text)]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.ends, at) + 1

    def add(self, tag: str, a: str, b: str | None = None, kind: str | None = None, start: int | None = None, end: int | None = None, body: str | None = None) -> None:
        self.rows.append((self.path, tag, a, b, kind, start, end, body))

    def define(self, d: Definition, body: str, start: int, end: int) -> None:
        if not d.inside_function():
            self.add("chunk", d.fqn, None, d.kind, start, end, body)
            self.add("symbol", d.fqn, None, d.kind, start, end)


def _closing(text: str, at: int) -> int:
    """Place after the bracket that closes the one at `at`; the end where it isn't closed."""
    depth = 0
    for m in re.compile(r"[{}()\[\]]").finditer(text, at):
        depth += 1 if m.group() in "{([" else -1
        if not depth:
            return m.end()
    return len(text)


def _extent(text: str, at: int) -> tuple[int, int]:
    """(end of the header, end of the definition) that begins before `at`: at the `;` or the closing brace of its body."""
    while m := re.compile(r"[;{(\[]").search(text, at):
        if m.group() == ";":
            return m.start(), m.end()
        close = _closing(text, m.start())
        if m.group() == "{":
            return m.start(), close
        at = close
    return len(text), len(text)


def _literal(text: str) -> str | None:
    """What a string literal holds, if it is one and nothing in it is computed."""
    m = re.fullmatch(r"\s*(?:b?r?#*)?([\"'`])(.*)\1#*\s*", text, re.S)
    return None if m is None or "${" in m[2] else m[2]


def _event(out: Parsed, owner: str, method: str, receiver: str, arguments: list[str]) -> None:
    role = "emit" if method in EMITS else "subscribe" if method in SUBSCRIBES else None
    if role is None or not arguments or not arguments[0].strip():
        return
    topic, expression = _literal(arguments[0]), arguments[0].strip()
    if topic is None and not re.fullmatch(r"[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*", expression):
        return
    handler = arguments[1].strip() if len(arguments) > 1 and re.fullmatch(r"\s*[A-Za-z_$][\w$]*\s*", arguments[1]) else None
    # the topic, or the expression that a constant has to give; who owns the call; the bus and the handler as they are named
    out.add("event", owner, topic if topic is not None else expression, role + ("" if topic is not None else "?"), body=f"{receiver or '*'}\n{handler or ''}")


def _parse_python(out: Parsed, module: str) -> None:
    text, lines = out.text, out.text.splitlines()
    tree = ast.parse(text)
    source = lambda n: ast.get_source_segment(text, n) or ""

    def text_topic(node):
        return repr(node.value) if isinstance(node, ast.Constant) and isinstance(node.value, str) else source(node)

    def visit(node: ast.AST, outer: Definition | None) -> None:
        if isinstance(node, ast.Call) and outer is not None:
            name = callee(source(node.func))
            if name:
                out.add("call", outer.fqn, name)
            if isinstance(node.func, ast.Attribute | ast.Name):
                receiver = source(node.func.value).rsplit(".", 1)[-1] if isinstance(node.func, ast.Attribute) else ""
                _event(out, outer.fqn, node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id, receiver, [text_topic(x) for x in node.args])
        if isinstance(node, ast.Import | ast.ImportFrom):
            whole = source(node)
            out.add("import", whole)
            for local, target in aliases(whole, "python"):
                out.add("alias", local, target)
            return
        if isinstance(node, ast.Assign) and (outer is None or outer.kind == "Type") and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    out.add("const", target.id if outer is None else f"{outer.name}.{target.id}", node.value.value)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            d = Definition(0, 0, "Type" if isinstance(node, ast.ClassDef) else "Function", node.name, "", outer=outer)
            d.fqn = f"{_receiver(outer, module)}::{d.name}"
            out.define(d, "\n".join(lines[node.lineno - 1 : node.end_lineno])[node.col_offset :], node.lineno, node.end_lineno)
            for x in getattr(node, "bases", ()):
                out.add("extend", d.fqn, plain(source(x)))
            for x in node.decorator_list:
                visit(x, outer)
                if isinstance(x, ast.Call) and x.args and callee(source(x.func)).rsplit("::", 1)[-1] in PYTHON_DECORATORS:
                    _event(out, d.fqn, "subscribe", "", [text_topic(x.args[0])])
            for x in ast.iter_child_nodes(node):
                if x not in node.decorator_list:
                    visit(x, d)
            return
        for x in ast.iter_child_nodes(node):
            visit(x, outer)

    visit(tree, None)


def _receiver(outer: Definition | None, module: str) -> str:
    """The nearest type around, else the module."""
    while outer is not None and outer.kind != "Type":
        outer = outer.outer
    return module if outer is None else outer.fqn


def _definitions(code: str, language: str, module: str) -> list[Definition]:
    found = []
    for kind, pattern in _DEFINITIONS[language]:
        for m in re.finditer(pattern, code, re.M):
            start = m.start("def") if kind == "Method" else m.start() + len(m.group()) - len(m.group().lstrip())
            name = m.groupdict().get("name")
            if kind == "Method" and name in _NOT_CALLS:
                continue
            header_end, end = _extent(code, m.end() if kind != "Module" else m.end("name"))
            found.append(Definition(start, end, kind, name or "", code[m.end() : header_end]))
    found.sort(key=lambda d: (d.start, -d.end))
    out: list[Definition] = []
    stack: list[Definition] = []
    for d in found:
        while stack and stack[-1].end <= d.start:
            stack.pop()
        d.outer = stack[-1] if stack else None
        if d.kind == "Method":  # only what stands in a class right away is one
            if d.outer is None or d.outer.kind not in ("Type", "Trait"):
                continue
            d.kind = "Function"
        if not d.name:  # an impl block is named after its type
            target = re.split(r"\bwhere\b", _without_generics(d.header))[0]
            d.name = plain(target.split(" for ")[-1].strip()) or "<anon>"
        d.fqn = f"{_receiver(d.outer, module)}::{d.name}"
        stack.append(d)
        out.append(d)
    return out


def _without_generics(header: str) -> str:
    """An impl's header without the parameters that follow the keyword."""
    header = header.strip()
    if not header.startswith("<"):
        return header
    depth = 0
    for i, x in enumerate(header):
        depth += (x == "<") - (x == ">" and header[i - 1] != "-")
        if not depth:
            return header[i + 1 :].strip()
    return header


def _supertypes(d: Definition, language: str, original: str) -> list[str]:
    header = original
    if language == "rust":
        if d.kind == "Type" and " for " in (h := _without_generics(header)):
            return [plain(h.split(" for ")[0].lstrip("!").strip())]
        if d.kind == "Trait" and ":" in (h := re.split(r"\bwhere\b", re.sub(r"^\s*<[^>]*>", "", header))[0]):
            return [p for x in split_outside(h.split(":", 1)[1], "+") if (p := plain(x.strip())) and not p.startswith("'")]
    elif language in ("javascript", "typescript") and d.kind in ("Type", "Trait"):
        return [p for clause in re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|$)", header, re.S) for x in split_outside(clause, ",") if (p := plain(x.strip()))]
    return []


def _parse_braces(out: Parsed, module: str, language: str) -> None:
    text, code = out.text, blanked(out.text, language)
    defined = _definitions(code, language, module)
    starts = [d.start for d in defined]

    def owner(at: int) -> Definition | None:
        k = bisect.bisect_right(starts, at) - 1
        d = defined[k] if k >= 0 else None
        while d is not None and d.end <= at:
            d = d.outer
        return d

    imported = [(m.start(), m.end()) for m in re.finditer(_IMPORTS[language], code, re.M)]
    inside_import = lambda at: (k := bisect.bisect_right(imported, (at, len(code))) - 1) >= 0 and at < imported[k][1]
    heads = {}
    for d in defined:
        header_end = _extent(code, min(d.end, d.start + len(re.match(r".*?(?=[{;(]|$)", code[d.start : d.end], re.S).group())))[0] if d.kind == "Function" else d.start + len(re.match(r"[^{;]*", code[d.start : d.end]).group())
        heads[id(d)] = (d.start, header_end)
        out.define(d, text[d.start : d.end], out.line(d.start), out.line(max(d.start, d.end - 1)))
        tail = text[d.start : header_end]
        word = "impl" if language == "rust" and d.kind == "Type" and "impl" in tail.split("{")[0] else d.name
        cut = _word(tail, word)
        for parent in _supertypes(d, language, tail if cut is None else tail[cut + len(word) :]):
            out.add("extend", d.fqn, parent)
        if language in ("javascript", "typescript"):
            for name, arguments in re.findall(r"@(\w+)\(([^()]*)\)", text[_before(code, d.start) : d.start]):
                if name in SCRIPT_DECORATORS:
                    _event(out, d.fqn, "subscribe", "", [arguments])
    for a, b in imported:
        out.add("import", text[a:b])
        for local, target in aliases(text[a:b], language):
            out.add("alias", local, target)
    # a name before its own parameters is no call
    names = {at for d in defined if (at := _headed(code, d)) is not None}
    for m in _CALL.finditer(code):
        d = owner(m.start())
        name = m.group("name")
        macro = bool(m.group("macro"))
        if d is None or d.kind == "Trait" or inside_import(m.start()) or (m.group("open") != "(" and not macro) or (macro and language != "rust"):
            continue
        first = re.split(r"::|\.", name)[0].strip()
        before = code[max(0, m.start() - 12) : m.start()]
        if (first in _NOT_CALLS and name == first) or re.search(r"(?:\bfn|\bfunction|\bfunc|\bstruct|\benum|\bclass)\s+\*?$|\)\s*$|@$", before) or m.start("name") in names:
            continue
        out.add("call", d.fqn, callee(name).rsplit("::", 1)[-1] if macro else callee(name))
        if not macro:
            parts = [p.strip() for p in re.split(r"::|\?\.|\.", name)]
            close = _closing(code, m.start("open"))
            pieces, at = [], m.end()
            for piece in _split_places(code[m.end() : close - 1]):
                pieces.append(text[at + piece[0] : at + piece[1]])
            _event(out, d.fqn, parts[-1], parts[-2] if len(parts) > 1 else "", pieces)
    if language in ("rust", "typescript"):
        for m in re.finditer(r"(?<![\w:.#@])(?:[a-z_]\w*::)*([A-Z]\w*)\b(?!\s*(?:::|\(|!|\.))", code):
            d = owner(m.start())
            if d is not None and m.group(1) != "Self" and not inside_import(m.start()) and not (d.name == plain(m.group()) and heads[id(d)][0] <= m.start() < heads[id(d)][1]):
                out.add("reference", d.fqn, m.group())
    _constants(out, code, language, owner)


def _in_word(x: str) -> bool:
    return x.isalnum() or x == "_"


def _word(text: str, name: str) -> int | None:
    """Place of the first `name` that stands between ends of words; names differ by file, so there is no pattern to compile for each."""
    edge = lambda i: (i > 0 and _in_word(text[i - 1])) != (i < len(text) and _in_word(text[i]))
    at = text.find(name)
    while at >= 0 and not (edge(at) and edge(at + len(name))):
        at = text.find(name, at + 1)
    return at if at >= 0 else None


def _headed(code: str, d: Definition) -> int | None:
    """Place of the definition's name where parameters follow it."""
    at = code.find(d.name, d.start, d.end)
    while at >= 0 and not ((at == d.start or not (_in_word(code[at - 1]) or code[at - 1] == "$")) and _PARAMETERS.match(code, at + len(d.name), d.end)):
        at = code.find(d.name, at + 1, d.end)
    return at if at >= 0 else None


def _split_places(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for piece in split_outside(text, ","):
        out.append((at, at + len(piece)))
        at += len(piece) + 1
    return out


def _before(code: str, at: int) -> int:
    """Where the statement that ends before `at` ends."""
    return max(code.rfind("}", 0, at), code.rfind(";", 0, at), code.rfind("{", 0, at)) + 1


def _constants(out: Parsed, code: str, language: str, owner) -> None:
    """String constants at the top of a file or in a class: `const A = "x"`, and the fields of a constant object as `A.b`."""
    pattern = {"rust": r"\b(?:const|static)\s+(?P<name>\w+)\s*:[^=;]*=\s*(?=b?r?#*\")", "go": r"\bconst\s+(?P<name>\w+)\s*(?:\w+\s*)?=\s*(?=[\"`])"}.get(language, r"\b(?:const|let|var|readonly|static)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]*)?=\s*(?=[\"'`{]|Object\.freeze)")
    for m in re.finditer(pattern, code):
        d = owner(m.start())
        if d is not None and d.kind == "Function" or d is not None and d.inside_function():
            continue
        at = m.end()
        if code[at] == "{":
            close = _closing(code, at)
            for a, b in _split_places(code[at + 1 : close - 1]):
                piece = out.text[at + 1 + a : at + 1 + b]
                key, _, value = piece.partition(":")
                if (v := _literal(value)) is not None:
                    out.add("const", f"{m['name']}.{key.strip().strip(chr(34)).strip(chr(39))}", v)
            continue
        end = re.compile(r"[;\n]|$").search(code, at).start()
        if (v := _literal(out.text[at:end])) is not None:
            out.add("const", m["name"], v)


def parsed_file(path: str, text: str, module: str | None = None) -> list[tuple]:
    """Rows of SCHEMA for a file: tag is chunk, symbol, call, import, alias, extend, reference, event or const."""
    name = path.rsplit("/", 1)[-1]
    language = LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    if language is None:
        return []
    out = Parsed(path, text)
    module = module if module is not None else name.rsplit(".", 1)[0]
    try:
        if language == "python":
            _parse_python(out, module)
        else:
            _parse_braces(out, module, language)
    except (SyntaxError, RecursionError, ValueError):
        out.rows.clear()
    if not any(r[1] == "chunk" for r in out.rows):
        out.add("chunk", "", None, None, 1, max(1, len(text.splitlines())), text)
    return out.rows


def parse_code(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of `files` (path, content, and module where it isn't the file's stem). Null content counts as empty, files of
    other languages give no rows, an empty table gives none."""
    module = c("module") if "module" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], names=names)
        for batch in batches:
            rows, size = [], 0
            for path, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                new = parsed_file(path, text or "", own) if path else []
                rows += new
                size += sum(len(r[7] or "") for r in new)
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return dealt(files.select("path", "content", module.alias("module")), "path").mapInArrow(run, SCHEMA)


def with_modules(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """`files` with `module`: the package of the nearest manifest (dir, package) above and the path below it, `src` at its start and
    `lib` and `mod` at its end left out; the file's stem where no manifest is above or the file isn't Rust."""
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split(c("path"), "/"), F.lit(1), i), "/")))
    near = files.select("path", above.alias("dir")).join(manifests, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "package"), F.length("dir")).alias("near"))
    parts = F.split(F.when(c("near.dir") == "", c("path")).otherwise(F.expr("substring(path, length(near.dir) + 2)")), "/")
    parts = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    inner = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.when(stem.isin("lib", "mod"), F.array().cast("array<string>")).otherwise(F.array(stem)))
    package = F.replace(c("near.package"), F.lit("-"), F.lit("_"))
    qualified = F.when(F.size(inner) == 0, package).otherwise(F.concat(package, F.lit("::"), F.array_join(inner, "::")))
    return files.join(near, "path", "left").withColumn("module", F.when(c("near").isNotNull() & c("path").endswith(".rs"), qualified).otherwise(stem)).drop("near")


def resolutions(rows: DataFrame) -> DataFrame:
    """(path, name, fqn): what a bare name stands for in a file: a symbol of its own, else what it was imported as."""
    leaf = F.element_at(F.split("a", "::"), -1)
    own = rows.filter("tag = 'symbol'").select("path", leaf.alias("name"), c("a").alias("fqn"), F.lit(0).alias("order"))
    imported = rows.filter("tag = 'alias'").select("path", c("a").alias("name"), c("b").alias("fqn"), F.lit(1).alias("order"))
    return own.unionByName(imported).groupBy("path", "name").agg(F.min_by("fqn", F.struct("order", "fqn")).alias("fqn"))


def _resolved(named: DataFrame, known: DataFrame, name: str) -> DataFrame:
    return named.join(known.select("path", c("name").alias(name), c("fqn").alias("found")), ["path", name], "left")


def code_edges(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): calls, imports, extends, references, emits and subscribes among the symbols of parse_code()'s rows.

    A called name is the symbol or import of that name in its file; else, `Type::method` of a type of the file is that type's; else it
    stays as it is written. Topics that are named by a constant get its value, and are left out where there is none. `files` (path,
    module) names the modules that import, by default the files' stems. `rows` are written once, for each kind of edge reads them.
    """
    rows = written(rows.filter("tag <> 'chunk'").drop("start_line", "end_line"), "parsed")
    known = resolutions(rows)
    types = rows.filter("tag = 'symbol' AND kind = 'Type'").select("path", F.element_at(F.split("a", "::"), -1).alias("head"), c("a").alias("head_fqn")).groupBy("path", "head").agg(F.min("head_fqn").alias("head_fqn"))
    calls = _resolved(rows.filter("tag = 'call'").select("path", "a", "b"), known, "b")
    calls = calls.withColumn("head", F.regexp_extract("b", "^(.*)::[^:]*$", 1)).join(types, ["path", "head"], "left")
    called = F.coalesce("found", F.when(c("head_fqn").isNotNull(), F.concat("head_fqn", F.lit("::"), F.element_at(F.split("b", "::"), -1))), "b")
    out = calls.select(c("a").alias("src"), called.alias("dst"), F.lit("calls").alias("kind"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    modules = rows.select("path").distinct().withColumn("module", stem) if files is None else files.select("path", "module").distinct()
    named = rows.filter("tag = 'alias'").select("path", c("b").alias("dst"))
    whole = rows.filter("tag = 'import'").select("path", F.trim("a").alias("dst")).join(named.select("path").distinct(), "path", "left_anti")
    imports = named.unionByName(whole).join(modules, "path").select(c("module").alias("src"), "dst", F.lit("imports").alias("kind"))
    of = lambda tag, kind: _resolved(rows.filter(c("tag") == tag).select("path", "a", "b"), known, "b").select(c("a").alias("src"), F.coalesce("found", "b").alias("dst"), F.lit(kind).alias("kind"))
    references = of("reference", "references").filter("src <> dst")
    events = rows.filter("tag = 'event'").select("path", c("a").alias("owner"), c("b").alias("topic"), F.rtrim(F.replace("kind", F.lit("?"), F.lit(""))).alias("role"), c("kind").endswith("?").alias("folded"), F.split("body", "\n").alias("who"))
    consts = rows.filter("tag = 'const'").groupBy("path", c("a").alias("topic")).agg(F.max("b").alias("value"))
    events = events.join(consts, ["path", "topic"], "left").withColumn("topic", F.when(c("folded"), c("value")).otherwise(c("topic"))).filter("topic <> ''")
    events = events.withColumn("name", F.get("who", F.lit(1))).join(known.withColumnRenamed("fqn", "handler"), ["path", "name"], "left")
    node = F.concat(F.lit("event::"), F.get("who", F.lit(0)), F.lit("::"), "topic")
    emits = events.filter("role = 'emit'").select(c("owner").alias("src"), node.alias("dst"), F.lit("emits").alias("kind"))
    heard = events.filter("role = 'subscribe'").select(node.alias("src"), F.coalesce("handler", F.nullif("name", F.lit("")), "owner").alias("dst"), F.lit("subscribes").alias("kind"))
    return out.unionByName(imports).unionByName(of("extend", "extends")).unionByName(references).unionByName(emits).unionByName(heard).filter("dst <> ''").distinct()


def body_statements(chunks: DataFrame) -> DataFrame:
    """(fn, line, text) of the statements of functions (fn, path, start_line, body), a line each: without the line of the signature, unless the
    body stands on it, blank lines, comments, docstrings of one line and lines of brackets alone."""
    lines = exploded_lines(chunks, ["fn", "path", "start_line"], "body").select("fn", "path", (c("start_line") + c("line") - 1).alias("line"), "start_line", c("body").alias("text"))
    python = c("path").rlike(r"\.pyi?$")
    first = c("line") == c("start_line")
    inside = F.when(python, F.regexp_extract("text", r"^.*?\)\s*(?:->[^:]*)?:\s*(.*)$", 1)).otherwise(F.regexp_extract("text", r"^[^{]*\{(.*)$", 1))
    text = F.when(first, inside).otherwise(c("text"))
    skipped = r"^\s*(?:[\]\[{}();,]*|//.*|#.*|/\*.*\*/|\"\"\".*\"\"\"|\'\'\'.*\'\'\')\s*$"
    return lines.withColumn("text", text).filter(~F.rlike("text", F.lit(skipped))).select("fn", "line", "text")


def call_bridges(statements: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst): from a statement (fn, line, text) of a function to what the function calls (fn, callee), where the text has the callee's last name."""
    leaf = F.element_at(F.split("callee", "::"), -1)
    both = statements.join(calls.select("fn", "callee").distinct(), "fn").filter(c("text").contains(leaf))
    return both.select(F.concat("fn", F.lit("#s"), "line").alias("src"), c("callee").alias("dst")).distinct()


def docstring(path: str, body: str | None) -> str | None:
    """The comment that documents a piece of code: what stands before it, or in Python right in it, without its marks."""
    lines = (body or "").splitlines()
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if not lines:
        return None
    if ext == "rs":
        out = _comment_run(lines, ("///", "//!"), lambda t: not t or t.startswith("#["))
    elif ext in ("py", "pyi"):
        out = _python_doc(lines)
    elif ext in ("js", "jsx", "mjs", "cjs", "ts", "tsx", "java", "c", "cpp", "cc", "h", "hpp"):
        out = _block_comment(body) if lines[0].lstrip().startswith("/**") else _comment_run(lines, ("///", "//"), lambda t: False)
    elif ext == "go":
        out = _comment_run(lines, ("//",), lambda t: not t)
    else:
        return None
    return out.rstrip("\n") if out and out.strip() else None


def _comment_run(lines: list[str], marks: tuple[str, ...], skipped) -> str | None:
    """The first run of comment lines; lines that may stand before it are skipped, any other ends the search."""
    out: list[str] = []
    for line in lines:
        t = line.lstrip()
        mark = next((m for m in marks if t.startswith(m)), None)
        if mark:
            out.append(t[len(mark) :].lstrip())
        elif out or not skipped(t):
            break
    return "\n".join(out) if out else None


def _python_doc(lines: list[str]) -> str | None:
    rest = [line for line in lines]
    while rest and (not (t := rest[0].lstrip()) or t.startswith(("#", "@", "def ", "class "))):
        rest = rest[1:]
    if not rest or (quote := rest[0].strip()[:3]) not in ('"""', "'''"):
        return None
    first = rest[0].strip()
    if len(first) > 6 and first.endswith(quote):
        return first[3:-3].strip()
    if first != quote:
        return None
    for k, line in enumerate(rest[1:], 1):
        if line.rstrip().endswith(quote):
            last = line.rstrip()[:-3]
            return "\n".join([*rest[1:k], *([last] if last else [])]).rstrip()
    return None


def _block_comment(body: str) -> str | None:
    m = re.match(r"\s*/\*\*(.*?)\*/", body, re.S)
    if m is None:
        return None
    return "\n".join(re.sub(r"^\s*\*? ?" if re.match(r"\s*\*", line) else r"^\s*", "", line.rstrip("\r")) for line in m[1].split("\n")).rstrip()


def docstrings(chunks: DataFrame) -> DataFrame:
    """(path, start_line, doc) of chunks (path, start_line, body) that have a documenting comment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [docstring(p or "", b) for p, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(docs, pa.string())], names=["path", "start_line", "doc"])

    return dealt(chunks.select("path", "start_line", "body"), "path", "start_line").mapInArrow(run, "path string, start_line int, doc string").filter("doc IS NOT NULL")
