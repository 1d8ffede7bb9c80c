"""Symbols and references of source texts: one row per find, as a table function over (path, language, content).

Python is read by its own parser. The other languages are read by patterns over text from which
strings and comments are blanked (positions stay), with brace matching for where a body ends: a
documented subset of what a full parser would see. Markup and schema languages are patterns by nature.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "path string, what string, name string, qualified_name string, kind string, signature string, line_start long, line_end long, docstring string, visibility string, is_exported int, parent string, default_value string, source_name string, target_name string, import_path string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def symbol(name, kind, start, end=None, *, qualified=None, signature=None, doc=None, visibility="public", exported=True, parent=None, default=None) -> dict:
    return {"what": "symbol", "name": name, "qualified_name": qualified or name, "kind": kind, "signature": signature, "line_start": start, "line_end": end or start, "docstring": doc, "visibility": visibility, "is_exported": int(exported), "parent": parent, "default_value": default}


def reference(target, kind, line, source=None, import_path=None) -> dict:
    return {"what": "reference", "target_name": target, "kind": kind, "line_start": line, "source_name": source, "import_path": import_path}


# Python


class _Python(ast.NodeVisitor):
    def __init__(self, source: str):
        self.lines, self.out, self.scope = source.split("\n"), [], []
        self.exports: set | None = None

    def _qual(self, name: str) -> str:
        return ".".join([*self.scope, name])

    def _source(self) -> str | None:
        return ".".join(self.scope) or None

    @staticmethod
    def _access(name: str) -> str:
        return "private" if name.startswith("_") and not name.endswith("__") else "public"

    def _add(self, node, name, kind, **more):
        access = self._access(name)
        out = access == "public" if self.exports is None or self.scope else name in self.exports
        sig = self.lines[node.lineno - 1].strip()
        deco = " ".join("@" + ast.unparse(d) for d in getattr(node, "decorator_list", []))
        self.out.append(symbol(name, kind, node.lineno, node.end_lineno, qualified=self._qual(name), signature=f"{deco} {sig}".strip(), visibility=access, exported=out, parent=self._source(), **more))

    def visit_Module(self, node):
        for s in node.body:
            if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets) and isinstance(s.value, (ast.List, ast.Tuple)):
                self.exports = {e.value for e in s.value.elts if isinstance(e, ast.Constant)}
        self.generic_visit(node)

    def visit_ClassDef(self, node):
        self._add(node, node.name, "class", doc=ast.get_docstring(node))
        for b in node.bases:
            self.out.append(reference(ast.unparse(b).split(".")[-1], "inherits", node.lineno, self._qual(node.name)))
        self._inside(node)

    def _function(self, node):
        in_class = bool(self.scope) and self.scope[-1][:1].isupper()
        self._add(node, node.name, "method" if in_class else "function", doc=ast.get_docstring(node))
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            self._type(a.annotation, self._qual(node.name))
        self._type(node.returns, self._qual(node.name))
        self._inside(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _inside(self, node):
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(node.name)
        for s in node.body:
            self.visit(s)
        self.scope.pop()

    def _type(self, note, source):
        if isinstance(note, ast.Constant) and isinstance(note.value, str):
            try:
                note = ast.parse(note.value, mode="eval").body
            except SyntaxError:
                return
        for n in ast.walk(note) if note is not None else ():
            if isinstance(n, ast.Name) and n.id[:1].isupper():
                self.out.append(reference(n.id, "type_ref", getattr(n, "lineno", 1), source))

    def _assign(self, node, targets, value):
        for t in targets:
            if isinstance(t, ast.Name) and (not self.scope or self.scope[-1][:1].isupper()):
                kind = "property" if self.scope else "constant" if t.id.isupper() else "variable"
                self._add(node, t.id, kind, default=ast.unparse(value)[:80] if value is not None else None)
            elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and self.scope[-1:] == ["__init__"]:
                keep, self.scope = self.scope, self.scope[:-1]
                self._add(node, t.attr, "property")
                self.scope = keep
        if value is not None:
            self.visit(value)

    def visit_Assign(self, node):
        self._assign(node, node.targets, node.value)

    def visit_AnnAssign(self, node):
        self._type(node.annotation, self._source())
        self._assign(node, [node.target], node.value)

    def visit_Import(self, node):
        for a in node.names:
            self.out.append(reference(a.name.split(".")[-1], "import", node.lineno, self._source(), a.name))

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.out.append(reference(a.name, "import", node.lineno, self._source(), "." * node.level + (node.module or "")))

    def visit_ExceptHandler(self, node):
        self._type(node.type, self._source())
        self.generic_visit(node)

    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self.out.append(reference(name, "call", node.lineno, self._source()))
        self.generic_visit(node)


def python(source: str, path: str) -> list[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    v = _Python(source)
    v.visit(tree)
    return v.out


# languages with braces

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_KEYWORDS = set("if for while switch return catch function new typeof await sizeof else do match fn func def class struct enum interface import use super this self throw case in when unless defer yield delete void let const var and or not assert".split())


def blank(source: str) -> str:
    """Strings and comments as spaces; lines and columns stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> int:
        return bisect_right(self.starts, at)


def _end(text: str, at: int) -> int:
    """The end of the body that begins at the first brace after at, before a semicolon; else of the line."""
    m = re.compile(r"[{;]").search(text, at)
    if not m or m[0] == ";":
        n = text.find("\n", at)
        return len(text) if n < 0 else n
    depth = 0
    for b in re.compile(r"[{}]").finditer(text, m.start()):
        depth += 1 if b[0] == "{" else -1
        if not depth:
            return b.end()
    return len(text)


def braces(patterns: list[tuple[str, str]], imports: list[str], exported: Callable[[str, str], bool], inherits: list[tuple[str, str]] = (), nested: list[tuple[str, str]] = (), separator: str = ".") -> Callable[[str, str], list[dict]]:
    """An extractor from patterns with a group n(ame); nested ones count only inside of a class-like body."""
    rules = [(re.compile(p, re.M), k) for p, k in patterns]
    inner = [(re.compile(p, re.M), k) for p, k in nested]
    imported = [re.compile(p, re.M) for p in imports]
    parents = [(re.compile(p, re.M), k) for p, k in inherits]
    call = re.compile(r"(?<![\w.])(new\s+)?((?:[A-Za-z_$][\w$]*(?:\.|::|->))*)([A-Za-z_$][\w$]*)(!?)\s*\(")

    def run(source: str, path: str) -> list[dict]:
        text, out, spans = blank(source), [], []
        at = _Lines(text)

        def owner(pos: int, body: bool = True):
            best = None
            for a, b, s in spans:
                if a < pos < b and (best is None or a > best[0]):
                    best = (a, s)
            return best[1] if best else None

        for group, is_inner in ((rules, False), (inner, True)):
            for rule, kind in group:
                for m in rule.finditer(text):
                    name = m["n"]
                    if not name or name in _KEYWORDS:
                        continue
                    up = owner(m.start("n"))
                    if is_inner and (up is None or up["kind"] not in ("class", "struct", "interface", "enum", "trait", "module")):
                        continue
                    if any(s["name"] == name and s["line_start"] == at(m.start("n")) for _, _, s in spans):
                        continue
                    end = _end(text, m.end() - 1 if text[m.end() - 1 : m.end()] in "{;" else m.end())
                    line = source[text.rfind("\n", 0, m.start("n")) + 1 : (source.find("\n", m.start("n")) + 1 or len(source) + 1) - 1].strip()
                    kept = "method" if kind == "function" and up is not None and up["kind"] in ("class", "struct", "interface", "trait", "module") and up["kind"] != "module" else kind
                    access = next((w for w in ("private", "protected") if re.search(rf"\b{w}\b", line)), "public")
                    s = symbol(name, kept, at(m.start("n")), at(end), qualified=f"{up['qualified_name']}{separator}{name}" if up else name, signature=line.split("{")[0].strip(), visibility=access, exported=exported(name, line), parent=up["qualified_name"] if up else None)
                    spans.append((m.start("n"), end, s))
                    out.append(s)
        for rule in imported:
            for m in rule.finditer(source):
                path_ = next(g for g in m.groups()[::-1] if g)
                names = [x for x in re.split(r"[\s,{}*]+", m.groupdict().get("names") or "") if x and x not in ("as", "type", "default")]
                for n in names or [re.split(r"[/.:\\]+", path_.rstrip("/*;"))[-1]]:
                    out.append(reference(n, "import", at(m.start()), None, path_))
        for rule, kind in parents:
            for m in rule.finditer(text):
                for n in re.split(r"\s*,\s*", m["p"].strip()):
                    n = re.split(r"[<\s({]", n.strip())[0].split(".")[-1].split("::")[-1]
                    if n and n not in _KEYWORDS:
                        out.append(reference(n, kind, at(m.start("p")), m["n"]))
        declared = {(s["name"], s["line_start"]) for _, _, s in spans}
        for m in call.finditer(text):
            line = at(m.start(3))
            if m[3] not in _KEYWORDS and (m[3], line) not in declared:
                up = owner(m.start(3))
                out.append(reference(m[3], "call", line, up["qualified_name"] if up else None))
        return out

    return run


_JS_IMPORT = [r"""^\s*import\s+(?P<names>[\w*{}\s,$]+?)\s+from\s+['"]([^'"]+)['"]""", r"""^\s*import\s+['"]([^'"]+)['"]""", r"""(?:const|let|var)\s+(?P<names>[\w{}\s,$]+?)\s*=\s*require\(\s*['"]([^'"]+)['"]"""]
_JS = [
    (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)", "class"), (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)", "function"),
    (r"^(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>", "function"), (r"^(?:export\s+)?const\s+(?P<n>[A-Z][A-Z0-9_]*)\s*=", "constant"),
    (r"^(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=", "variable"), (r"^\s*(?:module\.)?exports\.(?P<n>[\w$]+)\s*=", "variable"), (r"^\s*[\w$]+\.prototype\.(?P<n>[\w$]+)\s*=", "method"),
]
_JS_IN = [(r"^[ \t]+(?P<n>constructor)\s*\(", "constructor"), (r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*\*?(?P<n>[\w$#]+)\s*(?:<[^>\n]*>)?\([^;{}\n]*\)\s*(?::[^{;\n]+)?\{", "method")]
_TS = [*_JS, (r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<n>\w+)", "interface"), (r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>\w+)\s*(?:<[^=]*>)?\s*=", "type_alias"), (r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>\w+)", "enum")]
_CLASS_OF = [(r"\b(?:class|interface)\s+(?P<n>\w+)[^{;\n]*?\bextends\s+(?P<p>[\w$.<>, ]+?)(?=\s+implements\b|\s*\{)", "inherits"), (r"\bclass\s+(?P<n>\w+)[^{;\n]*?\bimplements\s+(?P<p>[\w$.<>, ]+?)\s*(?=\{)", "implements")]
_JAVA = [(r"\b(?:class|record)\s+(?P<n>[A-Z]\w*)", "class"), (r"(?<!@)\binterface\s+(?P<n>\w+)", "interface"), (r"@interface\s+(?P<n>\w+)", "interface"), (r"\benum\s+(?P<n>\w+)", "enum"), (r"^\s*package\s+(?P<n>[\w.]+)", "module")]
_JAVA_IN = [(r"^[ \t]+(?:(?:public|private|protected)\s+)?(?P<n>[A-Z]\w*)\s*\([^;{)]*\)\s*(?:throws[^{]+)?\{", "constructor"), (r"^[ \t]+(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|virtual|override|global|testMethod)\s+)*[\w<>\[\],.? ]+\s+(?P<n>[a-z]\w*)\s*\([^;{]*\)\s*(?:throws[^{;]+)?[{;]", "method"), (r"^[ \t]+(?:(?:public|private|protected)\s+)?static\s+final\s+[\w<>\[\]]+\s+(?P<n>[A-Z][A-Z0-9_]*)\s*=", "constant"), (r"^[ \t]+(?:(?:public|private|protected|static|final|transient|volatile)\s+)+[\w<>\[\],.]+\s+(?P<n>[a-z]\w*)\s*[=;]", "field")]
_GO = [(r"^func\s+(?P<n>\w+)\s*[\[(]", "function"), (r"^func\s+\([^)]*\)\s+(?P<n>\w+)\s*\(", "method"), (r"^type\s+(?P<n>\w+)\s+struct\b", "struct"), (r"^type\s+(?P<n>\w+)\s+interface\b", "interface"), (r"^type\s+(?P<n>\w+)\s+(?!struct\b|interface\b)\S", "type_alias"), (r"^package\s+(?P<n>\w+)", "module"), (r"^const\s+(?P<n>\w+)", "constant"), (r"^var\s+(?P<n>\w+)", "variable")]
_RUST = [(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<n>\w+)", "function"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)", "struct"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)", "enum"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)", "trait"), (r"^[ \t]*(?:pub\s+)?mod\s+(?P<n>\w+)", "module"), (r"^[ \t]*(?:pub\s+)?type\s+(?P<n>\w+)", "type_alias"), (r"^[ \t]*(?:pub\s+)?const\s+(?P<n>[A-Z]\w*)", "constant"), (r"^[ \t]*(?:pub\s+)?static\s+(?:mut\s+)?(?P<n>\w+)", "variable"), (r"^[ \t]*macro_rules!\s*(?P<n>\w+)", "function")]
_C = [(r"^(?!\s|typedef|return|else|#)[\w*&<>:, ]+?[\s*&](?P<n>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{", "function"), (r"\b(?:struct|union)\s+(?P<n>\w+)\s*(?::[^{;]+)?\{", "struct"), (r"\bclass\s+(?P<n>\w+)[^;{]*\{", "class"), (r"\benum\s+(?:class\s+)?(?P<n>\w+)\s*(?::[^{]+)?\{", "enum"), (r"^typedef\b[^;{]*?\b(?P<n>\w+)\s*;", "type_alias"), (r"^}\s*(?P<n>\w+)\s*;", "type_alias"), (r"^#define\s+(?P<n>\w+)", "constant"), (r"^\s*namespace\s+(?P<n>\w+)", "module")]
_GENERIC = [(r"^[ \t]*(?:\w+\s+)*(?:class|object)\s+(?P<n>\w+)", "class"), (r"^[ \t]*(?:\w+\s+)*(?:interface|protocol)\s+(?P<n>\w+)", "interface"), (r"^[ \t]*(?:\w+\s+)*(?:module|namespace)\s+(?P<n>[\w.]+)", "module"), (r"^[ \t]*(?:\w+\s+)*enum\s+(?P<n>\w+)", "enum"), (r"^[ \t]*(?:\w+\s+)*(?:function|def|fun|func|sub)\s+(?P<n>\w+)", "function")]
_word = lambda w: lambda name, line: re.search(w, line) is not None

javascript = braces(_JS, _JS_IMPORT, _word(r"\bexport"), _CLASS_OF, _JS_IN)
typescript = braces(_TS, _JS_IMPORT, _word(r"\bexport\b"), _CLASS_OF, _JS_IN)
java = braces(_JAVA, [r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"], lambda n, s: "private" not in s, _CLASS_OF, _JAVA_IN)
go = braces(_GO, [r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$'], lambda n, s: n[:1].isupper())
rust = braces(_RUST, [r"^\s*(?:pub\s+)?use\s+([\w:]+)"], _word(r"\bpub\b"), [(r"\bimpl(?:<[^>]*>)?\s+(?P<p>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<n>\w+)", "implements")], separator="::")
generic = braces(_GENERIC, [r"^\s*(?:import|using|use|require|include)\s+['\"]?([\w./\\:]+)"], lambda n, s: False)
_c_base = braces(_C, [r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'], lambda n, s: True, [(r"\b(?:class|struct)\s+(?P<n>\w+)\s*:\s*(?:public|private|protected)?\s*(?P<p>[\w:, ]+?)\s*\{", "inherits")], separator="::")


def c(source: str, path: str) -> list[dict]:
    """Exported only in headers, namespaces always."""
    header = re.search(r"\.(h|hpp|hh|hxx)$", path) is not None
    return [r | {"is_exported": int(header or r["kind"] == "module")} if r["what"] == "symbol" else r for r in _c_base(source, path)]


def apex(source: str, path: str) -> list[dict]:
    text = blank(source)
    at = _Lines(text)
    out = java(source, path)
    for m in re.finditer(r"\btrigger\s+(\w+)\s+on\s+(\w+)", text):
        out += [symbol(m[1], "trigger", at(m.start()), at(_end(text, m.end()))), reference(m[2], "schema_ref", at(m.start()), m[1])]
    for m in re.finditer(r"\[\s*SELECT\b.*?\bFROM\s+(\w+)", source, re.I | re.S):
        out.append(reference(m[1], "soql_query", at(m.start())))
    for m in re.finditer(r"(?:^|[;{}])\s*(insert|update|upsert|delete|undelete|merge)\s+(\w+)", text, re.I | re.M):
        out.append(reference(m[2], f"dml_{m[1].lower()}", at(m.start())))
    if re.search(r"@isTest", source, re.I):
        out = [r | {"is_exported": 0} if r["what"] == "symbol" else r for r in out]
    return out


# markup and schemas


def _stem(path: str) -> str:
    return re.sub(r"\..*$", "", path.rsplit("/", 1)[-1])


def aura(source: str, path: str) -> list[dict]:
    at, name = _Lines(source), _stem(path)
    root = re.search(r"<(?:aura|design):(\w+)", source)
    out = [symbol(name, "interface" if root and root[1] == "interface" else "class", 1, source.count("\n") + 1)]
    for m in re.finditer(r"<(?:aura|design):(attribute|registerEvent)\b[^>]*\bname=\"([^\"]+)\"", source):
        out.append(symbol(m[2], "field", at(m.start()), qualified=f"{name}.{m[2]}", parent=name))
    for m in re.finditer(r"\bimplements=\"([^\"]+)\"", source):
        out += [reference(i.split(":")[-1], "implements", at(m.start()), name) for i in m[1].split(",")]
    for m in re.finditer(r"\{!\s*([vc])\.(\w+)", source):
        out.append(reference(m[2], "call" if m[1] == "c" else "reference", at(m.start()), name))
    for m in re.finditer(r"<c:(\w+)", source):
        out.append(reference(m[1], "reference", at(m.start()), name))
    for m in re.finditer(r"\bcontroller=\"(\w+)\"", source):
        out.append(reference(m[1], "reference", at(m.start()), name))
    return out


def visualforce(source: str, path: str) -> list[dict]:
    at, name = _Lines(source), _stem(path)
    out = [symbol(name, "class", 1, source.count("\n") + 1)]
    for m in re.finditer(r"\b(?:standardController|controller|extensions)=\"([^\"]+)\"", source):
        out += [reference(x.strip(), "import", at(m.start()), name, x.strip()) for x in m[1].split(",")]
    for m in re.finditer(r"<c:(\w+)", source):
        out.append(reference(m[1], "reference", at(m.start()), name))
    for m in re.finditer(r"\{!\s*([A-Za-z_]\w*)", source):
        out.append(reference(m[1], "reference", at(m.start()), name))
    for m in re.finditer(r"\baction=\"\{!\s*(\w+)", source):
        out.append(reference(m[1], "call", at(m.start()), name))
    return out


def sfxml(source: str, path: str) -> list[dict]:
    at, name = _Lines(source), _stem(path)
    root = re.search(r"<(Custom\w+|Flow|Layout|PermissionSet|Profile|\w+)\s+xmlns", source)
    out = [symbol(name, "class", 1, source.count("\n") + 1, signature=root[1] if root else None)]
    for m in re.finditer(r"<(fields|validationRules|recordTypes|fieldPermissions|objectPermissions)>(.*?)</\1>", source, re.S):
        full = re.search(r"<(?:fullName|field|object)>([^<]+)<", m[2])
        if full:
            out.append(symbol(full[1], "field", at(m.start()), at(m.end()), qualified=f"{name}.{full[1]}", parent=name))
    for m in re.finditer(r"<referenceTo>([^<]+)<", source):
        out.append(reference(m[1], "reference", at(m.start()), name))
    return out


def protobuf(source: str, path: str) -> list[dict]:
    text, out, stack = blank(source), [], []
    at, depth = _Lines(text), 0
    for m in re.finditer(r'^\s*import\s+(?:public\s+|weak\s+)?"([^"]+)"', source, re.M):
        out.append(reference(_stem(m[1]), "import", at(m.start()), None, m[1]))
    token = re.compile(r"\bpackage\s+([\w.]+)\s*;|\b(message|service|enum|oneof)\s+(\w+)\s*\{|\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)|(?:\b(?:repeated|optional|required)\s+)?(?<![\w.])(map\s*<[^>]+>|[\w.]+)\s+(\w+)\s*=\s*\d+|\b([A-Z][A-Z0-9_]*)\s*=\s*-?\d+|([{}])")
    kinds = {"message": "class", "service": "class", "enum": "enum", "oneof": "field"}
    for m in token.finditer(text):
        up = stack[-1][1] if stack else None
        line = at(m.start())
        q = lambda n: f"{up}.{n}" if up else n  # noqa: B023, E731
        if m[1]:
            out.append(symbol(m[1], "module", line))
        elif m[2]:
            depth += 1
            out.append(symbol(m[3], kinds[m[2]], line, at(_end(text, m.start())), qualified=q(m[3]), parent=up))
            stack.append((depth, q(m[3]), m[2]))
        elif m[4]:
            out.append(symbol(m[4], "method", line, qualified=q(m[4]), parent=up))
            out += [reference(m[k].split(".")[-1], "reference", line, q(m[4])) for k in (5, 6)]
        elif m[8] and stack and stack[-1][2] in ("message", "oneof"):
            out.append(symbol(m[8], "field", line, qualified=q(m[8]), parent=up))
            kind = re.sub(r".*,\s*|[<>]", "", m[7]).split(".")[-1]
            if kind[:1].isupper():
                out.append(reference(kind, "reference", line, q(m[8])))
        elif m[9] and stack and stack[-1][2] == "enum":
            out.append(symbol(m[9], "constant", line, qualified=q(m[9]), parent=up))
        elif m[10] == "{":
            depth += 1
        elif m[10] == "}":
            if stack and stack[-1][0] == depth:
                stack.pop()
            depth -= 1
    return out


def script_only(source: str) -> tuple[str, str]:
    """A component file's script, everything else blank so that lines stay, and its language."""
    m = re.search(r"<script([^>]*)>(.*?)</script>", source, re.S)
    if not m:
        return "", "javascript"
    keep = lambda s: re.sub(r"[^\n]", "", s)
    return keep(source[: m.start(2)]) + m[2] + keep(source[m.end(2) :]), "typescript" if re.search(r"lang=[\"']ts", m[1]) else "javascript"


def component(source: str, path: str) -> list[dict]:
    script, lang = script_only(source)
    out = EXTRACTORS[lang](script, path)
    t = re.search(r"<template[^>]*>(.*)</template>", source, re.S)
    seen: set = set()
    at = _Lines(source)
    for m in re.finditer(r"\{\{\s*([A-Za-z_$][\w$]*)|[:@][\w.-]+=\"\s*([A-Za-z_$][\w$]*)|<([A-Z]\w*)[\s/>]", t[1] if t else ""):
        name = m[1] or m[2] or m[3]
        if name not in seen:
            seen.add(name)
            out.append(reference(name, "template", at(t.start(1) + m.start())))
    return out


EXTRACTORS: dict[str, Callable[[str, str], list[dict]]] = {
    "python": python, "javascript": javascript, "typescript": typescript, "tsx": typescript, "java": java, "go": go, "rust": rust, "c": c, "cpp": c, "apex": apex, "aura": aura, "visualforce": visualforce,
    "sfxml": sfxml, "protobuf": protobuf, "vue": component, "svelte": component,
}
GENERIC = {"csharp", "ruby", "php", "kotlin", "swift", "scala", "lua"}


def register(language: str, extractor: Callable[[str, str], list[dict]]) -> None:
    """Adds or replaces a language's extractor."""
    EXTRACTORS[language] = extractor


def extractor_for(language: str | None) -> Callable[[str, str], list[dict]] | None:
    return EXTRACTORS.get(language or "") or (generic if language in GENERIC else None)


def extract(files: DataFrame) -> DataFrame:
    """files: path, language, content. Every find of every file; files are independent, so nothing is shuffled."""
    table = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, text in zip(b.path, b.language, b.content):
                f = table.get(lang or "") or (generic if lang in GENERIC else None)
                rows += [{"path": p, **r} for r in (f(text or "", p) if f else [])]
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    return files.select("path", "language", "content").mapInPandas(run, ROW)


def symbols_of(found: DataFrame) -> DataFrame:
    return found.filter("what = 'symbol'").drop("what", "source_name", "target_name", "import_path")


def references_of(found: DataFrame) -> DataFrame:
    return found.filter("what = 'reference'").select("source_name", "target_name", "kind", F.col("line_start").alias("line"), "import_path", F.col("path").alias("source_file"))
