"""Facts of source files: one row for each definition, import, base class, call and web fact of a file.

Each file is parsed in its own row, so extraction needs no shuffle; every reference is left as a name, and the joins of
`operators.resolve` turn names into edges. Rows carry `ord`, the order of appearance in the file, wherever a rule picks
the first or last of several.
"""

from __future__ import annotations

import ast
import os
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweft.schema import CONDITION_LIMIT, DOC_LIMIT

from . import php_text

_TEXT = ("what", "file", "lang", "name", "qualname", "container", "classes", "receiver", "target", "text", "extra")
_LONG = ("ord", "lineno", "end_lineno", "level")
FACTS = T.StructType([T.StructField(n, T.StringType()) for n in _TEXT] + [T.StructField(n, T.LongType()) for n in _LONG])

#: Names of constants that stand for a role, by a noun and a suffix in either order.
ROLE_NOUNS = "ADMIN|MANAGER|READER|CHEMIST|LABORANTIN|PLANNING|SECTOR|AGENCY|REGIONAL|NATIONAL|SERVICE_TARIF|USR"
ROLE_SUFFIXES = "_CODE|_ROLE_CD|_ROLE_KEY"
_ROLE_NAME = re.compile(f"(?:{ROLE_NOUNS}).*(?:{ROLE_SUFFIXES})|(?:{ROLE_SUFFIXES}).*(?:{ROLE_NOUNS})", re.I)
_FLAG = re.compile("flag|redirect|deny|block", re.I)
#: Methods of a router that declare a route.
ROUTE_VERBS = {"get", "post", "put", "delete", "patch", "add", "match"}


class _Rows:
    def __init__(self, file: str, lang: str) -> None:
        self.rows: list[dict] = []
        self.base = {"file": file, "lang": lang}

    def add(self, what: str, **values) -> None:
        self.rows.append(self.base | {"what": what, "ord": len(self.rows)} | values)


def _holder(known: dict[str, str], file: str, scope: list[str] | tuple[str, ...]) -> str:
    """The id of the innermost scope: a function before a class of that name, else the module."""
    qualname = ".".join(scope)
    kinds = known.get(qualname, "")
    if "F" in kinds:
        return f"function::{file}::{qualname}"
    return f"class::{file}::{qualname}" if "C" in kinds else f"module::{file}"


def python_facts(file: str, content: str) -> list[dict]:
    """Facts of a Python file; only its module where it doesn't parse."""
    out = _Rows(file, "python")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        out.add("module", name=file)
        return out.rows
    out.add("module", name=file, text=(ast.get_docstring(tree) or "")[:DOC_LIMIT])
    known: dict[str, str] = {}
    calls: list[tuple] = []
    # An explicit stack: deeply nested sources must not exhaust Python's own.
    todo: list[tuple[ast.AST, tuple[str, ...], tuple[str, ...]]] = [(tree, (), ())]
    while todo:
        node, scope, classes = todo.pop()
        inner = (scope, classes)
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
            qualname = ".".join((*scope, node.name))
            holder = _holder(known, file, scope)
            known[qualname] = known.get(qualname, "") + kind[0]
            out.add(kind, name=node.name, qualname=qualname, container=holder, text=(ast.get_docstring(node) or "")[:DOC_LIMIT], lineno=node.lineno, end_lineno=node.end_lineno)
            if kind == "Class":
                for base in node.bases:
                    if isinstance(base, ast.Name):
                        out.add("base", qualname=qualname, target=base.id)
                classes = (*classes, node.name)
            inner = ((*scope, node.name), classes)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                out.add("import", target=alias.name, name=alias.asname or ("" if "." in alias.name else alias.name))
        elif isinstance(node, ast.ImportFrom):
            module = node.module or ""
            if node.level:
                package = file.split("/")[:-1]
                up = node.level - 1
                package = package[: len(package) - up] if up <= len(package) else []
                module = ".".join([*package, *(module.split(".") if module else [])])
            for alias in node.names:
                out.add("from", target=module, name=alias.asname or alias.name, text=alias.name, level=node.level or 0)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                calls.append((scope, classes, f.id, "name", "", node.lineno))
            elif isinstance(f, ast.Attribute):
                v = f.value
                receiver = v.id if isinstance(v, ast.Name) else ""
                if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super":
                    how = "super"
                else:
                    how = "self" if receiver in ("self", "cls") else "attribute"
                calls.append((scope, classes, f.attr, how, receiver, node.lineno))
        todo += [(child, *inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    for scope, classes, callee, how, receiver, lineno in calls:
        holder = _holder(known, file, scope)
        if holder.startswith("function::"):
            out.add("call", container=holder, classes=".".join(classes), target=callee, extra=how, receiver=receiver, lineno=lineno)
    return out.rows


class _Php:
    """The tokens of a PHP file without comments, with what is needed to read calls off them."""

    def __init__(self, content: str) -> None:
        self.parsed = php_text.parse(content)
        self.items = list(php_text.walk(self.parsed))
        self.lines = [0, *(m.end() for m in re.finditer("\n", content))]
        self.content = content
        self.match: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for k, (_, t, _) in enumerate(self.items):
            if t.kind == "op":
                if t.text in ("(", "[", "{", "#["):
                    stack.append((t.text, k))
                elif t.text in (")", "]", "}") and stack:
                    self.match[stack.pop()[1]] = k

    def text(self, k: int) -> str:
        return self.items[k][1].text if 0 <= k < len(self.items) else ""

    def kind(self, k: int) -> str:
        return self.items[k][1].kind if 0 <= k < len(self.items) else ""

    def line(self, k: int) -> int:
        import bisect

        return bisect.bisect_right(self.lines, self.items[k][1].at)

    def arguments(self, opening: int) -> list[tuple[int, int]]:
        """Token ranges of the arguments of a call whose parenthesis is at `opening`."""
        end = self.match.get(opening)
        if end is None:
            return []
        out, start, k = [], opening + 1, opening + 1
        while k < end:
            if k in self.match:
                k = self.match[k]
            elif self.text(k) == ",":
                out.append((start, k))
                start = k + 1
            k += 1
        return [*out, (start, end)] if start < end else out

    def literal(self, span: tuple[int, int]) -> str | None:
        """The text of an argument that is one string literal."""
        if span[1] - span[0] == 1 and self.kind(span[0]) == "string":
            return php_text.literal(self.items[span[0]][1]) or None
        return None


def php_facts(file: str, content: str) -> list[dict]:
    """Facts of a PHP file."""
    out = _Rows(file, "php")
    out.add("module", name=file)
    p = _Php(content)
    known: dict[str, str] = {}
    for d in p.parsed.definitions:
        holder = _holder(known, file, d.container)
        known[d.qualname] = known.get(d.qualname, "") + d.kind[0]
        out.add(d.kind, name=d.name, qualname=d.qualname, container=holder, text=d.doc[:DOC_LIMIT], lineno=0, end_lineno=0)
        if d.base:
            out.add("base", qualname=d.qualname, target=d.base)
    is_routes = file.endswith("Config/Routes.php")
    groups: list[tuple[int, str, str | None]] = []  # last token, prefix, namespace
    default_namespace: str | None = None
    use_until = -1
    for k, (_, t, d) in enumerate(p.items):
        while groups and k > groups[-1][0]:
            groups.pop()
        word, before, after = t.text.lower(), p.text(k - 1), p.text(k + 1)
        scope = () if d is None else (*d.container, d.name)
        holder = _holder(known, file, scope)
        classes = "" if d is None else ".".join((*d.classes, d.name) if d.kind == "Class" else d.classes)
        if t.kind != "name":
            continue
        if word == "use" and d is None and before in ("", ";", "}", "{", "<?php"):
            end = next((i for i in range(k, len(p.items)) if p.text(i) == ";"), len(p.items))
            use_until = end
            at = k + 1 + (p.text(k + 1).lower() in ("function", "const"))
            for span in _split(p, at, end):
                clause = content[p.items[span[0]][1].at : p.items[span[1] - 1][1].end]
                out.add("use", target=re.sub(r"\s+", " ", clause))
            continue
        if k < use_until:
            continue
        if word in ("require", "require_once", "include", "include_once") and before not in ("->", "::", "function"):
            at = k + 2 if after == "(" else k + 1
            if p.kind(at) == "string":
                literal = php_text.literal(p.items[at][1])
                if literal:
                    resolved = os.path.normpath(os.path.join(os.path.dirname(file), literal)).replace(os.sep, "/")
                    out.add("require", target=literal, text=resolved)
            continue
        if after == "(" and before not in ("function", "new", "fn", "&") or (after == "(" and before == "&" and p.text(k - 2) != "function"):
            args = p.arguments(k + 1)
            in_function = holder.startswith("function::")
            if before in ("->", "?->"):
                if in_function and classes and p.text(k - 2) == "$this" and p.text(k - 3) not in ("->", "::", "?->"):
                    out.add("call", container=holder, classes=classes, target=t.text, extra="this", receiver="$this", lineno=p.line(k))
                if is_routes and before == "->":
                    if word == "group" and args:
                        namespace = None
                        if len(args) > 1:
                            for i in range(args[1][0], args[1][1] - 2):
                                if p.kind(i) == "string" and php_text.literal(p.items[i][1]) == "namespace" and p.text(i + 1) == "=>" and p.kind(i + 2) == "string":
                                    namespace = php_text.literal(p.items[i + 2][1])
                        groups.append((p.match.get(k + 1, k), p.literal(args[0]) or "", namespace))
                    elif t.text == "setDefaultNamespace" and args and default_namespace is None:
                        default_namespace = p.literal(args[0])
                        out.add("namespace", target=default_namespace)
                    elif t.text in ROUTE_VERBS and len(args) > 1:
                        pattern, target = p.literal(args[0]), p.literal(args[1])
                        if pattern is not None and target is not None:
                            prefix = "/".join(g[1].strip("/") for g in groups if g[1].strip("/"))
                            out.add("route", name="/".join(s for s in (prefix, pattern.strip("/")) if s), extra=t.text.upper(), target=target, text=next((g[2] for g in reversed(groups) if g[2]), None), lineno=p.line(k))
            elif before == "::":
                if in_function and classes:
                    out.add("call", container=holder, classes=classes, target=t.text, extra="scoped", receiver=p.text(k - 2), lineno=p.line(k))
            else:
                if word == "define" and len(args) > 1:
                    name, value = p.literal(args[0]), p.literal(args[1])
                    if name and _ROLE_NAME.search(name):
                        out.add("role", name=name, target=value or name, lineno=p.line(k))
                if t.text == "view" and args and p.literal(args[0]):
                    out.add("view", target=p.literal(args[0]), extra="Function" if d is not None and d.kind == "Function" else "Module", lineno=p.line(k))
                if word == "if":
                    _gate(out, p, k, d, file)
                elif in_function and word not in ("if", "while", "for", "foreach", "switch", "match", "catch", "array", "list", "isset", "unset", "empty", "echo", "print", "return", "exit", "die", "eval", "elseif", "declare", "and", "or", "xor", "not", "use", "fn", "function", "static"):
                    out.add("call", container=holder, classes=classes, target=t.text, extra="function", receiver="", lineno=p.line(k))
    return out.rows


def _split(p: _Php, start: int, end: int) -> list[tuple[int, int]]:
    """Token ranges between commas; a braced group keeps together."""
    out, at, k = [], start, start
    while k < end:
        if k in p.match:
            k = p.match[k]
        elif p.text(k) == ",":
            out.append((at, k))
            at = k + 1
        k += 1
    return [s for s in [*out, (at, end)] if s[0] < s[1]]


def _gate(out: _Rows, p: _Php, k: int, d, file: str) -> None:
    """An `if` whose condition mentions a role variable: its constants and what its branch does."""
    opening = k + 1
    end = p.match.get(opening)
    if end is None:
        return
    condition = [p.items[i][1] for i in range(opening + 1, end)]
    if not any(t.kind == "variable" and "role" in t.text.lower() for t in condition):
        return
    codes = [t.text if t.kind == "name" else php_text.literal(t) for t in condition if t.kind in ("name", "string")]
    codes = list(dict.fromkeys(c.upper() for c in codes if c))
    effect = "checked"
    if p.text(end + 1) == "{":
        close = p.match.get(end + 1, end + 1)
        i = end + 2
        while i < close:
            if p.text(i) == "{" and i in p.match:
                i = p.match[i] + 1
                continue
            if p.kind(i) == "variable" and p.text(i - 1) in ("{", ";", "}") and p.text(i + 1) == "=" and _FLAG.search(p.text(i)) and p.text(i + 3) == ";":
                value = p.text(i + 2).lower()
                if value in ("true", "1", "false", "0"):
                    effect = "deny" if value in ("true", "1") else "allow"
                    break
            i += 1
    inside = d is not None and d.kind == "Function"
    target = f"function::{file}::{'.'.join((*d.classes[-1:], d.name))}" if inside else f"module::{file}"
    text = p.content[p.items[opening][1].at : p.items[end][1].end].strip()[:CONDITION_LIMIT]
    for code in codes:
        out.add("gate", name=code, target=target, receiver="Function" if inside else "Module", extra=effect, text=text, lineno=p.line(k))


def file_facts(files: DataFrame) -> DataFrame:
    """The facts of (file, content) rows; a null content counts as an empty file, other suffixes have none."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows += python_facts(file, content or "") if file.endswith(".py") else php_facts(file, content or "")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.get(n) for r in rows], type=pa.string()) for n in _TEXT] + [pa.array([r.get(n) for r in rows], type=pa.int64()) for n in _LONG],
                names=[*_TEXT, *_LONG],
            )

    wanted = files.where(F.col("file").endswith(".py") | F.col("file").endswith(".php")).select("file", "content")
    return wanted.mapInArrow(extract, FACTS)
