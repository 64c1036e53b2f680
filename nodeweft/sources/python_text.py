"""A lexer for Python text that finds functions with their docstrings by logical lines and indentation.

The state machine knows comments, every string form (prefixes, triple quotes, replacement fields of f-strings that hold
strings of their own), brackets and line continuations, so a `def` inside a string or comment never counts.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings
from dataclasses import dataclass

_NEXT = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<string>(?<![A-Za-z0-9_\x80-\U0010ffff])(?P<prefix>[A-Za-z]{0,3})(?P<quote>\"\"\"|'''|"|'))|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<joined>\\\r?\n)|(?P<line>\r\n|\n|\r)""")
_SPECIAL = re.compile(r"[\"'#\\\r]")
#: What ends a string, or hides what follows it.
_STOPS = {q: re.compile(rf"\\.|{q}" + ("" if len(q) == 3 else r"|\n"), re.S) for q in ('"""', "'''", '"', "'")}
_SIMPLE = re.compile(r"""([rR]?)(\"\"\"|'''|"|')(.*)\2\s*""", re.S)
_HEADER = re.compile(r"(?:async[ \t\f\x00]+)?(?P<what>def|class)[ \t\f\x00]+(?P<name>[^\W\d]\w*)")


@dataclass(slots=True)
class Line:
    """A logical line: its place and its text with strings and comments blanked out, newlines kept."""

    at: int
    end: int
    indent: int
    masked: str


@dataclass(slots=True)
class Function:
    name: str
    qualname: str
    doc: str | None
    at: int
    end: int


def _string_end(src: str, at: int, prefix: str, quote: str) -> int:
    """The end of the string whose opening quote begins at `at`."""
    i, n, f = at + len(quote), len(src), "f" in prefix.lower() or "t" in prefix.lower()
    if not f:
        while m := _STOPS[quote].search(src, i):
            if m[0][0] != "\\":
                return m.start() if m[0] == "\n" else m.end()
            i = m.end()
        return n
    while i < n:
        c = src[i]
        if c == "\\":
            i += 2
        elif src.startswith(quote, i):
            return i + len(quote)
        elif c == "\n" and len(quote) == 1:
            return i
        elif f and c == "{":
            i = i + 2 if src.startswith("{{", i) else _field_end(src, i, quote)
        else:
            i += 1
    return n


def _field_end(src: str, at: int, quote: str) -> int:
    """The end of a replacement field of an f-string."""
    depth, i, n = 0, at, len(src)
    while i < n:
        c = src[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c in "\"'":
            if src.startswith(quote, i) and depth <= 1 and len(quote) == 3:
                return i
            q = src[i : i + 3] if src[i : i + 3] in ('"""', "'''") else c
            i = _string_end(src, i, "", q) - 1
        elif c == "\n" and len(quote) == 1:
            return i
        i += 1
    return n


def logical_lines(src: str) -> list[Line]:
    """The logical lines of a text, without those that hold only white space and comments."""
    out: list[Line] = []
    parts: list[str] = []
    start = at = depth = 0

    def close(end: int) -> None:
        text = "".join(parts)
        body = text.lstrip(" \t\f")
        if body.strip(" \t\f\r\n\0") or '"' in body:
            out.append(Line(start + len(text) - len(body), end, len(text[: len(text) - len(body)].expandtabs(8)), body))
        parts.clear()

    while True:
        if not depth and not parts:
            # Most lines are whole by themselves: no string, comment or continuation, and brackets that close.
            end = src.find("\n", at)
            text = src[at:end] if end >= 0 else ""
            if end >= 0 and not _SPECIAL.search(text) and text.count("(") == text.count(")") and text.count("[") == text.count("]") and text.count("{") == text.count("}"):
                if not text.isspace() and text:
                    parts.append(text)
                    close(end)
                start = at = end + 1
                continue
        m = _NEXT.search(src, at)
        if not m:
            break
        parts.append(src[at : m.start()])
        at = m.end()
        if m["line"]:
            if depth:
                parts.append(m["line"])
            else:
                close(m.start())
                start = at
        elif m["comment"]:
            parts.append("\0" * len(m[0]))
        elif m["string"]:
            at = _string_end(src, m.start("quote"), m["prefix"], m["quote"])
            # A blanked string keeps its first quote as a mark, its newlines don't matter.
            parts.append('"' + "\0" * (at - m.start() - 1))
        elif m["joined"]:
            parts.append("\0" * len(m[0]))
        else:
            depth = max(0, depth + (1 if m["open"] else -1))
            parts.append(m[0])
    parts.append(src[at:])
    close(len(src))
    return out


def _literal(src: str, masked: str) -> str | None:
    """The value of a statement that is nothing but string literals, as a docstring; None for anything else."""
    statement = masked.split(";", 1)[0]
    if not re.fullmatch(r'[\s\0(")]*"[\s\0(")]*', statement):
        return None
    text = src[: len(statement)]
    simple = _SIMPLE.fullmatch(text) if statement.count('"') == 1 else None
    if simple and (simple[1] or "\\" not in simple[3]):
        return inspect.cleandoc(simple[3].replace("\r\n", "\n").replace("\r", "\n"))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval("(" + text + "\n)")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    return inspect.cleandoc(value) if isinstance(value, str) else None


def functions(src: str) -> list[Function]:
    """Functions and methods in the order of the text, `doc` None without a docstring."""
    lines = logical_lines(src)
    out: list[Function] = []
    scopes: list[tuple[int, str, Function | None]] = []
    for k, line in enumerate(lines):
        while scopes and line.indent <= scopes[-1][0]:
            scopes.pop()
        for _, _, holder in scopes:
            if holder:
                holder.end = line.end
        m = _HEADER.match(line.masked)
        if not m:
            continue
        found = None
        if m["what"] == "def":
            colon = _body_colon(line.masked, m.end())
            rest = line.masked[colon:]
            if rest.strip(" \t\f\0"):
                skip = len(rest) - len(rest.lstrip(" \t\f\0"))
                doc = _literal(src[line.at + colon + skip : line.end], rest[skip:])
            elif k + 1 < len(lines) and lines[k + 1].indent > line.indent:
                doc = _literal(src[lines[k + 1].at : lines[k + 1].end], lines[k + 1].masked)
            else:
                doc = None
            found = Function(m["name"], ".".join([*(s[1] for s in scopes), m["name"]]), doc, line.at, line.end)
            out.append(found)
        scopes.append((line.indent, m["name"], found))
    return out


def _body_colon(masked: str, at: int) -> int:
    """The place behind the colon that ends a header."""
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            return i + 1
    return len(masked)


def parses(src: str) -> bool:
    """Whether the text is a Python module."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(src)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return True
