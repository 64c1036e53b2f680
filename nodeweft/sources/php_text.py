"""A tokenizer for PHP text and a scope tracker over its tokens.

The tokenizer is a state machine that knows strings (with interpolated braces), heredocs, the three comment forms and the
text outside of `<?php ... ?>`; braces, quotes and keywords inside those never count. It covers what the engine asks of
a PHP file: definitions with their documentation comments, calls, imports, constants, conditions and view references.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_NAME = r"[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*"
_CODE = re.compile(
    rf"""\s*+(?:(?P<name>\\?{_NAME}(?:\\{_NAME})*)
    |(?P<variable>\${_NAME})
    |(?P<close>\?>\n?)
    |(?P<comment>/\*.*?(?:\*/|\Z)|(?://|\#(?!\[))(?:(?!\?>)[^\n])*)
    |(?P<heredoc><<<[ \t]*(?P<q>["']?)(?P<tag>{_NAME})(?P=q)\r?\n(?:.*?\n)??[ \t]*(?P=tag)(?![A-Za-z0-9_]))
    |(?P<single>'(?:[^'\\]|\\.)*(?:'|\Z))
    |(?P<double>"|`)
    |(?P<number>\d[\w.]*)
    |(?P<op>\?->|->|::|=>|===|!==|==|!=|<=|>=|&&|\|\||\#\[|.))""",
    re.X | re.S,
)
_OPEN = re.compile(r"<\?(?:php\b|=)?", re.I)
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "readonly", "var"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    end: int


def _double_end(src: str, at: int) -> int:
    """The end of a double-quoted (or backtick) string that begins at `at`."""
    quote, i, n = src[at], at + 1, len(src)
    while i < n:
        c = src[i]
        if c == "\\":
            i += 2
        elif c == quote:
            return i + 1
        elif c == "{" and src.startswith("{$", i):
            i = _braces_end(src, i)
        else:
            i += 1
    return n


def _braces_end(src: str, at: int) -> int:
    """The end of an interpolated expression in braces, which may hold strings of its own."""
    depth, i, n = 0, at, len(src)
    while i < n:
        c = src[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        elif c == '"':
            i = _double_end(src, i) - 1
        elif c == "'":
            i = _CODE.match(src, i).end() - 1
        i += 1
    return n


def tokens(src: str) -> list[Token]:
    """The tokens of a PHP file without white space; comments are kept. Never fails: what is cut off ends at the end."""
    out: list[Token] = []
    at, n, inside = 0, len(src), False
    while at < n:
        if not inside:
            opened = _OPEN.search(src, at)
            if not opened:
                break
            at, inside = opened.end(), True
            continue
        m = _CODE.match(src, at)
        if not m:
            break
        kind, end = m.lastgroup, m.end()
        if kind == "tag":
            kind = "heredoc"
        at = m.start(kind)
        if kind == "double":
            end = _double_end(src, at)
        if kind == "close":
            inside = False
            out.append(Token("op", ";", at, end))
        else:
            out.append(Token("string" if kind in ("single", "double", "heredoc") else kind, src[at:end], at, end))
        at = end
    return out


@dataclass(slots=True)
class Definition:
    kind: str  # Class or Function
    name: str
    qualname: str
    container: tuple[str, ...]  # names of the enclosing scopes
    classes: tuple[str, ...]  # names of the enclosing classes
    doc: str
    base: str
    at: int
    end: int
    body: tuple[int, int]  # token positions of the body's first and last token; (0, 0) without a body
    closed: bool = False  # whether the body's end was found


@dataclass(slots=True)
class Parsed:
    tokens: list[Token]
    definitions: list[Definition] = field(default_factory=list)


def doc_text(comment: str) -> str:
    """The text of a `/** ... */` comment without its stars and blank lines; empty for any other comment."""
    if not comment.startswith("/**"):
        return ""
    lines = (line.strip().removeprefix("*").strip() for line in comment.removeprefix("/**").removesuffix("*/").splitlines())
    return "\n".join(line for line in lines if line).strip()


def _doc_before(found: list[Token], at: int) -> str:
    """The documentation comment directly before the declaration whose keyword is the token `at`."""
    i = at - 1
    while i >= 0:
        t = found[i]
        if t.kind == "name" and t.text.lower() in _MODIFIERS:
            i -= 1
        elif t.text == "]" and (start := _attribute_start(found, i)) is not None:
            i = start - 1
        else:
            break
    return doc_text(found[i].text) if i >= 0 and found[i].kind == "comment" else ""


def _attribute_start(found: list[Token], at: int) -> int | None:
    depth = 0
    for i in range(at, -1, -1):
        text = found[i].text
        if text == "]":
            depth += 1
        elif text in ("[", "#["):
            depth -= 1
            if not depth:
                return i if text == "#[" else None
    return None


def _next(found: list[Token], at: int) -> int:
    """The position of the next token that isn't a comment."""
    at += 1
    while at < len(found) and found[at].kind == "comment":
        at += 1
    return at


def _body_start(found: list[Token], at: int) -> int | None:
    """The position of the `{` that opens a body, or None where a `;` comes first."""
    depth = 0
    for i in range(at, len(found)):
        t = found[i]
        if t.kind == "op":
            if t.text in "([" or t.text == "#[":
                depth += 1
            elif t.text in ")]":
                depth -= 1
            elif depth <= 0 and t.text == "{":
                return i
            elif depth <= 0 and t.text == ";":
                return None
    return None


def parse(src: str) -> Parsed:
    """Tokens and definitions of a PHP file, in the order of the text.

    Named functions, methods and classes are definitions; interfaces, traits, enums, anonymous classes and closures open
    no scope of their own. A later definition of the same qualified name stands after the earlier one.
    """
    found = tokens(src)
    out = Parsed(found)
    scopes: list[tuple[str, int, Definition]] = []  # name, depth of its body, definition
    opens: dict[int, tuple[str, Definition]] = {}
    depth = 0
    before = ""
    for i, t in enumerate(found):
        if t.kind == "comment":
            continue
        if t.kind == "op":
            if t.text == "{":
                depth += 1
                if i in opens:
                    name, definition = opens.pop(i)
                    scopes.append((name, depth, definition))
            elif t.text == "}":
                if scopes and scopes[-1][1] == depth:
                    _, _, definition = scopes.pop()
                    definition.end, definition.body, definition.closed = t.end, (definition.body[0], i), True
                depth = max(0, depth - 1)
        elif t.kind == "name" and before not in ("->", "?->", "::", "new", "use"):
            word = t.text.lower()
            if word in ("class", "function"):
                j = _next(found, i)
                if word == "function" and j < len(found) and found[j].text == "&":
                    j = _next(found, j)
                if j < len(found) and found[j].kind == "name" and (word == "function" or found[j].text.lower() not in ("extends", "implements")):
                    name = found[j].text
                    names = tuple(s[0] for s in scopes)
                    start = _body_start(found, j + 1)
                    base = ""
                    if word == "class" and start is not None:
                        head = [x for x in found[j + 1 : start] if x.kind != "comment"]
                        if len(head) > 1 and head[0].text.lower() == "extends" and head[1].kind == "name" and "\\" not in head[1].text:
                            base = head[1].text
                    definition = Definition(
                        "Class" if word == "class" else "Function",
                        name,
                        ".".join((*names, name)),
                        names,
                        tuple(s[0] for s in scopes if s[2].kind == "Class"),
                        _doc_before(found, i),
                        base,
                        t.at,
                        found[j].end,
                        (start or 0, len(found) - 1 if start else 0),
                    )
                    out.definitions.append(definition)
                    if start is not None:
                        opens[start] = (name, definition)
        before = t.text.lower() if t.kind == "name" else t.text
    for _, _, definition in scopes:
        definition.end = len(src)
    return out


def walk(parsed: Parsed) -> Iterator[tuple[int, Token, Definition | None]]:
    """Each token that isn't a comment, with its position and the innermost definition whose body holds it."""
    starts = {d.body[0]: d for d in parsed.definitions if d.body[1]}
    stack: list[Definition] = []
    for i, t in enumerate(parsed.tokens):
        while stack and i > stack[-1].body[1]:
            stack.pop()
        if i in starts:
            stack.append(starts[i])
        if t.kind != "comment":
            yield i, t, stack[-1] if stack else None


def literal(t: Token) -> str:
    """The raw text between the quotes of a string token."""
    return t.text[1:-1] if t.kind == "string" and not t.text.startswith("<<<") else ""
