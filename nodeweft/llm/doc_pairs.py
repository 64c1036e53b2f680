"""Problem 6: functions paired with their documentation.

Each current file is lexed by a state machine that knows strings and comments (braces delimit PHP functions, indentation
Python ones); the documentation comment directly before a PHP function, or the docstring at the head of a Python
function, is attached; pairs whose documentation says nothing are dropped.

Says nothing: what is left after taking away tags without prose, placeholders, articles and words such as "function", and
words of the same stem as a word of the function's name, holds no word.

Defined results: the language goes by the suffix; a null or empty content, and a Python file that doesn't parse, has no
functions; where a name is defined twice in a file, the last definition counts (a documented one that is followed by an
undocumented one is dropped); equal rows and outdated versions of a file count once, the latest indexed_at holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweft.operators.rows import latest_rows
from nodeweft.sources import php_text, python_text

#: Words that add nothing to a function's name.
GENERIC = set(
    "a an the this that it its to is of for and does do will just simply here "
    "function functions method methods procedure routine callable func def fn "
    "le la les l un une el los las una der die das ein eine il lo uma o "
    "fonction methode méthode funktion funcion función metodo método funzione funcao função".split()
)

#: Words of placeholders; a text made of these alone says nothing.
PLACEHOLDER = set(
    "todo fixme tbd tba wip na xx xxx xxxx none null nil empty blank placeholder stub "
    "summary description descriptions describe described desc doc docs docstring docstrings documentation document documented undocumented "
    "comment comments text missing no not yet add enter write insert put fill in short brief long extended your be me later needs need please "
    "generated auto autogenerated lorem ipsum untitled unknown temp nothing".split()
)

_TAG = re.compile(r"^[@\\](\w[\w-]*)[ \t]*(.*)$", re.S)
_FIELD = re.compile(r"^:(\w+)([^:\n]*):[ \t]*(.*)$", re.S)
_SECTION = re.compile(r"^(args|arguments|parameters|params|returns?|yields?|raises|attributes|keyword args|keyword arguments|other parameters|receives|throws)\s*:?\s*$", re.I)
_ENTRY = re.compile(r"^(\*{0,2}[\w.$, *]+?)(?:\s*\(([^)]*)\))?\s*:[ \t]*(.*)$", re.S)
_TYPE = re.compile(
    r"^[?\\]?(?:(?-i:[A-Z]\w*)|int|integer|str|string|bool|boolean|float|double|array|mixed|void|null|none|object|callable|iterable|self|static|list|dict|tuple|set|any|bytes|optional|never|true|false|resource)"
    r"(?:[\\|.\[\]<>]\w*)*(?:\[[^\]]*\]|<[^>]*>)?,?$",
    re.I,
)
#: Tags that hold names and types, no prose.
_BARE_TAGS = {"var", "rtype", "type", "package", "subpackage", "access", "api", "internal", "author", "since", "version", "inheritdoc", "see", "link", "uses", "covers", "test", "static", "final", "abstract", "category", "copyright", "license", "global", "method", "property", "template"}
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def words(text: str) -> Iterator[str]:
    """Words in lower case, one by one; a name in camel or snake case is its parts."""
    for m in _WORD.finditer(text):
        part = m[0]
        if part.islower() and part.isascii():
            # Digits don't break a word before a small letter.
            yield part
        else:
            for w in _CAMEL.split(part):
                yield w.lower()


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    """A word without its English ending: stores, storing, stored and storer are one."""
    w = word
    for ending in ("izations", "isations", "ization", "isation", "ations", "ation", "ings", "ing", "ements", "ement", "ments", "ment", "ions", "ion", "ers", "ors", "ies", "ied", "ier", "er", "or", "es", "ed", "s"):
        if w.endswith(ending) and len(w) - len(ending) >= 3 and not (ending == "s" and w.endswith("ss")):
            w = w[: -len(ending)] + ("y" if ending in ("ies", "ied", "ier") else "")
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "ls":
        w = w[:-1]
    while len(w) > 3 and w[-1] in "eat":
        w = w[:-1]
    return w[:-1] + "i" if len(w) > 2 and w[-1] == "y" else w


def _without_names(text: str, names: str) -> str:
    """What a tag's prose says beyond the parameter's own name and leading types."""
    drop = {stem(w) for w in words(names)}
    parts = text.lstrip("-–—: ").split()
    while parts and (parts[0].startswith("$") or parts[0] in ("-", "–", ":")):
        parts.pop(0)
    return " ".join(w for w in words(" ".join(parts)) if stem(w) not in drop)


def prose(doc: str) -> str:
    """The text of a documentation without tags, parameter names and types; prose of tags is kept."""
    if not re.search(r"[@\\:]|^\s*[-=~]{3}", doc, re.M):
        return doc
    out: list[str] = []
    section, section_indent, last = "", 0, ""
    lines = doc.splitlines()
    for k, raw in enumerate(lines):
        line, indent = raw.strip(), len(raw) - len(raw.lstrip())
        if not line or re.fullmatch(r"[-=~^*_#]{2,}", line):
            if not line:
                last = ""
            continue
        head = _SECTION.match(line)
        if head and (line.endswith(":") or k + 1 < len(lines) and re.fullmatch(r"\s*[-=~]{3,}\s*", lines[k + 1])):
            section, section_indent, last = head[1].lower(), indent, "section"
            continue
        tag, named = _TAG.match(line), _FIELD.match(line)
        if tag:
            name, rest = tag[1].lower(), tag[2]
            section, last = "", "tag"
            if name in _BARE_TAGS and name not in ("internal",):
                parts = rest.split()
                while parts and (parts[0].startswith("$") or _TYPE.match(parts[0]) or name in ("package", "subpackage", "author", "version", "since", "link", "license", "see", "uses", "covers", "category", "template")):
                    parts.pop(0)
                out.append(" ".join(parts))
                continue
            if name in ("param", "arg", "argument", "return", "returns", "throws", "throw", "exception", "raises", "yield", "yields"):
                parts, names = rest.split(), ""
                seen_type = False
                while parts:
                    p = parts[0]
                    if p.startswith(("$", "&$", "...$")):
                        names += " " + parts.pop(0)
                    elif not seen_type and not names and (_TYPE.match(p) or "|" in p or name in ("throws", "throw", "exception") or (len(parts) > 1 and parts[1].startswith("$"))):
                        seen_type = True
                        parts.pop(0)
                    else:
                        break
                out.append(_without_names(" ".join(parts), names))
                continue
            out.append(rest)
            continue
        if named and named[1].lower() in ("param", "parameter", "arg", "argument", "key", "keyword", "return", "returns", "rtype", "type", "raise", "raises", "except", "exception", "var", "ivar", "cvar", "yield", "yields"):
            what, names, rest = named[1].lower(), named[2], named[3]
            section, last = "", "tag"
            if what not in ("rtype", "type"):
                parts = rest.split()
                if len(parts) == 1 and what in ("return", "returns", "raise", "raises") and _TYPE.match(parts[0]) and parts[0][:1].isupper() | (parts[0].lower() in ("none", "int", "str", "bool", "float", "list", "dict", "bytes", "tuple", "set")):
                    parts = []
                out.append(_without_names(" ".join(parts), names))
            continue
        if section:
            if indent < section_indent or (last == "" and indent <= section_indent and not _ENTRY.match(line)):
                section = ""
            else:
                entry = _ENTRY.match(line)
                if entry and len(entry[1].split()) <= 3:
                    rest = entry[3]
                    parts = rest.split()
                    if parts and all(_TYPE.match(p) for p in parts):
                        rest = ""
                    out.append(_without_names(rest, entry[1]))
                elif len(line.split()) == 1 and (re.fullmatch(r"\*{0,2}\w+", line) is not None):
                    out.append("" if section.startswith(("arg", "param", "raise", "throw", "other", "key", "attr", "rec")) or _TYPE.match(line) else line)
                else:
                    out.append(line)
                last = "section"
                continue
        last = ""
        out.append(line)
    return "\n".join(x for x in out if x)


def says_something(doc: str, name: str) -> bool:
    """Whether a documentation tells more than the function's name does."""
    text = prose(doc)
    if "/" in text:
        text = re.sub(r"\bn\s*/\s*a\b\.?", " ", text, flags=re.I)
    own = {stem(w) for w in words(name)} | {name.lower().strip("_")}
    return any(w not in GENERIC and w not in PLACEHOLDER and stem(w) not in own and w not in own for w in words(text))


def file_functions(file: str, content: str | None) -> list[tuple[str, str, str, str]]:
    """(qualname, name, documentation, code) of each function of a file, the last definition of a qualname."""
    if not content:
        return []
    found: dict[str, tuple[str, str, str, str]] = {}
    if file.endswith(".py"):
        if python_text.parses(content):
            for f in python_text.functions(content):
                found[f.qualname] = (f.qualname, f.name, f.doc or "", content[f.at : f.end])
    elif file.endswith(".php"):
        for d in php_text.parse(content).definitions:
            if d.kind == "Function":
                found[d.qualname] = (d.qualname, d.name, d.doc, content[d.at : d.end])
    return list(found.values())


PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("node_id", "name", "file", "doc", "code")])


def documented_functions(files: DataFrame, code: bool = True) -> DataFrame:
    """node_id, name, file, doc and code of each function whose documentation says something; code null unless wanted."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (f"function::{file}::{qualname}", name, file, doc, body if code else None)
                for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True)
                for qualname, name, doc, body in file_functions(file, content)
                if says_something(doc, name)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], type=pa.string())] * 5, names=PAIR.names)

    now = latest_rows(files.select("file", "content", "indexed_at"), ["file"], ["indexed_at"], ["content"])
    wanted = now.where(F.col("file").endswith(".py") | F.col("file").endswith(".php"))
    return wanted.mapInArrow(pairs, PAIR)
