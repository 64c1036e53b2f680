"""Problem 1: which files were not written by hand for their repository.

Every file and every directory has one of five labels: handwritten, generated, minified, vendored, blob. Evidence from a
file's leading comments, name and text, and from a directory's name, is joined by belief propagation: the tree of
directories is a graphical model in which a parent's label makes some labels of its children likelier than others, so a
file without a mark of its own is judged by its directory, that by its siblings and by the directories above. A tree needs
two sweeps for exact marginals: messages go up from the deepest level to the roots, then down again. Files take part once
going up (summed per directory, with partial sums in each task, so a directory that holds a third of all files moves one row
per task) and once going down. Trees are independent: those of at most `tree_rows` directories are swept whole, each in a
task's call; in a larger one a sweep is one aggregation or join of directories per level, spread over all tasks. Both ways
give the same beliefs.

A directory whose own name says what it holds (`generated`, `site-packages`, `lib/name-1.2.3`) doesn't depend on the
one it lies in, nor tell anything about it.

Evidence is a table of log-likelihoods against `handwritten`. Comments count only where they lead the file, so a banner
kept in a string, a remark in the code or a team's note doesn't mark it; a name counts as a whole path segment or a known
form, so `vendor_portal` or `generated_reports` marks nothing.

Defined results: the latest indexed_at of a file holds; null and empty contents have no evidence of their own (the path
decides); rows with a null file are left out; equal rows count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from nodeweft.operators.rows import bind, broadcast_if_small, latest_rows
from nodeweft.session import stage

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GEN, MIN, VEN, BLOB = range(5)

#: P(label of a child | label of its directory), by rows of the directory's label.
DIRECTORY_IN_DIRECTORY = (
    (0.9980, 0.0005, 0.0005, 0.0005, 0.0005),
    (0.050, 0.930, 0.010, 0.005, 0.005),
    (0.100, 0.020, 0.860, 0.010, 0.010),
    (0.010, 0.005, 0.020, 0.960, 0.005),
    (0.100, 0.020, 0.020, 0.010, 0.850),
)
FILE_IN_DIRECTORY = (
    (0.760, 0.080, 0.030, 0.100, 0.030),
    (0.060, 0.900, 0.020, 0.005, 0.015),
    (0.100, 0.020, 0.840, 0.020, 0.020),
    (0.020, 0.010, 0.030, 0.930, 0.010),
    (0.100, 0.020, 0.020, 0.010, 0.850),
)
#: P(label) of a directory that has none above it.
ROOT = (0.9984, 0.0005, 0.0003, 0.0005, 0.0003)

#: From this evidence on, a directory's name settles what it holds.
APART = 5.0

#: Directories of a tree that is swept in one call (some 200 bytes each).
TREE_ROWS = 100_000
#: Directories up to this number are broadcast to the files (a path and five numbers each); beyond it they are shuffled.
BROADCAST_ROWS = 100_000

_VENDOR_DIR = r"(^|.*[.@-])?_*(vendor|vendors|vendored|third[-_]?party|3rd[-_]?party|site[-_]packages|dist[-_]packages|node_modules|bower_components|externals?|ext|extlib|contrib[-_]?libs?|imported|deps|dependencies|bundled|bundled[-_](libs?|packages|deps)|upstream|external[-_](libs?|code|src|packages)|(libs?|src)[-_]ext(ernal)?|jspm_packages|pods|carthage|wheelhouse|eggs|pear|composer)_*"
_VERSIONED_DIR = r"[A-Za-z][\w-]*-v?\d+(\.\d+)+"
_GENERATED_DIR = r"_*(generated|autogen|auto[-_]generated|autogenerated|gen|gensrc|gen[-_](py|php|src|code)|(generated|autogenerated|derived)[-_](src|code|sources|files|classes)|codegen([-_]out(put)?)?|compiled|proxies|__generated__|stubs|(openapi|swagger|protobuf|grpc|thrift)[-_](client|gen|out|stubs|generated))_*"
_COMPILED_DIR = r"(.*/)?cache/(views|templates|twig|blade|smarty)"

_GENERATED_NAME = re.compile(r"(?:_pb2|_pb2_grpc|\.pb|_gen|_generated|\.gen|\.g|\.generated|_stubs?|_autogen|\.designer|[a-z]Generated|[a-z]Gen)\.\w+$|^__CG__|^[0-9a-f]{16,}\.\w+$")
_MINIFIED_NAME = re.compile(r"(?:[.\-_](?:min|packed|pack|compact|compressed|bundle))\.\w+$")

_GENERATED_SURE = re.compile(
    r"@generated\b|<auto-?generated|\bauto[- ]?generated\b|\bautogenerated\b|\bmachine[- ](?:made|generated|written|produced)\b"
    r"|\b(?:automatically|mechanically) (?:generated|produced|created|built|written|made|derived)\b|\b(?:generated|produced|created|emitted|derived|made|built|written|exported) (?:automatically|mechanically)\b"
    r"|\b(?:code|file|module|class|source|this|was|is|been) (?:generated|emitted|produced|transpiled) (?:by|from|with|using|via)\b|^\W*(?:generated|emitted|produced|transpiled|compiled|rendered|built) (?:by|from|with|using|via)\b"
    r"|\b(?:written|produced|created|made|output|emitted|built) by (?:the |an? )?[\w.-]+ (?:compiler|generator|code ?gen(?:erator)?|tool|template engine|transpiler|scaffolder|plugin)\b"
    r"|\b(?:edits?|changes?|modifications?|anything)\b[^.\n]{0,40}\b(?:lost|overwritten|discarded|undone|wiped)\b|\bwill be overwritten\b"
    r"|\brun [`'\"]?[\w./-]+[^.\n]{0,40} to (?:refresh|regenerate|rebuild|update|recreate)\b"
    r"|\b(?:re-?generate|regenerated|re-?run) (?:it |this |this file |the file )?(?:with|by|using|via|from|whenever|every|on each)\b|\b(?:manual|hand|local)[- ]?(?:made )?(?:edits?|changes?|modifications?) (?:are|get|do not|don['’]t|will not|won['’]t) (?:ignored|lost|dropped|survive|persist|kept|be kept)\b"
    r"|\b(?:not (?:meant|intended|supposed) (?:to be (?:edited|changed|read)|for (?:editing|humans))|do not hand[- ]?edit|never hand[- ]?edited)\b|^\W*(?:generator|generated[- ](?:on|at|date)|codegen)\s*[:=]|\b(?:scaffolded|transpiled|compiled|rendered|translated|dumped|expanded) (?:automatically )?(?:by|from|with) [\w./-]+"
    r"|\b(?:is|this is) (?:the )?(?:machine |tool |compiler |generator )output\b|\boutput of (?:the )?[\w.-]+ (?:compiler|generator|codegen|tool|transpiler)\b"
    r"|\bautogenerad[oa]\b|\bgenerad[oa] (?:automáticamente |automaticamente )?(?:por|con|desde|a partir)\b|\bg[ée]n[ée]r[ée]e?s? (?:automatiquement )?(?:par|avec|depuis|à partir)\b|\bg[ée]n[ée]r[ée]e? automatiquement\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\b(?:erzeugt|generiert) (?:von|durch|mit|aus)\b|\bgerad[oa] (?:automaticamente )?(?:por|com|a partir)\b|\bgenerat[oa] (?:automaticamente )?(?:da|con|dal)\b",
    re.I | re.M,
)
_KEEP_OUT = re.compile(
    r"\b(?:do not|don['’]t|never|please do not) (?:edit|modify|change|touch|alter)(?: (?:it|this|this file|the file|anything here|by hand|manually|directly)\b|\W*$|[.!]?\s*$|[.!])|\bnot? to be edited\b|\bne pas (?:modifier|éditer|editer|toucher)\b|\bno (?:editar|modificar|tocar)\b|\bnicht (?:von hand |manuell )?(?:[äa]e?ndern|bearbeiten|editieren)\b|\bnão (?:editar|modificar|edite|modifique)\b|\bnon modificare\b",
    re.I | re.M,
)
_VENDORED = (
    re.compile(r"\bvendored (?:from|copy|in|version)\b|\b(?:copied|taken|imported|adapted|borrowed|forked|pulled|backported|mirrored|bundled|synced) (?:verbatim |unchanged |over )?from\b(?! (?:our|the (?:old|other) (?:module|screen|job)))|\blocal (?:changes|patches|modifications):|\bupstream (?:version|release|tag|commit|source|repository|url|project)\b|\bupstream\s*[:=]|\b(?:unmodified|verbatim|patched|pristine|frozen|pinned|local) (?:copy|version|mirror|snapshot) of\b|\bunmodified (?:copy|version)\b|\b(?:mirror|snapshot|fork|backport|port) of (?:the )?[\w.-]+ (?:v?\d|library|package|project|module)|\b(?:downloaded|fetched|obtained|extracted|originally) from\b|\bthird[- ]party (?:code|library|module|package|source|component)\b|\bkept in sync with (?:the )?upstream\b", re.I),
    re.compile(r"\b(?:is|are) (?:a )?part of (?:the )?[\w.-]+ (?:package|library|project|framework|distribution|toolkit|sdk|bundle|suite|module)\b|\blicen[cs]e file\b[^.\n]{0,40}\b(?:shipped|distributed|included|bundled|came|comes|provided) with|\bfor (?:the )?(?:full|complete) (?:copyright and )?licen[cs]e\b|\bcopyright and licen[cs]e information\b", re.I),
    re.compile(r"@license\b|\bSPDX-License-Identifier\b|\b(?:licensed|distributed|available|published) under (?:the (?:terms of )?)?|\b(?:MIT|BSD(?:-\d-Clause)?|Apache(?:-| License)?|[AL]?GPL(?:v?\d)?|MPL|ISC|Unlicense|zlib|WTFPL|CC0)(?:[- ]?\d(?:\.\d)?)?(?: licen[cs]e)?\s*$|\breleased under\b|\bpermission is hereby granted\b|\bredistribution and use\b", re.I | re.M),
    re.compile(r"\(c\)\s*(?:\d{4}[-, \d]*)?\s*(?:by )?(?:the )?[\w.-]+ (?:contributors|authors|developers|project|team and contributors|community)\b|\bcopyright\b[^.\n]*\b(?:contributors|authors|developers|foundation|community)\b|@author\b[^\n]*<[^>\n]+@[^>\n]+>", re.I),
    re.compile(r"^\W*[\w.-]+ (?:- |– |: |is )?an? (?:small|tiny|simple|fast|lightweight|minimal|little|pure[- ]\w+|modern|portable)\b[^.\n]{0,40}\b(?:library|package|toolkit|framework|module|parser|client)\b|^\W*[\w.-]+ [-–] (?:small|tiny|simple|fast|lightweight|minimal|little)\b[^.\n]{0,40}\b(?:library|package|toolkit|framework|parser|client)\b", re.I | re.M),
    re.compile(r"@package\b|@link\s+https?://|@see\s+https?://|^\W*(?:homepage|project page|website|repository|source|origin)\s*:\s*https?://|\bhttps?://(?:www\.)?(?:github|gitlab|bitbucket|pypi|packagist)\.", re.I),
    re.compile(r"^\W*[a-z][\w.-]+ v?\d+\.\d+(?:\.\d+)*\s*$|@version\s+\d", re.I | re.M),
)
#: Marks of a firm's own work; somebody else's project doesn't bear them.
_OWN = re.compile(r"\b(?:for )?internal use only\b|\bconfidential\b|\bproprietary\b|\bnot for distribution\b|\bcompany confidential\b|\btrade secret\b", re.I)

_PHP_LEAD = re.compile(r"\s*(?:<\?(?:php)?)?(?:declare\s*\([^)]*\)\s*;)?\s*", re.I)
_PHP_COMMENT = re.compile(r"\s*(/\*.*?(?:\*/|\Z)|(?://|#(?!\[))[^\n]*)", re.S)
_PY_COMMENT = re.compile(r"[ \t]*(?:\r?\n|#([^\n]*)\n?)")
_NUMBERS = re.compile(r"(?:(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?)\s*,\s*){8,}(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?)?")
_BEFORE_COMMA = tuple(f"{c}," for c in "0123456789abcdefABCDEF \t\r\n\v\f")
_OPAQUE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3})(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){7,}|(?<![0-9a-fA-F])[0-9a-fA-F]{32,}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_STRING = re.compile(r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.S)
_NAME = re.compile(r"[A-Za-z_]\w*")
_KEYWORDS = set(
    "and as assert async await break case catch class const continue def default del do echo elif else elseif endif except extends false final finally fn for foreach from function global goto "
    "if implements import in include instanceof interface is isset lambda list match namespace new none nonlocal not null or os pass php print private protected public raise re require return self static "
    "switch this throw trait true try unset use var while with yield array count strlen len range int str".split()
)
_FUNCTION = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|async)\s+)*(?:def|function)\s+&?\w+", re.M)
_FUNCTION_DOC = re.compile(r"\*/\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\b|^[ \t]*(?:async\s+)?def\s+\w+\([^)]*\)[^:\n]*:\s*[rRuUbB]{0,2}(?:\"\"\"|''')", re.M | re.S)


def leading_comments(content: str) -> str:
    """The comments that stand before any code, without their marks."""
    out: list[str] = []
    if content.lstrip("﻿ \t\r\n")[:2] == "<?":
        at = _PHP_LEAD.match(content, len(content) - len(content.lstrip("﻿"))).end()
        while m := _PHP_COMMENT.match(content, at):
            body = re.sub(r"^/\*+|\*+/$", "", m[1].strip())
            out += [re.sub(r"^\s*(?:\*+|//+|#+)\s?", "", line).strip() for line in body.split("\n")]
            at = m.end()
    else:
        at = 0
        text = content.lstrip("﻿")
        while (m := _PY_COMMENT.match(text, at)) and m.end() > at:
            if m[1] is not None and not m[1].startswith("!"):
                out.append(m[1].strip())
            at = m.end()
    return "\n".join(out)


def opaque_share(content: str) -> float:
    """Which part of a file's visible characters is encoded data or long rows of numbers."""
    visible = len(content) - sum(map(content.count, " \t\r\n"))
    if not visible:
        return 0.0
    opaque = 0
    # A row of numbers has eight commas behind digits (or white space).
    if sum(map(content.count, _BEFORE_COMMA)) >= 8:
        for m in _NUMBERS.finditer(content):
            opaque += len(m[0]) - sum(map(m[0].count, " \t\r\n"))
    # Encoded data is at least 32 characters without white space.
    for m in (m for part in content.split() if len(part) >= 32 for m in _OPAQUE.finditer(part)):
        run = m[0]
        # A long name or path isn't data: data has digits spread among letters of both cases, or is hexadecimal.
        if run[0] == "\\" or re.fullmatch(r"[0-9a-fA-F]+", run) and re.search(r"\d", run) or len(re.findall(r"\d", run)) >= len(run) // 16 and re.search("[a-z]", run) and re.search("[A-Z]", run):
            opaque += len(run)
    return min(1.0, opaque / visible)


def density(content: str) -> float:
    """How far a file's text looks packed: 0 for ordinary code, 1 for a packed one. What can't reach a half whatever its names
    are is told by its layout alone."""
    # Strings and comments say nothing about how code is laid out.
    code = _STRING.sub('""', re.sub(r"/\*.*?\*/|^\s*(?://|#(?!\[)).*$", "", content, flags=re.S | re.M))
    lines = [line for line in code.split("\n") if line.strip()]
    if len(code) - sum(map(code.count, " \t\r\n")) < 80:
        return 0.0
    tight = len(re.findall(r"[\w\])][=<>+*/?:,;{}]+[\w\[($\"']", code)) / max(1, len(re.findall(r"[=<>+*/?:,;{}]+", code)))
    packed = sum(";" in line.rstrip().rstrip(";{}") or re.search(r"\)\s*:\s*\S", line) is not None and "def " in line for line in lines) / len(lines)
    layout = max(0.0, min(1.0, 1.6 * tight)) * 0.3 + min(1.0, 1.5 * packed) * 0.3
    if layout < 0.1:
        return layout
    names = [n for n in _NAME.findall(code) if n.lower() not in _KEYWORDS]
    if len(names) < 8:
        return 0.0
    short = sum(len(n) <= 2 for n in names) / len(names)
    return max(0.0, min(1.0, 1.2 * short)) * 0.4 + layout


def file_evidence(file: str, content: str | None) -> list[float]:
    """Log-likelihoods of a file's marks under each label, against `handwritten`."""
    e = [0.0] * 5
    name = file.rsplit("/", 1)[-1]
    if _GENERATED_NAME.search(name):
        e[GEN] += 6.0
    if _MINIFIED_NAME.search(name):
        e[MIN] += 2.0
    if not content or not content.strip():
        return e
    head = leading_comments(content)
    sure, keep_out = _GENERATED_SURE.search(head) is not None, _KEEP_OUT.search(head) is not None
    e[GEN] += 8.0 if sure else 2.5 if keep_out else 0.0
    marks = sum(p.search(head) is not None for p in _VENDORED)
    if _OWN.search(head):
        e[VEN] -= 6.0
    elif marks:
        # The first two forms say it outright; licences, holders, versions and links add up.
        outright = any(p.search(head) for p in _VENDORED[:2]) or _VENDORED[4].search(head) is not None
        e[VEN] += 8.0 if outright or marks > 1 else 4.5
    else:
        e[VEN] -= 1.0
    share, packed = opaque_share(content), density(content)
    e[BLOB] += 9.0 if share >= 0.6 else 3.0 if share >= 0.45 else -3.0
    e[MIN] += 9.0 if packed >= 0.6 else 3.0 if packed >= 0.5 else -4.0
    if _FUNCTION_DOC.search(content):
        e[GEN] -= 1.5
    else:
        e[GEN] += min(1.0, 0.3 * len(_FUNCTION.findall(content)))
    return e


@arrow_udf(T.ArrayType(T.DoubleType(), False))
def _evidence(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for files, contents in batches:
        yield pa.array([file_evidence(f, c) for f, c in zip(files.to_pylist(), contents.to_pylist(), strict=True)], type=pa.list_(pa.float64()))


def directory_evidence(path: Column) -> Column:
    """Log-likelihoods of a directory's name, by whole segments of its path."""
    own = F.lower(F.element_at(F.split(path, "/"), -1))
    vendored = F.when(own.rlike(f"^{_VENDOR_DIR}$"), 11.0).when(own.rlike(f"^{_VERSIONED_DIR}$"), 10.0).when(own.isin("lib", "libs", "library_src"), 1.0).otherwise(0.0)
    generated = F.when(own.rlike(f"^{_GENERATED_DIR}$") | F.lower(path).rlike(f"^{_COMPILED_DIR}$"), 11.0).otherwise(0.0)
    minified = F.when(own.isin("min", "minified", "dist"), 1.0).otherwise(0.0)
    return F.array(F.lit(0.0), generated, minified, vendored, F.lit(0.0))


# Beliefs and messages are arrays of five logarithms, in the order of LABELS.


def _nothing() -> Column:
    return F.array(*[F.lit(0.0)] * 5)


def _plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def _minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def _total(column: str) -> Column:
    """The sum of arrays over the rows of a group."""
    return F.array(*[F.sum(F.get(column, F.lit(k))) for k in range(5)])


def _log_sums(belief: Column, weights: list[tuple[float, ...]]) -> Column:
    """log(sum(weight x exp(belief))) for each row of weights, less the first: only differences count in a message, and
    centring keeps sums over many children in range."""
    table = F.array(*[F.array(*[F.lit(w) for w in row]) for row in weights])

    def summed(b: Column) -> Column:
        return bind(F.array_max(b), lambda top: F.transform(table, lambda row: top + F.ln(F.aggregate(F.zip_with(row, b, lambda w, x: w * F.exp(x - top)), F.lit(0.0), lambda t, v: t + v))))

    return bind(bind(belief, summed), lambda m: F.transform(m, lambda x: x - F.get(m, F.lit(HAND))))


def _to_parent(own: Column, table: tuple) -> Column:
    """The message of a child with log-beliefs `own` about each label of its directory."""
    return _log_sums(own, [table[p] for p in range(5)])


def _to_child(parent: Column, table: tuple) -> Column:
    """The message of a directory with log-beliefs `parent` about each label of a child."""
    return _log_sums(parent, [tuple(table[p][c] for p in range(5)) for c in range(5)])


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _messages(belief: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log(sum(weight x exp(belief))) for each row of weights, less the first; a row of beliefs per child."""
    top = belief.max(axis=1, keepdims=True)
    out = top + np.log(np.exp(belief - top) @ weights.T)
    return out - out[:, [HAND]]


def _swept(tree: pd.DataFrame) -> pd.DataFrame:
    """Both sweeps over one whole tree of directories."""
    table = np.asarray(DIRECTORY_IN_DIRECTORY)
    place = {d: i for i, d in enumerate(tree["dir"])}
    depth, alone = tree["depth"].to_numpy(), tree["alone"].to_numpy(dtype=bool)
    above = np.array([place.get(u, -1) if n > 1 else -1 for u, n in zip(tree["up"], depth, strict=True)])
    a = np.stack(tree["m"].to_list()).astype(np.float64)
    told = np.zeros_like(a)
    levels = [np.flatnonzero(depth == n) for n in range(1, depth.max() + 1)]
    for level in reversed(levels[1:]):
        told[level] = np.where(alone[level, None], 0.0, _messages(a[level], table))
        np.add.at(a, above[level], told[level])
    b = a.copy()
    b[levels[0]] += np.log(ROOT)
    for level in levels[1:]:
        b[level] += np.where(alone[level, None], 0.0, _messages(b[above[level]] - told[level], table.T))
    return pd.DataFrame({"dir": tree["dir"], "b": list(b)})


def beliefs(tree: DataFrame, tree_rows: int) -> DataFrame:
    """(dir, b): the belief of each directory, with what the rest of its tree tells it."""
    rooted = tree.withColumn("root", F.substring_index("dir", "/", 1))
    large = stage(rooted.groupBy("root").count().where(F.col("count") > tree_rows).select("root"), "large-trees")
    few = broadcast_if_small(large, BROADCAST_ROWS)
    whole = rooted.join(few, "root", "left_anti").groupBy("root").applyInPandas(_swept, "dir string, b array<double>")
    return whole if not large.take(1) else whole.unionByName(_by_levels(rooted.join(few, "root", "left_semi")))


def _by_levels(tree: DataFrame) -> DataFrame:
    """The same as `_swept`, a level of all trees at a time."""
    deepest = tree.agg(F.max("depth")).first()[0]
    levels: dict[int, DataFrame] = {}
    for depth in range(deepest, 0, -1):
        level = tree.where(F.col("depth") == depth)
        if depth + 1 in levels:
            below = levels[depth + 1].groupBy(F.col("up").alias("dir")).agg(_total("t").alias("s"))
            level = level.join(below, "dir", "left").withColumn("m", _plus(F.col("m"), F.coalesce("s", _nothing())))
        # a: all that lies below and its own name; t: what it tells its parent.
        told = F.when(F.col("alone"), _nothing()).otherwise(_to_parent(F.col("m"), DIRECTORY_IN_DIRECTORY))
        levels[depth] = stage(level.select("dir", "up", "alone", F.col("m").alias("a"), told.alias("t")), f"up-{depth}")

    # Downwards. b: the belief of a directory, with what the rest of the tree tells it.
    found: list[DataFrame] = []
    for depth in range(1, deepest + 1):
        level = levels[depth]
        if not found:
            down = level.select("dir", _plus(F.col("a"), F.array(*[F.lit(math.log(p)) for p in ROOT])).alias("b"))
        else:
            above = found[-1].select(F.col("dir").alias("up"), F.col("b").alias("p"))
            # The parent's belief without what this child itself told it.
            told = F.when(F.col("alone"), _nothing()).otherwise(_to_child(_minus(F.col("p"), F.col("t")), DIRECTORY_IN_DIRECTORY))
            down = level.join(above, "up").select("dir", _plus(F.col("a"), told).alias("b"))
        found.append(stage(down, f"down-{depth}"))
    return reduce(DataFrame.unionByName, found)


def file_labels(files: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(file, label, p_handwritten) of each current file: its likeliest label and the marginal of `handwritten`."""
    now = latest_rows(files.where(F.col("file").isNotNull()).select("file", "content", "indexed_at"), ["file"], ["indexed_at"], ["content"])
    judged = now.select("file", _parent(F.col("file")).alias("dir"), _evidence(F.col("file"), F.col("content")).alias("e"))
    leaves = stage(judged.withColumn("m", _to_parent(F.col("e"), FILE_IN_DIRECTORY)), "files")

    # Upwards. m holds, for each directory, what its files say; each level adds what its subdirectories say.
    mine = leaves.groupBy("dir").agg(_total("m").alias("m"))
    steps = F.split("dir", "/")
    every = mine.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("dir")).distinct()
    named = every.join(mine, "dir", "left").select("dir", F.size(steps).alias("depth"), _parent(F.col("dir")).alias("up"), F.coalesce("m", _nothing()).alias("m"), directory_evidence(F.col("dir")).alias("n"))
    # Nothing passes between a directory named for its contents and the one above.
    tree = stage(named.select("dir", "depth", "up", _plus(F.col("m"), F.col("n")).alias("m"), (F.array_max("n") >= APART).alias("alone")), "directories")
    directories = beliefs(tree, tree_rows)

    joined = leaves.join(broadcast_if_small(directories, BROADCAST_ROWS), "dir")
    x = _plus(F.col("e"), _to_child(_minus(F.col("b"), F.col("m")), FILE_IN_DIRECTORY))
    odds = bind(F.col("x"), lambda v: F.aggregate(v, F.lit(0.0), lambda t, y: t + F.exp(y - F.get(v, F.lit(HAND)))))
    label = F.get(F.array(*map(F.lit, LABELS)), F.array_position("x", F.array_max("x")).cast("int") - 1)
    return joined.select("file", x.alias("x")).select("file", label.alias("label"), (1 / odds).alias("p_handwritten"))


def foreign_files(files: DataFrame) -> DataFrame:
    """The files of which it is likelier than not that they aren't hand-written source of their repository."""
    return file_labels(files).where(F.col("p_handwritten") < 0.5).select("file")
