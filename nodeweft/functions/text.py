"""Scalar functions over columns: tokens, paths, URLs, questions. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval ignores.
STOP_WORDS = "the a an is are was were of to in on and or for with this that what does how do did it its be been as at by from".split()

#: Intents of a question and the keywords that show them.
INTENTS = {
    "roles": r"\brole|\bpermission|\baccess level|\bwho can\b",
    "rules": r"\brule|\bgate|\ballow|\bdeny|\bvalidat|\bcondition|\brestrict",
    "data_source": r"\bdata\b.*\bcome|\bwhere.*data|\bdatabase|\btable\b|\bsql\b|\bmodel\b|\bsource\b|\bfetch|\bquery",
    "inherits": r"\bextend|\binherit|\bparent class|\bsubclass|\bbase class",
    "impact": r"\bcall|\bbreak|\bimpact|\bdepend|\baffect",
    "matrix": r"\bmatrix|\bwhich pages?\b|\bevery page\b|\ball pages\b",
    "views": r"\bview\b|\brender|\btemplate|\bpartial",
}

#: What a line of code that reads or writes data looks like; case counts.
DATA_EVIDENCE = (
    r"\$this\s*->\s*db\b",
    r"->\s*table\s*\(",
    r"->\s*query\s*\(",
    r"\bModel\s*::",
    r"\bextends\s+\w*Model\b",
    r"App\\Models\\\w+",
    r"\bfind\s*\(|->\s*where\s*\(|->\s*get\s*\(",
    r"\$_(GET|POST|REQUEST|SESSION)\b",
)


def tokens(text: Column) -> Column:
    """Identifier-like words of three letters or more in lower case, without stop words, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))
    kept = F.filter(F.transform(found, F.lower), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))
    return kept


def hop_count(question: Column, default: int = 3, most: int = 10) -> Column:
    """The number before "hops", "levels" or "degrees", within 1 and `most`."""
    found = F.regexp_extract(question, r"(?i)(\d{1,9})\s+(hops?|levels?|degrees?)\b", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(default)).otherwise(F.greatest(F.lit(1), F.least(F.nullif(found, F.lit("")).cast("int"), F.lit(most))))


def intents(question: Column) -> Column:
    """The intents of a question as a sorted array."""
    q = F.coalesce(question, F.lit(""))
    return F.array_sort(F.array_compact(F.array(*[F.when(q.rlike(f"(?is){p}"), F.lit(k)) for k, p in INTENTS.items()])))


def mentions_name(question: Column, name: Column) -> Column:
    """Whether a question names `name`: as a token, spelt with spaces for underscores, or (over three letters) within it."""
    q, n = F.lower(question), F.lower(name)
    words = F.array_union(F.regexp_extract_all(q, F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), F.regexp_extract_all(q, F.lit("[a-z0-9]+"), F.lit(0)))
    spaced = (F.instr(n, "_") > 0) & F.contains(q, F.replace(n, F.lit("_"), F.lit(" ")))
    return F.array_contains(words, n) | spaced | ((F.length(n) > 3) & F.contains(q, n))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def mention_length(question: Column, file: Column) -> Column:
    """How many letters of a question name a file: by its base name, its stem or its words; null if it doesn't."""
    q, base = F.lower(question), basename(file)
    stem = F.regexp_replace(base, r"(?i)\.(php|py)$", "")
    words = F.lower(F.trim(F.regexp_replace(F.regexp_replace(stem, r"([a-z0-9])(?=[A-Z])", "$1 "), r"[_\-]+", " ")))
    return (
        F.when(F.contains(q, F.lower(base)), F.length(base))
        .when((F.length(stem) > 3) & F.contains(q, F.lower(stem)), F.length(stem))
        .when((F.length(words) > 3) & F.contains(q, words), F.length(words))
    )


def url_or_path(text: Column) -> Column:
    """The first URL or absolute path in a text; null if there is none."""
    found = F.regexp_extract(text, r"(https?://\S+)|(?:^|[^\w.])(/\w[\w./-]*)", 0)
    return F.nullif(F.regexp_replace(found, r"^[^\w/]", ""), F.lit(""))


def normalized_url(url: Column) -> Column:
    """A URL without scheme, host, query, fragment and outer slashes."""
    path = F.regexp_replace(stripped(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", "")
    return F.regexp_replace(F.substring_index(F.substring_index(path, "?", 1), "#", 1), "^/+|/+$", "")


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def top_folder(path: Column) -> Column:
    """The first segment of a path, whichever slashes it has and whether or not it begins with one."""
    plain = F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.when(plain == "", "(root)").otherwise(F.substring_index(plain, "/", 1))


def is_data_access(line: Column) -> Column:
    """Whether a line of code looks like one that reads or writes data."""
    return line.rlike("|".join(f"(?:{p})" for p in DATA_EVIDENCE))


def split_target(target: Column) -> tuple[Column, Column]:
    """The class and the method of `Class::method`, split at the last `::`; a target without one has no class."""
    method = F.substring_index(target, "::", -1)
    cls = F.when(F.instr(target, "::") > 0, F.substring(target, F.lit(1), F.char_length(target) - F.char_length(method) - 2))
    return F.nullif(cls, F.lit("")), F.when(method == "", "index").otherwise(method)


def app_of(file: Column) -> Column:
    """The path segment after `Modules`, else the first one."""
    parts = F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(F.get(parts, F.nullif(F.array_position(parts, F.lit("Modules")), F.lit(0)).cast("int")), F.get(parts, F.lit(0)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


def qualified_target(target: Column, namespace: Column) -> Column:
    """A bare `Class::method` under a namespace; absolute and namespaced targets stay."""
    bare = ~target.startswith("\\") & namespace.isNotNull() & ~F.contains(F.substring_index(target, "::", 1), F.lit("\\"))
    return F.when(bare, F.concat(F.regexp_replace(namespace, r"\\+$", ""), F.lit("\\"), target)).otherwise(target)


def class_file(name: Column) -> Column:
    """App\\Some\\Name as app/Some/Name.php."""
    path = F.replace(F.regexp_replace(name, r"^\\+", ""), F.lit("\\"), F.lit("/"))
    return F.concat(F.regexp_replace(path, "(?i)^app/", "app/"), F.lit(".php"))


def file_title(text: Column) -> Column:
    """A text that can name a file: reserved characters as _, at most 180 characters, `untitled` if nothing is left."""
    clean = F.substring(stripped(F.regexp_replace(text, r'[\\/:*?"<>|]', "_")), 1, 180)
    return F.when(clean == "", "untitled").otherwise(clean)


def note_title(node: Column, kind: Column) -> Column:
    """The title of a node's note: its id without the kind in front, and the kind."""
    place = F.when(F.instr(node, "::") > 0, F.regexp_replace(node, "^.*?::", "")).otherwise(node)
    return file_title(F.concat(place, F.lit(" ("), kind, F.lit(")")))


def slug(text: Column) -> Column:
    """A text as a short name of letters, digits, _ and -; `repo` if nothing is left."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", ""), 1, 60)
    return F.when(F.coalesce(clean, F.lit("")) == "", "repo").otherwise(clean)


def chat_title(question: Column, limit: int = 60) -> Column:
    clean = F.trim(F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), "\n", " "))
    return F.when(clean == "", "(image)").when(F.length(clean) > limit, F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("…"))).otherwise(clean)


def context_label(kind: Column, name: Column, file: Column, doc: Column) -> Column:
    return F.concat(kind, F.lit(" `"), name, F.lit("` in "), file, F.lit(": "), F.substring(F.coalesce(doc, F.lit("")), 1, 150))


def stored_answer(raw: Column) -> Column:
    """{type, content, detail} of an answer: a JSON object's fields, white space at their ends left out. The raw text stands
    for a content that is missing or blank, and for anything that isn't an object. A null field reads "None"."""
    text = F.coalesce(raw, F.lit(""))
    given = F.try_parse_json(text)
    kind = F.try_variant_get(given, "$.type", "string")

    def field(name: str) -> Column:
        there = F.array_contains(F.json_object_keys(text), F.lit(name))
        value = F.coalesce(F.try_variant_get(given, f"$.{name}", "string"), F.get_json_object(text, f"$.{name}"), F.lit("None"))
        return F.when(there, stripped(value)).otherwise("")

    content = F.when(field("content") == "", text).otherwise(field("content"))
    parsed = F.struct(F.when(kind.isin("answer", "clarify"), kind).otherwise("answer").alias("type"), content.alias("content"), field("detail").alias("detail"))
    is_object = given.isNotNull() & F.json_object_keys(text).isNotNull()
    return F.when(is_object, parsed).otherwise(F.struct(F.lit("answer").alias("type"), text.alias("content"), F.lit("").alias("detail")))
