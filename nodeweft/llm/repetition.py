"""Problem 9: which share of a text only repeats what the same text said before.

A table of measures and thresholds is compiled into one projection; no user function takes part. The measures:

* repeated_words: share of the words that lie in `window` consecutive words which also begin at an earlier word;
* repeated_lines: share of the non-blank lines that stand earlier in the text;
* symbols: share of the characters that are neither letter, digit nor white space;
* stop_words: share of the words that are common function words;
* words, chars: lengths.

Repeated windows are found by sorting a text's windows with their positions: every window equal to the one before it in
that order begins at an earlier word. The cost of a text of n words is that of the sort, n log n, whatever it repeats.

Defined results: a null text and a text without a window have a share of 0 and no flags; an empty text has lengths of 0;
words are runs of letters, compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweft.operators.rows import bind

WINDOW = 5

#: Function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in is that it for on with as are this be by from or an not "
    "le la les des et une dans est que pour sur avec pas qui du "
    "el los las una que en por con para del se no "
    "der die das und den von mit ist ein eine nicht auf im zu"
).split()

#: (flag, measure, comparison, threshold): a row is flagged where the comparison holds.
THRESHOLDS = (
    ("repeats_itself", "repeated_words", ">=", 0.5),
    ("repeats_lines", "repeated_lines", ">=", 0.3),
    ("mostly_symbols", "symbols", ">", 0.4),
    ("no_prose", "stop_words", "<", 0.02),
    ("very_short", "words", "<", 5),
)


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def earlier_equal(values: Column) -> Column:
    """Ascending 0-based positions of the elements that are equal to an element before them."""

    def later(at: Column) -> Column:
        again = F.filter(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.get(at, k).getField("v") == F.get(at, k - 1).getField("v"))
        return F.array_sort(F.transform(again, lambda k: F.get(at, k).getField("i")))

    placed = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.when(F.size(values) > 1, bind(placed, later)).otherwise(F.array().cast("array<int>"))


def repeated_word_count(words: Column, window: int = WINDOW) -> Column:
    """How many elements lie in `window` consecutive ones that also begin earlier."""

    def covered(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        windows = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(window)]))
        # Each repeated window adds what it reaches beyond the next one's beginning; the last adds all of it.
        count = bind(earlier_equal(windows), lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))), F.lit(0), lambda total, x: total + x))
        # Equal windows have equal hashes: where no two hashes agree, nothing is repeated and nothing need be sorted.
        agree = bind(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(agree, count).otherwise(0)

    return F.when(F.size(words) > window, bind(words, covered)).otherwise(0)


def measures(text: Column, window: int = WINDOW) -> dict[str, Column]:
    words = text_words(text)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda line: F.trim(line) != "")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    return {
        "chars": F.char_length(F.coalesce(text, F.lit(""))),
        "words": F.coalesce(F.size(words), F.lit(0)),
        "repeated_words": F.coalesce(bind(words, lambda w: share(repeated_word_count(w, window), F.size(w))), F.lit(0.0)),
        "repeated_lines": bind(lines, lambda x: share(F.size(earlier_equal(F.transform(x, F.trim))), F.size(x))),
        "symbols": F.coalesce(share(F.char_length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")), F.char_length(text)), F.lit(0.0)),
        "stop_words": F.coalesce(bind(words, lambda w: share(F.size(F.filter(w, lambda x: F.array_contains(stop, x))), F.size(w))), F.lit(0.0)),
    }


def compiled(thresholds: tuple[tuple[str, str, str, float], ...] = THRESHOLDS) -> dict[str, Column]:
    """The threshold table as flag columns over the measures' columns."""
    compare = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__}
    return {flag: compare[op](F.col(measure), F.lit(value)) for flag, measure, op, value in thresholds}


def repetition(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the measures and the flags of each document, null and empty texts included."""
    measured = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), *[c.alias(name) for name, c in measures(F.col(f"`{text}`")).items()])
    return measured.withColumns(compiled())


def self_repeating(documents: DataFrame) -> DataFrame:
    """doc_id of the documents in which at least half of the words are repeated."""
    return repetition(documents).where("repeats_itself").select("doc_id")
