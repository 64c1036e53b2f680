"""Problem 2: how distinctive a term is for a record, against all the other records.

Method: log-odds ratio with an informative Dirichlet prior. For a term with count y in a record of n words and Y in the
whole collection of N words, with the prior a = prior_weight x Y / N and a0 = prior_weight:

    delta = log((y + a) / (n + a0 - y - a)) - log((Y - y + a) / (N - n + a0 - (Y - y) - a))
    z     = delta / sqrt(1 / (y + a) + 1 / (Y - y + a))

A term that all records share has a delta near 0; the standard error keeps a term met once below one met often.

Counts within a record need no shuffle: a record's words are sorted and counted in their row, once, into a table that the
statistics and the scores both read. Only the collection counts are aggregated by term, after partial aggregation in each
task, so a term held by a third of all records moves one row per task. The join of records with the counts is by term;
adaptive execution splits the partitions of hot terms.

Defined results: a null or empty text has no words; a record without words has no rows; equal rows of one id must have
been reduced before (see `latest_rows`); in a collection of one record z is the score against an empty rest, in one of a single term it is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweft.operators.rows import counted, latest_rows
from nodeweft.session import stage

#: Words under this length don't count.
LEAST_LETTERS = 3


def words(text: Column, least: int = LEAST_LETTERS) -> Column:
    """Runs of letters, also broken between a-z and a following A-Z, in lower case, of at least `least` letters."""
    broken = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])(?=[A-Z])", "$1 ")
    return F.filter(F.regexp_extract_all(F.lower(broken), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.char_length(w) >= least)


def term_counts(records: DataFrame, record_id: str, text: Column) -> DataFrame:
    """(record id, term, tf, n): each distinct word of each record, with its count and the record's word count."""
    split = records.select(F.col(f"`{record_id}`").alias(record_id), words(text).alias("_words"))
    runs = split.where(F.size("_words") > 0).select(record_id, F.size("_words").alias("n"), F.explode(counted(F.col("_words"))).alias("_t"))
    return runs.select(record_id, F.col("_t.term").alias("term"), F.col("_t.tf").cast("long").alias("tf"), F.col("n").cast("long").alias("n"))


def distinctive_terms(counts: DataFrame, record_id: str, prior_weight: float = 500.0, least_tf: int = 1) -> DataFrame:
    """(record id, term, tf, df, z) for each row of `counts` with tf >= least_tf; the statistics cover all rows."""
    counts = stage(counts, "term-counts")
    collection = stage(counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")), "terms")
    total = collection.agg(F.sum("cf")).scalar().cast("double")
    y, n, rest = F.col("tf").cast("double"), F.col("n").cast("double"), (F.col("cf") - F.col("tf")).cast("double")
    prior = F.lit(prior_weight) * F.col("cf") / total
    delta = F.ln((y + prior) / (n + prior_weight - y - prior)) - F.ln((rest + prior) / (total - n + prior_weight - rest - prior))
    # Where all words of the collection are one term, nothing sets it apart.
    z = F.when(F.col("cf") < total, delta / F.sqrt(1 / (y + prior) + 1 / (rest + prior))).otherwise(0.0)
    return counts.where(F.col("tf") >= least_tf).join(collection, "term").select(record_id, "term", "tf", "df", z.alias("z"))


def node_terms(nodes: DataFrame) -> DataFrame:
    """Term counts of the current Function nodes (name and docstring) and Class nodes (docstring) as node_id."""
    now = latest_rows(nodes.select("id", "kind", "name", "docstring", "indexed_at"), ["id"], ["indexed_at"], ["kind", "name", "docstring"])
    text = F.when(F.col("kind") == "Function", F.concat_ws(" ", "name", "docstring")).otherwise(F.col("docstring"))
    return term_counts(now.where(F.col("kind").isin("Function", "Class") & F.col("id").isNotNull()).withColumnRenamed("id", "node_id"), "node_id", text)


def marking_terms(nodes: DataFrame, least_tf: int = 2, least_df: int = 2, most_df: int = 12) -> DataFrame:
    """(node_id, term, tf, df, z) of the words that a node repeats and few nodes share: all scored words that a node repeats,
    checked by their exact counts."""
    scored = stage(distinctive_terms(node_terms(nodes), "node_id", least_tf=least_tf), "scored-terms")
    return scored.where(F.col("df").between(least_df, most_df))
