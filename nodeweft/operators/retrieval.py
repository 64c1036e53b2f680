"""Ranking of texts and vectors for a question."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from nodeweft.functions.text import tokens
from nodeweft.operators.rows import broadcast_if_small
from nodeweft.session import stage

TOP = 15
#: Terms up to this number (about 40 bytes each) are broadcast to the postings.
VOCABULARY_ROWS = 500_000
DIMENSIONS = 384


def term_frequencies(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """(doc, t, tf)"""
    return docs.select(F.col(doc_id).alias("doc"), F.explode(tokens(text)).alias("t")).groupBy("doc", "t").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(t, df)"""
    return tf.groupBy("t").agg(F.count("*").alias("df"))


def tfidf_rank(docs: DataFrame, doc_id: str, text: Column, question: str, k: int = TOP, order: str | None = None) -> DataFrame:
    """(doc, score): the k documents most similar to the question by the cosine of tf x ln((n + 1) / (df + 1)), scores over
    0 only, ties (in twelve decimals) in the order of `order` (default: the id). A question without tokens gives no rows.

    Texts are split once, into a table of term counts. The vocabulary is broadcast if it is small, so postings don't move
    again; norms and dot products are then summed within each task, and few rows per document leave it.
    """
    spark = docs.sparkSession
    tf = stage(term_frequencies(docs, doc_id, text), "postings")
    n = F.lit(docs.count())
    df = stage(document_frequencies(tf), "vocabulary")
    asked = spark.range(1).select(F.explode(tokens(F.lit(question))).alias("t")).groupBy("t").agg(F.count("*").alias("qf"))
    weight = F.ln((n + 1) / (F.coalesce("df", F.lit(0)) + 1))
    q = asked.join(df, "t", "left").select("t", (F.col("qf") * weight).alias("wq"))
    weighted = df.join(F.broadcast(q), "t", "left").select("t", weight.alias("w"), "wq")
    d = tf.join(broadcast_if_small(weighted, VOCABULARY_ROWS), "t").select("doc", (F.col("tf") * F.col("w")).alias("wd"), "wq")
    scored = d.groupBy("doc").agg(F.sqrt(F.sum(F.col("wd") * F.col("wd"))).alias("dn"), F.sum(F.col("wd") * F.col("wq")).alias("dot"))
    qn = F.broadcast(q.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qn")))
    one = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(c)
    score = F.col("dot") / (one(F.col("qn")) * one(F.col("dn")))
    ranked = scored.where(F.col("dot") > 0).join(qn).select("doc", F.round(score, 12).alias("score"))
    if order:
        ranked = ranked.join(docs.select(F.col(doc_id).alias("doc"), F.col(order).alias("_o")), "doc").orderBy(F.desc("score"), "_o").limit(k).drop("_o")
        return ranked
    return ranked.orderBy(F.desc("score"), "doc").limit(k)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine of an array column and a given vector; null for a missing vector or one of another length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    double = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: double(a) * b), F.lit(0.0), lambda t, x: t + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + double(x) * double(x)))
    length = float(np.linalg.norm(np.asarray(query, dtype=np.float64))) or 1.0
    return F.when(F.size(vector) == len(query), 1 - dot / (F.when(norm == 0, 1.0).otherwise(norm) * length))


def vector_topk(rows: DataFrame, row_id: str, vector: str, query: list[float], k: int = TOP) -> DataFrame:
    """(id, distance) of the k nearest rows, exactly: one scan, each task keeps k."""
    return rows.select(F.col(row_id).alias("id"), cosine_distance(F.col(vector), query).alias("distance")).where(F.col("distance").isNotNull()).orderBy("distance", "id").limit(k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, k: int = TOP) -> DataFrame:
    """(label, rank): text hits (label, rank) in their order, then vector hits not among them, cut at k."""
    both = text_hits.select("label", F.lit(0).alias("s"), "rank").unionByName(vector_hits.select("label", F.lit(1).alias("s"), "rank"))
    firsts = both.groupBy("label").agg(F.min(F.struct("s", "rank")).alias("f"))
    top = firsts.orderBy("f.s", "f.rank", "label").limit(k)
    # At most k rows are left here.
    return top.select("label", F.row_number().over(Window.orderBy("f.s", "f.rank", "label")).alias("rank"))


def hashed_embedding(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """A deterministic bag-of-words vector of length one. It stands in for a sentence model, which it doesn't equal.

    A word adds 1 or -1 in a dimension: the first 15 hexadecimal digits of its MD5 give the dimension by their remainder, and
    the sign by whether the quotient is even.
    """
    v = np.zeros(dimensions)
    for word in re.findall(r"[a-z0-9]+", (text or "").lower()) or ["(no", "description)"]:
        turns, place = divmod(int(hashlib.md5(word.encode()).hexdigest()[:15], 16), dimensions)
        v[place] += -1.0 if turns % 2 else 1.0
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist()


def embed(text: Column, model=hashed_embedding) -> Column:
    """Vectors of texts by `model`, a function of one text; blank texts count as "(no description)"."""

    @arrow_udf(T.ArrayType(T.FloatType(), False))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model(t if t and t.strip() else "(no description)") for t in texts.to_pylist()], type=pa.list_(pa.float32()))

    return run(text)
