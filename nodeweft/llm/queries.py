"""The queries of this package, by the names of their problems, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweft.sources.tables import table

from . import authored, conversations, doc_pairs, mixing, neighbours, pair_defects, repetition, terms, tokens


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return authored.foreign_files(table(spark, folder, "files", "file", "content", "indexed_at"))


def p1_labels(spark: SparkSession, folder: str) -> DataFrame:
    return authored.file_labels(table(spark, folder, "files", "file", "content", "indexed_at")).withColumn("p_handwritten", F.round("p_handwritten", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.marking_terms(table(spark, folder, "nodes")).select("node_id", "term")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = terms.distinctive_terms(terms.node_terms(table(spark, folder, "nodes")), "node_id")
    return scored.withColumn("z", F.round("z", 6))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defective(table(spark, folder, "messages"))


def p3_defects(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defective(table(spark, folder, "messages"), every=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.whole_conversations(table(spark, folder, "messages"), table(spark, folder, "chats"))


def p4_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversation_turns(table(spark, folder, "messages"), table(spark, folder, "chats"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_nodes(table(spark, folder, "nodes", "id", "embedding", "indexed_at")).select("node_a", "node_b")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return doc_pairs.documented_functions(table(spark, folder, "files"), code=False).select("node_id")


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    indexed = table(spark, folder, "nodes", "id").distinct().select(F.col("id").alias("node_id"), F.lit(True).alias("indexed"))
    return doc_pairs.documented_functions(table(spark, folder, "files")).join(indexed, "node_id", "left").fillna(False, ["indexed"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.with_token_ids(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "ids")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.document_sizes(table(spark, folder, "documents", "doc_id", "source", "text"))
    return mixing.mixture(sizes, mixing.rates(sizes, table(spark, folder, "mix_targets")))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.document_sizes(table(spark, folder, "documents", "doc_id", "source", "text"))
    rated = mixing.rates(sizes, table(spark, folder, "mix_targets"))
    return mixing.shares(mixing.mixture(sizes, rated), rated)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.self_repeating(table(spark, folder, "documents", "doc_id", "text"))


def p9_repetition(spark: SparkSession, folder: str) -> DataFrame:
    report = repetition.repetition(table(spark, folder, "documents", "doc_id", "text"))
    return report.withColumns({c: F.round(c, 6) for c in ("repeated_words", "repeated_lines", "symbols", "stop_words")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_labels, p2_found, p2_scores, p3_found, p3_defects, p4_found, p4_turns, p5_found, p6_found, p6_pairs, p7_ids, p8_mixture, p8_shares, p9_found, p9_repetition)}
