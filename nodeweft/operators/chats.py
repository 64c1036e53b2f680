"""Chats and their messages as tables: each change gives new tables, which the caller writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweft.functions.text import chat_title


def create_chat(chats: DataFrame, repo_db_path: str, title: str = "", now: float | None = None, chat_id: str | None = None) -> DataFrame:
    spark = chats.sparkSession
    stamp = F.lit(float(now)) if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
    new = spark.range(1).select(F.lit(chat_id) if chat_id else F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("id"), F.lit(repo_db_path), F.lit(title), stamp, stamp)
    return chats.unionByName(new.toDF("id", "repo_db_path", "title", "created_at", "updated_at"))


def get_chat(chats: DataFrame, chat_id: str) -> DataFrame:
    return chats.where(F.col("id") == chat_id)


def list_chats(chats: DataFrame, repo_db_path: str) -> DataFrame:
    """A repository's chats, the latest change first."""
    return chats.where(F.col("repo_db_path") == repo_db_path).orderBy(F.desc("updated_at"), "id")


def chat_messages(messages: DataFrame, chat_id: str) -> DataFrame:
    return messages.where(F.col("chat_id") == chat_id).orderBy("seq", "id")


def next_seq(messages: DataFrame) -> DataFrame:
    """(chat_id, next_seq): the number that the next message of each chat gets."""
    return messages.groupBy("chat_id").agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))


def add_message(chats: DataFrame, messages: DataFrame, chat_id: str, question: str, answer: str, now: float, type_: str = "answer", detail: str = "", image_data_url: str | None = None, title: str = "", context_question: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) with one more turn; the chat's title is kept, else taken from `title`, else from the question.
    An unknown chat is an error."""
    if not get_chat(chats, chat_id).take(1):
        raise ValueError(f"no chat {chat_id}")
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.max(F.when(F.col("chat_id") == chat_id, F.col("seq"))), F.lit(-1)).alias("seq"))
    row = top.select(
        (F.col("top") + 1).alias("id"), F.lit(chat_id).alias("chat_id"), (F.col("seq") + 1).alias("seq"), F.lit(question).alias("question"), F.lit(answer).alias("answer"), F.lit(type_).alias("type"), F.lit(detail).alias("detail"),
        F.lit(image_data_url).cast("string").alias("image_data_url"), F.lit(context_question or question).alias("context_question"), F.lit(float(now)).alias("created_at"),
    )
    here = F.col("id") == chat_id
    named = F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.lit(title), F.lit("")), chat_title(F.lit(question)))
    changed = chats.withColumns({"title": F.when(here, named).otherwise(F.col("title")), "updated_at": F.when(here, F.lit(float(now))).otherwise(F.col("updated_at"))})
    return changed, messages.unionByName(row)


def delete_chat(chats: DataFrame, messages: DataFrame, chat_id: str) -> tuple[DataFrame, DataFrame]:
    return chats.where(~F.col("id").eqNullSafe(chat_id)), messages.where(~F.col("chat_id").eqNullSafe(chat_id))


def delete_message(messages: DataFrame, chat_id: str, seq: int) -> DataFrame:
    """Without one turn; its number stays a gap, unless it was the last."""
    return messages.where(~(F.col("chat_id").eqNullSafe(chat_id) & F.col("seq").eqNullSafe(seq)))


def registered(registry: DataFrame) -> DataFrame:
    """The repositories by path, the last registration of each."""
    from nodeweft.operators.rows import latest_rows

    return latest_rows(registry, ["db_path"], ["added_at"])


def titles(messages: DataFrame) -> DataFrame:
    """(chat_id, title): the title that each chat's first turn gives it."""
    first = messages.where(F.col("chat_id").isNotNull()).groupBy("chat_id").agg(F.min_by("question", F.struct(F.coalesce("seq", F.lit(1 << 62)), "id")).alias("q"))
    return first.select("chat_id", chat_title(F.col("q")).alias("title"))
