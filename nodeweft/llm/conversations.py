"""Problem 4: conversations rebuilt from message rows.

One row is a turn: a question by the user and an answer by the assistant, each with a stamp of its sender's clock; d is by
how much the assistant's is ahead. What must hold is that an answer comes after its question and the next question after
that answer:

    question_i <= answer_i - d    and    answer_i - d <= question_(i+1)

so every turn bounds d from above by u = answer_i - question_i and from below by l = answer_i - question_(i+1). The least
squares estimate is the d with the smallest sum of squared violations of these bounds. With max(l) <= min(u) some d violates
none; the one nearest to 0 is taken (clocks are believed unless they contradict). Otherwise the residual is positive, no
offset orders the conversation, and it is rejected; the exact minimum is reported (`least_squares`). Answers are stamped
anew by answer - d, and the user's and the assistant's messages, each in order of seq, are merged by stamp.

Messages of one sender each (a column that names the sender) become turns by `paired`. Where a row has one stamp for both
senders, as in the project's tables, all u are 0 and the l are the steps back from turn to turn, so the estimate of a kept
conversation is 0.

Turns are ordered within blocks of consecutive seq numbers, and the blocks are merged by their first and last stamps: no
task sorts more than a block, and a chat that holds a third of all rows is spread over many. Only the finished list of a
conversation, which is one row by definition, comes together in one place, and for a rejected one those bounds that can
be violated at the minimum.

Rejected: chats without messages or not in the chats table, any row with a null or negative seq, infeasible order, an
empty answer (see pair_defects), a turn whose question and context question hold no visible text.

Defined results: of rows of one chat and seq the latest question stamp holds, then the greatest id; a null stamp counts as
before any other; a conversation that keeps one where an order is asked for is infeasible, and its estimate is that of the
other bounds; without any bound the estimate is 0; rows with a null chat belong to no conversation; gaps in seq are
allowed; equal rows count once; an empty table gives no conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .pair_defects import _INVISIBLE, is_empty, stored_answer

#: Consecutive seq numbers that are ordered together.
BLOCK = 1024
_UNSEEN = "".join(f"\\x{{{ord(c):x}}}" for c in _INVISIBLE)


def _judged(test) -> object:
    @arrow_udf(T.BooleanType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([test(t) for t in texts.to_pylist()], type=pa.bool_())

    return judge


def _lacks_answer(text: str | None) -> bool:
    answer, broken = stored_answer(text)
    return not broken and is_empty(answer)


def answer_is_empty(text: Column) -> Column:
    return _judged(_lacks_answer)(text)


def is_visible(text: Column) -> Column:
    """Whether anything is left of a text without invisible characters."""
    return F.coalesce(text.rlike(f"[^{_UNSEEN}]"), F.lit(False))


def _stamp(column: str) -> Column:
    """A stamp in seconds; what isn't a number counts as missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def paired(rows: DataFrame, sender: str = "sender", text: str = "text", at: str = "created_at", user: str = "user", assistant: str = "assistant") -> DataFrame:
    """Turns of rows that hold one sender's message each: id, chat_id, seq, question, answer, context_question, asked_at,
    answered_at. Of several rows of a sender and turn the latest holds, then the greatest id; other senders are left out."""

    def said(who: str, value: str):
        return F.max_by(F.when(F.col(sender) == who, F.col(value)), F.when(F.col(sender) == who, F.struct(F.coalesce(F.col(at).cast("double"), F.lit(float("-inf"))), F.col("id"))))

    both = rows.where(F.col(sender).isin(user, assistant)).groupBy("chat_id", "seq")
    return both.agg(
        F.min("id").alias("id"), said(user, text).alias("question"), said(assistant, text).alias("answer"), F.lit(None).cast("string").alias("context_question"), said(user, at).alias("asked_at"), said(assistant, at).alias("answered_at")
    )


def turns(messages: DataFrame, asked_at: str = "created_at", answered_at: str = "created_at") -> DataFrame:
    """One row per chat and seq: the row that holds, reduced to id, both stamps and whether the turn can be read."""
    flagged = messages.where(F.col("chat_id").isNotNull()).select(
        "chat_id",
        "seq",
        "id",
        _stamp(asked_at).alias("q"),
        _stamp(answered_at).alias("a"),
        (answer_is_empty(F.col("answer")) | ~(is_visible(F.col("question")) | is_visible(F.col("context_question")))).alias("unusable"),
    )
    held = F.max_by(F.struct("id", "q", "a", "unusable"), F.struct(F.coalesce("q", F.lit(float("-inf"))), "id"))
    return flagged.groupBy("chat_id", "seq").agg(held.alias("t")).select("chat_id", "seq", "t.*")


def _following(answers: Column, questions: Column) -> Column:
    """The bounds from below: answer_i - question_(i+1), infinite where a stamp is missing."""
    count = F.size(answers) - 1
    steps = F.zip_with(F.slice(answers, 1, count), F.slice(questions, 2, count), lambda a, q: F.coalesce(a - q, F.lit(float("inf"))))
    return F.when(count > 0, steps).otherwise(F.array().cast("array<double>"))


def least_squares(uppers: Column, lowers: Column) -> Column:
    """The d with the smallest sum of (d - u)^2 over uppers u < d and (l - d)^2 over lowers l > d.

    Bounds are crossed in ascending order, an upper one becoming active and a lower one ceasing to be; between two of them
    the active ones don't change, and the minimum is their mean as soon as that lies before the next bound.
    """
    finite = lambda c: F.filter(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    edges = F.array_sort(F.concat(F.transform(finite(uppers), lambda x: F.struct(x.alias("b"), F.lit(1).alias("k"))), F.transform(finite(lowers), lambda x: F.struct(x.alias("b"), F.lit(-1).alias("k")))))
    start = F.struct(F.size(finite(lowers)).cast("double").alias("n"), F.aggregate(finite(lowers), F.lit(0.0), lambda t, x: t + x).alias("s"), F.lit(None).cast("double").alias("d"))

    def cross(state: Column, edge: Column) -> Column:
        mean = state["s"] / F.nullif(state["n"], F.lit(0.0))
        settled = F.when(state["d"].isNotNull(), state["d"]).when(mean <= edge["b"], mean)
        return F.struct((state["n"] + edge["k"]).alias("n"), (state["s"] + edge["k"] * edge["b"]).alias("s"), settled.alias("d"))

    return F.aggregate(edges, start, cross, lambda state: F.coalesce(state["d"], state["s"] / F.nullif(state["n"], F.lit(0.0)), F.lit(0.0)))


def conversations(messages: DataFrame, chats: DataFrame, block: int = BLOCK, asked_at: str = "created_at", answered_at: str = "created_at") -> DataFrame:
    """One row per chat with messages: chat_id, ids, turns, low and high (the bounds of the offset), offset, why it is
    rejected (null where it is whole). The offset of a chat in infeasible order is null here, see `clock_offsets`."""
    merged = _merged(turns(messages, asked_at, answered_at), block)
    known = chats.where(F.col("id").isNotNull()).select(F.col("id").alias("chat_id"), F.lit(True).alias("known")).distinct()
    # The residual is 0 just where some offset lies between the bounds.
    feasible = F.col("low") <= F.col("high")
    why = (
        F.when(F.col("known").isNull(), "unknown chat")
        .when(F.col("unplaced"), "row without place")
        .when(~feasible, "infeasible order")
        .when(F.col("unusable"), "empty or unasked turn")
    )
    offset = F.when(feasible, F.greatest(F.col("low"), F.least(F.lit(0.0), F.col("high"))))
    return merged.join(known, "chat_id", "left").select("chat_id", "ids", "turns", "low", "high", offset.alias("offset"), why.alias("rejected"))


def _blocks(held: DataFrame, block: int) -> DataFrame:
    """Turns in order within blocks of consecutive seq numbers, with the bounds that lie within each."""
    rows = held.groupBy("chat_id", F.floor(F.col("seq") / block).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "q", "a", "id"))).alias("t"), F.max("unusable").alias("unusable"), F.max(F.coalesce(F.col("seq") < 0, F.lit(True))).alias("unplaced")
    )
    return rows.withColumns({"uppers": F.zip_with("t.a", "t.q", lambda a, q: a - q), "lowers": _following(F.col("t.a"), F.col("t.q")), "first": F.get("t.q", F.lit(0)), "last": F.element_at("t.a", -1)})


def _merged(held: DataFrame, block: int) -> DataFrame:
    none, all_ = F.lit(float("-inf")), F.lit(float("inf"))
    blocks = _blocks(held, block).select(
        "chat_id", "block", "unusable", "unplaced", "first", "last", F.size("t").alias("n"), F.coalesce(F.array_max("lowers"), none).alias("low"), F.coalesce(F.array_min("uppers"), all_).alias("high"), F.array_join(F.transform("t.id", lambda i: i.cast("string")), ",").alias("ids")
    )
    whole = blocks.groupBy("chat_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "first", "last", "ids"))).alias("b"), F.max("unusable").alias("unusable"), F.max("unplaced").alias("unplaced"), F.sum("n").alias("turns"), F.max("low").alias("low"), F.min("high").alias("high")
    )
    between = F.coalesce(F.array_max(_following(F.col("b.last"), F.col("b.first"))), none)
    return whole.select("chat_id", "unusable", "unplaced", "turns", F.greatest("low", between).alias("low"), "high", F.array_join("b.ids", ",").alias("ids"))


def clock_offsets(messages: DataFrame, chats: DataFrame, block: int = BLOCK, asked_at: str = "created_at", answered_at: str = "created_at") -> DataFrame:
    """(chat_id, offset, residual): the least squares estimate of each chat's clock offset, and the sum of squared
    violations that it leaves."""
    judged = conversations(messages, chats, block, asked_at, answered_at).select("chat_id", "low", "high", "offset")
    blocks = _blocks(turns(messages, asked_at, answered_at), block).join(judged.where("low > high").select("chat_id", "low", "high"), "chat_id")
    # At the minimum, which lies between high and low, no other bounds are violated.
    blocks = blocks.withColumns({"uppers": F.filter("uppers", lambda x: x < F.col("low")), "lowers": F.filter("lowers", lambda x: x > F.col("high"))})
    parts = blocks.groupBy("chat_id", "low", "high").agg(F.array_sort(F.collect_list(F.struct("block", "first", "last", "uppers", "lowers"))).alias("b"))
    parts = parts.withColumn("across", F.filter(_following(F.col("b.last"), F.col("b.first")), lambda x: x > F.col("high")))
    bounds = parts.select("chat_id", F.flatten("b.uppers").alias("uppers"), F.concat(F.flatten("b.lowers"), "across").alias("lowers"))
    solved = bounds.withColumn("d", least_squares(F.col("uppers"), F.col("lowers")))
    squares = lambda c, over: F.aggregate(F.filter(c, lambda x: F.abs(x) < float("inf")), F.lit(0.0), lambda t, x: t + F.pow(F.greatest(over(x), F.lit(0.0)), F.lit(2.0)))
    residual = squares("uppers", lambda u: F.col("d") - u) + squares("lowers", lambda low: low - F.col("d"))
    solved = solved.select("chat_id", "d", residual.alias("r"))
    return judged.join(solved, "chat_id", "left").select("chat_id", F.coalesce("offset", "d").alias("offset"), F.coalesce("r", F.lit(0.0)).alias("residual"))


def whole_conversations(messages: DataFrame, chats: DataFrame, **stamps: str) -> DataFrame:
    """(chat_id, ids) of the conversations that some clock offset orders and that nothing else rejects."""
    return conversations(messages, chats, **stamps).where(F.col("rejected").isNull()).select("chat_id", "ids")


def conversation_turns(messages: DataFrame, chats: DataFrame, asked_at: str = "created_at", answered_at: str = "created_at") -> DataFrame:
    """The messages of whole conversations as rows with speaker roles: chat_id, seq, at, turn (0 user, 1 assistant), role,
    text. `at` is by the user's clock: answers are corrected by the estimated offset, so the order by at, seq and turn
    merges both senders' messages."""
    kept = conversations(messages, chats, asked_at=asked_at, answered_at=answered_at).where(F.col("rejected").isNull()).select("chat_id", "offset")
    rows = messages.select("chat_id", "seq", "id", "question", "context_question", "answer", _stamp(asked_at).alias("q"), _stamp(answered_at).alias("a")).join(kept, "chat_id")
    held = F.max_by(F.struct("id", "question", "context_question", "answer", "q", "a"), F.struct(F.coalesce("q", F.lit(float("-inf"))), "id"))
    rows = rows.groupBy("chat_id", "seq", "offset").agg(held.alias("m")).select("chat_id", "seq", "offset", "m.*")
    asked = F.when(is_visible(F.col("question")), F.col("question")).otherwise(F.col("context_question"))
    parts = F.array(
        F.struct(F.col("q").alias("at"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("asked").alias("text")),
        F.struct((F.col("a") - F.col("offset")).alias("at"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )
    return rows.withColumn("asked", asked).select("chat_id", "seq", F.inline(parts))
