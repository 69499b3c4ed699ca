"""Conversations: message lists for a model, session counters, clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_rows(
    conversations: DataFrame,
    system_prompt: str | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
) -> DataFrame:
    """Message list for the latest user message of each conversation, a row per message.

    (conversation, turn, role, content); the system prompt stands at turn -1, the
    current message has `is_current`. Rows, not one array per conversation: a
    conversation of any length passes through without being gathered, and the
    earlier turns are not repeated for every later one.
    """
    role = F.lower("role")
    last = (
        conversations.where(role == "user")
        .groupBy(conversation)
        .agg(F.max(turn).alias("_last"))
    )
    turns = conversations.where(role.isin("user", "assistant")).join(last, conversation)
    is_current = F.col(turn) == F.col("_last")
    own = F.struct(
        F.col(turn).cast("bigint").alias(turn),
        role.alias("role"),
        F.col("text").alias("content"),
        is_current.alias("is_current"),
    )
    listed = turns.where(F.col(turn) <= F.col("_last"))
    if not system_prompt:
        return listed.select(conversation, F.inline(F.array(own)))
    opening = F.struct(
        F.lit(-1).cast("bigint").alias(turn),
        F.lit("system").alias("role"),
        F.lit(system_prompt).alias("content"),
        F.lit(False).alias("is_current"),
    )
    # Each conversation has one current message; the opening comes out beside it.
    with_opening = F.when(is_current, F.array(opening, own)).otherwise(F.array(own))
    return listed.select(conversation, F.inline(with_opening))


def latest_messages(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """(conversation, turn, text, history): the latest user message of each conversation.

    The history is the array of all user and assistant turns before it, in order. One
    message per conversation, so that the arrays together are as long as the table.
    """
    listed = message_rows(conversations, None, conversation, turn)
    before = F.struct(F.col(turn), "role", "content")
    found = listed.groupBy(conversation).agg(
        F.max(turn).alias(turn),
        F.first(F.when(F.col("is_current"), F.col("content")), ignorenulls=True).alias("text"),
        F.array_sort(F.collect_list(F.when(~F.col("is_current"), before))).alias("_before"),
    )
    history = F.transform("_before", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return found.select(conversation, turn, "text", history.alias("history"))


def session_info(messages: DataFrame, documents: DataFrame, session: str = "session") -> DataFrame:
    """Messages and documents of each session; each table is counted before they meet."""
    counted = messages.groupBy(session).agg(F.count(F.lit(1)).alias("n_messages"))
    uploaded = documents.groupBy(session).agg(F.count(F.lit(1)).alias("n_documents"))
    joined = counted.join(uploaded, session, "full")
    return joined.select(
        session,
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
    )


def clear_sessions(rows: DataFrame, cleared: DataFrame, session: str = "session") -> DataFrame:
    """Rows of the sessions that are kept."""
    return rows.join(cleared.select(session).distinct(), session, "left_anti")
