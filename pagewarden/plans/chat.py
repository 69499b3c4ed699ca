"""Chat: gate each message, answer the safe ones, keep a transcript."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.constants import DEFAULT_K, DEFAULT_THRESHOLD
from pagewarden.functions.phrases import PhraseList
from pagewarden.functions.pii import RULES, Rule
from pagewarden.functions.prompts import prompt_template
from pagewarden.operators.chat import latest_messages
from pagewarden.operators.models import answer_with, best_hit_answer
from pagewarden.operators.screening import gate_messages
from pagewarden.plans.ask import answer, prompts, retrieve
from pagewarden.session import fresh_path

TRANSCRIPT = ["message_id", "role", "content"]


def _staged(gated: DataFrame) -> DataFrame:
    """The gate's rows as a table: warnings and answers both start from them, screened once."""
    path = fresh_path(gated.sparkSession, "gated")
    gated.write.parquet(path)
    return gated.sparkSession.read.schema(gated.schema).parquet(path)


def converse(
    messages: DataFrame,
    records: DataFrame,
    k: int = DEFAULT_K,
    threshold: float = DEFAULT_THRESHOLD,
    rules: Iterable[Rule | PhraseList] = RULES,
    load: Callable | None = None,
    **options,
) -> DataFrame:
    """Transcript of (message_id, text[, unique_ids]) rows.

    A message with personal data becomes a `pii_warning` and reaches neither the
    index nor a model. Any other becomes a `user` row, answered by an `assistant`
    row from the tenants it may see.
    """
    gated = _staged(gate_messages(messages, threshold, rules=list(rules)))
    safe = gated.where("role = 'user'").withColumnsRenamed(
        {"message_id": "question_id", "content": "question"}
    )
    questions = safe.drop("role")
    answered = answer(questions, retrieve(records, questions, k), load, **options)
    replies = answered.select(
        F.col("question_id").alias("message_id"),
        F.lit("assistant").alias("role"),
        F.col("answer").alias("content"),
    )
    return gated.select(*TRANSCRIPT).unionByName(replies)


def converse_with_history(
    conversations: DataFrame,
    records: DataFrame,
    template: str,
    k: int = DEFAULT_K,
    threshold: float = DEFAULT_THRESHOLD,
    rules: Iterable[Rule | PhraseList] = RULES,
    load: Callable | None = None,
    **options,
) -> DataFrame:
    """The latest user message of each conversation, gated and answered with all turns before it.

    (conv_id, turn, role, content, prompt): an `assistant` row whose prompt holds the system
    `template` with its `{context}`, the history and the message; or a `pii_warning`, which
    reaches neither the index nor a model. The history was gated when it was said.
    """
    gated = _staged(gate_messages(latest_messages(conversations), threshold, rules=list(rules)))
    safe = gated.where("role = 'user'").select(
        F.col("conv_id").alias("question_id"), F.col("content").alias("question"), "turn", "history"
    )
    questions = safe.select("question_id", "question")
    asked = prompts(safe, retrieve(records, questions, k))
    messages = prompt_template(template, {"context": F.col("context")}, F.col("question"), F.col("history"))
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    asked = asked.withColumn("prompt", F.array_join(lines, "\n"))
    answered = answer_with(asked, load, **options) if load else asked.withColumn("answer", best_hit_answer())
    replies = answered.select(
        F.col("question_id").alias("conv_id"),
        "turn",
        F.lit("assistant").alias("role"),
        F.col("answer").alias("content"),
        "prompt",
    )
    warned = gated.where("role = 'pii_warning'").select("conv_id", "turn", "role", "content")
    return replies.unionByName(warned.withColumn("prompt", F.lit(None).cast("string")))
