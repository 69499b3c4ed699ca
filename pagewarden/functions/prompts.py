"""Prompt and message texts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.constants import ANSWER_PROMPT, ENRICH_PROMPT, UNKNOWN

MESSAGE_LIST = "array<struct<role:string,content:string>>"


def fill(template: str, **values: Column) -> Column:
    """Text with each `{name}` exchanged for a column.

    The template is cut at its places first, so braces inside a value are
    never taken for a place.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in values]
        places = [place for place in places if place[0] >= 0]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def enrich_prompt(metadata: Column, text: Column) -> Column:
    return fill(ENRICH_PROMPT, metadata=metadata, text=text)


def answer_prompt(context: Column, question: Column) -> Column:
    return fill(ANSWER_PROMPT, context=context, question=question)


def context_text(hits: Column) -> Column:
    """One text for an array of hits ordered by rank.

    Each hit is a struct with `file_path`, `page_number` and `llm_generated`.
    """
    blocks = F.transform(
        hits,
        lambda hit, i: F.concat(
            F.lit("\nDocument "),
            (i + 1).cast("string"),
            F.lit(":\nSource: "),
            F.coalesce(hit["file_path"], F.lit(UNKNOWN)),
            F.lit("\nPage: "),
            F.coalesce(hit["page_number"], F.lit(UNKNOWN)),
            F.lit("\nContent: "),
            F.coalesce(hit["llm_generated"], F.lit("")),
            F.lit("\n"),
        ),
    )
    return F.coalesce(F.array_join(blocks, ""), F.lit(""))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def message_list(
    message: Column, system_prompt: Column | None = None, history: Column | None = None
) -> Column:
    """System prompt if any, user and assistant turns of the history, then the message.

    A turn keeps its own role; turns of other roles are left out.
    """
    parts = []
    if system_prompt is not None:
        none = F.array().cast(MESSAGE_LIST)
        given = F.length(F.coalesce(system_prompt, F.lit(""))) > 0
        parts.append(F.when(given, F.array(_message("system", system_prompt))).otherwise(none))
    if history is not None:
        kept = F.filter(history, lambda m: F.lower(m["role"]).isin("user", "assistant"))
        as_messages = F.transform(
            kept,
            lambda m: F.struct(F.lower(m["role"]).alias("role"), m["content"].alias("content")),
        )
        parts.append(F.coalesce(as_messages, F.array().cast(MESSAGE_LIST)))
    parts.append(F.array(_message("user", message)))
    return F.concat(*parts)


def prompt_template(
    template: str,
    variables: Mapping[str, Column],
    user_input: Column,
    history: Column | None = None,
) -> Column:
    """Message list of a template with named places, an optional history and the input."""
    return message_list(user_input, fill(template, **variables), history)
