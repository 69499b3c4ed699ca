"""Contexts, prompts, answers, message lists and model routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.constants import (
    ANSWER_PROMPT,
    BEDROCK_MODELS,
    ENRICH_PROMPT,
    OPENAI_MODELS,
    NO_ANSWER,
    SUMMARY_QUESTION,
    UNSAFE_MESSAGE,
)
from pagewarden.functions.prompts import enrich_prompt as enrich_prompt_of
from pagewarden.functions.prompts import prompt_template as prompt_template_of
from pagewarden.operators.chat import latest_messages, message_rows
from pagewarden.operators.routing import TEMPERATURES, model_catalogue, model_settings, route
from pagewarden.operators.screening import bad_pages, screen_documents
from pagewarden.plans.ask import answer, prompts, retrieve, summarise
from pagewarden.plans.chat import converse, converse_with_history
from pagewarden.sources.pages import split_pages
from workloads.inputs import documents, files, page_index, questions, table
from workloads import screening
from workloads.sqltext import CONTEXTS, FILES, INDEXED, PAGES, RULE_TABLE, best_pages, found_in, quoted, with_

SYSTEM_PROMPT = "You answer questions about documents."
TEMPLATE = "You answer message {turn} of conversation {conversation}."
CHAT_TEMPLATE = "Go on with this conversation. Documents: {context}"
OTHER_MODEL = "some-other-model"


def _asked(spark, sf_dir):
    asked = questions(spark, sf_dir)
    return asked, retrieve(page_index(spark, sf_dir).read(), asked)


def context_block(spark, sf_dir):
    return prompts(*_asked(spark, sf_dir)).select("question_id", "context")


def answer_prompt(spark, sf_dir):
    return prompts(*_asked(spark, sf_dir)).select("question_id", "prompt")


def answers(spark, sf_dir):
    return answer(*_asked(spark, sf_dir)).select("question_id", "answer")


def chat_messages(spark, sf_dir):
    """All questions, and for each page with personal data a message that quotes it."""
    asked = questions(spark, sf_dir).select(
        F.concat(F.lit("item-"), F.col("question_id").cast("string")).alias("message_id"),
        F.col("question").alias("text"),
    )
    quoted_pages = bad_pages(screen_documents(documents(spark, sf_dir))).select(
        F.concat_ws("#", "file_path", F.col("page_no").cast("string")).alias("message_id"),
        F.concat(F.lit("Who is "), F.col("pii_warnings"), F.lit("?")).alias("text"),
    )
    return asked.unionByName(quoted_pages)


def chat_transcript(spark, sf_dir):
    return converse(chat_messages(spark, sf_dir), page_index(spark, sf_dir).read())


def summaries(spark, sf_dir):
    """One summary per tenant."""
    requests = (
        files(spark, sf_dir)
        .select(F.col("unique_id").alias("question_id"))
        .distinct()
        .withColumn("unique_ids", F.array("question_id"))
    )
    done = summarise(page_index(spark, sf_dir).read(), requests)
    return done.select("question_id", "context", "answer")


def enrich_prompt(spark, sf_dir):
    pages = split_pages(documents(spark, sf_dir))
    metadata = F.to_json(F.struct("unique_id", "file_path"))
    return pages.select(
        "file_path", "page_no", enrich_prompt_of(metadata, F.col("text")).alias("prompt")
    )


def chat_history(spark, sf_dir):
    return message_rows(table(spark, sf_dir, "conversations"), SYSTEM_PROMPT)


def prompt_template(spark, sf_dir):
    """The latest user message of each conversation in a template, with all turns before it."""
    messages = prompt_template_of(
        TEMPLATE,
        {"turn": F.col("turn"), "conversation": F.col("conv_id")},
        F.col("text"),
        F.col("history"),
    )
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return latest_messages(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", F.array_join(lines, "\n").alias("messages")
    )


def _named_models(spark, sf_dir):
    """Each file asks for a model in turn; one place in the row is no known model."""
    catalogue = model_catalogue(spark)
    n = len(BEDROCK_MODELS) + len(OPENAI_MODELS) + 1
    wanted = files(spark, sf_dir).select("doc_id", (F.col("doc_id") % n).cast("int").alias("position"))
    named = wanted.join(F.broadcast(catalogue.select("position", "model_id")), "position", "left")
    return named.select("doc_id", F.coalesce("model_id", F.lit(OTHER_MODEL)).alias("model_id"))


def model_routing(spark, sf_dir):
    routed, refused = route(_named_models(spark, sf_dir), model_catalogue(spark))
    return routed.unionByName(refused, allowMissingColumns=True)


def chat_with_history(spark, sf_dir):
    """Every conversation goes on: its latest message answered with the pages and its history."""
    turns = table(spark, sf_dir, "conversations")
    return converse_with_history(turns, page_index(spark, sf_dir).read(), CHAT_TEMPLATE)


def call_settings(spark, sf_dir):
    """Settings of every call that a file leads to: its description, an answer, and a chat about it."""
    routed, _ = route(_named_models(spark, sf_dir), model_catalogue(spark))
    calls = [
        F.struct(F.lit(path).alias("path"), model_settings(F.col("model_id"), 500, path=path).alias("settings"))
        for path in TEMPERATURES
    ]
    rows = routed.select("doc_id", "limit_key", F.inline(F.array(*calls)))
    return rows.select(
        "doc_id",
        "path",
        F.element_at("settings", "temperature").alias("temperature"),
        F.element_at("settings", F.col("limit_key")).alias("max_length"),
        F.size("settings").alias("n_settings"),
    )


QUERIES = {
    "context_block": context_block,
    "answer_prompt": answer_prompt,
    "answers": answers,
    "summaries": summaries,
    "chat_transcript": chat_transcript,
    "enrich_prompt": enrich_prompt,
    "chat_history": chat_history,
    "prompt_template": prompt_template,
    "prompt_history": prompt_template,
    "model_routing": model_routing,
    "call_settings": call_settings,
    "chat_with_history": chat_with_history,
}


def _between(template, **columns):
    """SQL text of a template with named places."""
    for name, column in columns.items():
        template = template.replace("{" + name + "}", "\x00" + column + "\x00")
    parts = template.split("\x00")
    return " || ".join(quoted(p) if i % 2 == 0 else f"({p})" for i, p in enumerate(parts))


_ASKED = with_(*INDEXED, *best_pages(), CONTEXTS)
_ANSWERS = (
    _ASKED
    + f"""SELECT item_id AS question_id, coalesce(best, {quoted(NO_ANSWER)}) AS answer
FROM benchmark LEFT JOIN contexts ON question_id = item_id"""
)
_SUMMARY_QUESTIONS = (
    f"SELECT DISTINCT source AS question_id, {quoted(SUMMARY_QUESTION)} AS question FROM documents"
)
_MODELS = ", ".join(
    f"({i}, {quoted(m)}, '{p}')"
    for i, (m, p) in enumerate(
        [(m, "bedrock") for m in BEDROCK_MODELS] + [(m, "openai") for m in OPENAI_MODELS]
    )
)

SQL = {
    "context_block": _ASKED
    + """SELECT item_id AS question_id, coalesce(context, '') AS context
FROM benchmark LEFT JOIN contexts ON question_id = item_id""",
    "answer_prompt": _ASKED
    + f"""SELECT item_id AS question_id,
       {_between(ANSWER_PROMPT, context="coalesce(context, '')", question="text")} AS prompt
FROM benchmark LEFT JOIN contexts ON question_id = item_id""",
    "answers": _ANSWERS,
    "chat_transcript": f"""
WITH quoted_pages AS (
  SELECT file_path || '#' || page_no AS message_id, 'Who is ' || pii_warnings || '?' AS text
  FROM ({screening.SQL["pii_warnings"]})),
{RULE_TABLE},
{found_in("quoted_pages", "message_id")},
{screening._described("message_id")}
SELECT message_id, 'pii_warning' AS role, {quoted(UNSAFE_MESSAGE)} || what AS content FROM described
UNION ALL SELECT 'item-' || item_id, 'user', text FROM benchmark
UNION ALL SELECT 'item-' || question_id, 'assistant', answer FROM ({_ANSWERS})""",
    "summaries": with_(
        *INDEXED,
        *best_pages(asked=_SUMMARY_QUESTIONS, visible="WHERE r.unique_id = a.question_id"),
        CONTEXTS,
    )
    + f"""SELECT question_id, coalesce(context, '') AS context, coalesce(best, {quoted(NO_ANSWER)}) AS answer
FROM asked LEFT JOIN contexts USING (question_id)""",
    "enrich_prompt": with_(FILES, PAGES)
    + f"""SELECT file_path, page_no, {_between(
        ENRICH_PROMPT,
        metadata="'{\"unique_id\":\"' || unique_id || '\",\"file_path\":\"' || file_path || '\"}'",
        text="text")} AS prompt FROM pages_""",
    "chat_history": f"""
WITH last AS (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT conv_id, turn, role, text AS content, turn = last_turn AS is_current
FROM conversations JOIN last USING (conv_id) WHERE role IN ('user', 'assistant') AND turn <= last_turn
UNION ALL
SELECT conv_id, -1, 'system', {quoted(SYSTEM_PROMPT)}, false FROM last""",
    "prompt_template": f"""
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT c.conv_id, c.turn,
       'system: ' || {_between(TEMPLATE, turn="c.turn", conversation="c.conv_id")} || chr(10)
       || coalesce(string_agg(p.role || ': ' || p.text || chr(10), '' ORDER BY p.turn), '')
       || 'user: ' || c.text AS messages
FROM last JOIN conversations c USING (conv_id, turn)
LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn AND p.role IN ('user', 'assistant')
GROUP BY c.conv_id, c.turn, c.text""",
    "model_routing": f"""
WITH catalogue(position, model_id, provider) AS (VALUES {_MODELS}),
named AS (
  SELECT doc_id, coalesce(model_id, '{OTHER_MODEL}') AS model_id, provider
  FROM documents LEFT JOIN catalogue ON position = doc_id % {len(BEDROCK_MODELS) + len(OPENAI_MODELS) + 1})
SELECT doc_id, model_id, provider,
       CASE WHEN provider IS NULL THEN NULL WHEN contains(lower(model_id), 'anthropic') THEN 'max_tokens'
            WHEN contains(lower(model_id), 'amazon') THEN 'maxTokenCount' ELSE 'max_tokens' END AS limit_key,
       CASE WHEN provider IS NULL THEN 'Unsupported model: ' || model_id END AS error
FROM named""",
}
SQL["prompt_history"] = SQL["prompt_template"]
SQL["call_settings"] = f"""
SELECT doc_id, path, temperature, 500.0::DOUBLE AS max_length, 2::INTEGER AS n_settings
FROM ({SQL["model_routing"]}),
     (VALUES ('describe', 0.0::DOUBLE), ('answer', 0.0::DOUBLE), ('chat', 0.7::DOUBLE)) calls(path, temperature)
WHERE provider IS NOT NULL"""
_LATEST = """SELECT conv_id AS question_id, text AS question FROM conversations
  JOIN (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY ALL) USING (conv_id, turn)"""
SQL["chat_with_history"] = with_(*INDEXED, *best_pages(asked=_LATEST), CONTEXTS) + f"""
SELECT l.conv_id, l.turn, 'assistant' AS role, coalesce(any_value(best), {quoted(NO_ANSWER)}) AS content,
       'system: ' || {_between(CHAT_TEMPLATE, context="coalesce(any_value(context), '')")} || chr(10)
       || coalesce(string_agg(p.role || ': ' || p.text || chr(10), '' ORDER BY p.turn), '')
       || 'user: ' || any_value(c.text) AS prompt
FROM (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY ALL) l
JOIN conversations c USING (conv_id, turn) LEFT JOIN contexts ON question_id = l.conv_id
LEFT JOIN conversations p ON p.conv_id = l.conv_id AND p.turn < l.turn AND p.role IN ('user', 'assistant')
GROUP BY l.conv_id, l.turn"""
