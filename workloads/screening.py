"""Personal data in texts, pages, files and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.constants import SAFE_MESSAGE, UNSAFE_MESSAGE
from pagewarden.functions import pii
from pagewarden.functions.phrases import PhraseList
from pagewarden.operators.screening import (
    accepted_pages,
    bad_pages,
    bulk_stats as bulk_stats_of,
    clean_pages,
    entity_rows,
    file_stats,
    find_phrases,
    gate_messages,
    gate_pages,
    ingest_report as ingest_report_of,
    message_verdicts,
    screen_documents,
)
from pagewarden.sources.pages import split_pages
from workloads.inputs import documents, table
from workloads.sqltext import (
    CLEAN,
    FILES,
    PAGE_FOUND,
    PAGES,
    REJECTED,
    RULE_TABLE,
    found_in,
    listed,
    quoted,
    tokens,
    with_,
)

PAGE = ["unique_id", "file_path", "page_no"]


def pii_entities(spark, sf_dir):
    return entity_rows(table(spark, sf_dir, "documents"), ["doc_id"])


def _filtered(threshold):
    def run(spark, sf_dir):
        found = pii.listed(pii.entities(F.col("text")), threshold)
        return table(spark, sf_dir, "documents").select("doc_id", F.inline(found))

    return run


def pii_verdict(spark, sf_dir):
    return message_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "is_safe", "message"
    )


def pii_warnings(spark, sf_dir):
    return bad_pages(screen_documents(documents(spark, sf_dir))).drop("error")


def pii_stats(spark, sf_dir):
    return file_stats(screen_documents(documents(spark, sf_dir)))


def doc_gate(spark, sf_dir):
    return clean_pages(documents(spark, sf_dir)).select(*PAGE)


def doc_gate_listed(spark, sf_dir):
    return accepted_pages(screen_documents(documents(spark, sf_dir))).select(*PAGE)


def doc_gate_pages(spark, sf_dir):
    found = pii.listed(pii.entities(F.col("text")))
    pages = split_pages(documents(spark, sf_dir)).withColumn("found", found).select(*PAGE, "found")
    return gate_pages(pages)[0]


def doc_rejects(spark, sf_dir):
    return bad_pages(screen_documents(documents(spark, sf_dir))).select(*PAGE, "error")


def ingest_report(spark, sf_dir):
    return ingest_report_of(pii_stats(spark, sf_dir))


def bulk_stats(spark, sf_dir):
    return bulk_stats_of(pii_stats(spark, sf_dir))


def _messages(spark, sf_dir):
    """All user messages, and all documents as pasted messages."""
    pasted = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("message_id"), "text"
    )
    typed = (
        table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select(
            F.lit("chat").alias("origin"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
            "text",
        )
    )
    return pasted.unionByName(typed)


def message_gate(spark, sf_dir):
    return gate_messages(_messages(spark, sf_dir))


def sentences(spark, sf_dir, words, group, score):
    """Phrase list: every sentence of the benchmark that is so many words."""
    parts = F.explode(F.split("text", "[.\n]")).alias("sentence")
    return (
        table(spark, sf_dir, "benchmark")
        .select(parts)
        .select(F.trim("sentence").alias("phrase"))
        .where(F.col("phrase").rlike("^[A-Za-z0-9]+( [A-Za-z0-9]+){%d}$" % (words - 1)))
        .distinct()
        .select(F.lit(group).alias("entity_group"), "phrase", F.lit(score).alias("score"))
    )


def rules_and_phrases(spark, sf_dir):
    """The rules, with names of two words, places of three, and some that count too little."""
    people, places = sentences(spark, sf_dir, 2, "PERSON", 0.9), sentences(spark, sf_dir, 3, "LOCATION", 0.85)
    doubtful = sentences(spark, sf_dir, 4, "LOCATION", 0.5)
    return [*pii.RULES, PhraseList.read(people.unionByName(places).unionByName(doubtful))]


def doc_gate_phrases(spark, sf_dir):
    return clean_pages(documents(spark, sf_dir), rules=rules_and_phrases(spark, sf_dir)).select(*PAGE)


def message_gate_phrases(spark, sf_dir):
    return gate_messages(_messages(spark, sf_dir), rules=rules_and_phrases(spark, sf_dir))


def pii_gazetteer(spark, sf_dir):
    """Names: every sentence of the benchmark that is two words."""
    phrases = sentences(spark, sf_dir, 2, "PERSON", 0.9)
    found = find_phrases(table(spark, sf_dir, "documents"), ["doc_id"], phrases)
    return found.groupBy("doc_id", "entity_group", "word", "score").agg(
        F.count(F.lit(1)).alias("n_found")
    )


QUERIES = {
    "pii_entities": pii_entities,
    "pii_filtered_60": _filtered(0.6),
    "pii_filtered_80": _filtered(0.8),
    "pii_filtered_90": _filtered(0.9),
    "pii_verdict": pii_verdict,
    "pii_warnings": pii_warnings,
    "pii_stats": pii_stats,
    "doc_gate": doc_gate,
    "doc_gate_listed": doc_gate_listed,
    "doc_gate_pages": doc_gate_pages,
    "doc_rejects": doc_rejects,
    "ingest_report": ingest_report,
    "bulk_stats": bulk_stats,
    "message_gate": message_gate,
    "doc_gate_phrases": doc_gate_phrases,
    "message_gate_phrases": message_gate_phrases,
    "pii_gazetteer": pii_gazetteer,
}

_DOC_FOUND = (RULE_TABLE, found_in("documents", "doc_id"))
_PAGE_FOUND = (FILES, PAGES, RULE_TABLE, PAGE_FOUND)
_WARNED = f"""warned AS (
  SELECT unique_id, file_path, page_no,
         string_agg(word || ' (' || entity_group || ')', ', ' ORDER BY rule_no, place) AS pii_warnings
  FROM found WHERE {listed()} GROUP BY ALL)"""
_STATS = """stats AS (
  SELECT unique_id, file_path, count(*) AS total_pages, count(pii_warnings) AS pages_with_pii
  FROM pages_ LEFT JOIN warned USING (unique_id, file_path, page_no) GROUP BY ALL)"""
_CLEAN_PAGES = with_(*_PAGE_FOUND, REJECTED, CLEAN) + "SELECT unique_id, file_path, page_no FROM clean"
_MESSAGES = """messages AS (
  SELECT 'document' AS origin, doc_id AS message_id, text FROM documents
  UNION ALL
  SELECT 'chat', conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')"""


def _described(keys, found="found"):
    return f"""described AS (
  SELECT {keys}, string_agg(printf('%s (%s, %.2f)', word, entity_group, score), ', '
                            ORDER BY rule_no, place) AS what
  FROM {found} WHERE {listed()} GROUP BY ALL)"""


# Sentences of two to four words, and where they are in a table of texts.
_PHRASES = """phrases AS (
  SELECT DISTINCT lower(sentence) AS word, len(string_split(sentence, ' ')) AS n,
         CASE len(string_split(sentence, ' ')) WHEN 2 THEN 'PERSON' ELSE 'LOCATION' END AS entity_group,
         CASE len(string_split(sentence, ' ')) WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 ELSE 0.5 END::DOUBLE AS score
  FROM (SELECT trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS sentence FROM benchmark)
  WHERE regexp_full_match(sentence, '[A-Za-z0-9]+( [A-Za-z0-9]+){1,3}'))"""


def _with_phrases(source, keys):
    return f"""all_found AS (
  SELECT {keys}, rule_no, entity_group, score, word, place FROM found
  UNION ALL
  SELECT {keys}, 99, entity_group, score, word, i * 10 + n
  FROM (SELECT {keys}, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {keys}, {tokens('text')} AS w FROM {source}))
  JOIN phrases ON array_to_string(w[i:i + n - 1], ' ') = word)"""


SQL = {
    "pii_entities": with_(*_DOC_FOUND) + "SELECT doc_id, entity_group, word, score FROM found",
    **{
        f"pii_filtered_{int(t * 100)}": with_(*_DOC_FOUND)
        + f"SELECT doc_id, entity_group, word, score FROM found WHERE {listed(t)}"
        for t in (0.6, 0.8, 0.9)
    },
    "pii_verdict": with_(*_DOC_FOUND, _described("doc_id"))
    + f"""SELECT doc_id, what IS NULL AS is_safe,
       CASE WHEN what IS NULL THEN {quoted(SAFE_MESSAGE)} ELSE {quoted(UNSAFE_MESSAGE)} || what END AS message
FROM documents LEFT JOIN described USING (doc_id)""",
    "pii_warnings": with_(*_PAGE_FOUND, _WARNED) + "SELECT * FROM warned",
    "pii_stats": with_(*_PAGE_FOUND, _WARNED, _STATS) + "SELECT * FROM stats",
    "doc_gate": _CLEAN_PAGES,
    "doc_gate_listed": _CLEAN_PAGES,
    "doc_gate_pages": _CLEAN_PAGES,
    "doc_rejects": with_(*_PAGE_FOUND, _WARNED)
    + """SELECT unique_id, file_path, page_no,
       'PII detected on page ' || page_no || ': ' || pii_warnings AS error FROM warned""",
    "ingest_report": with_(*_PAGE_FOUND, _WARNED, _STATS)
    + """SELECT unique_id, file_path,
       CASE WHEN pages_with_pii > 0 THEN 0 ELSE total_pages END AS num_pages_processed,
       total_pages, pages_with_pii FROM stats""",
    "bulk_stats": with_(*_PAGE_FOUND, _WARNED, _STATS)
    + """SELECT count(*) AS files_to_process, count(*) FILTER (pages_with_pii > 0) AS files_with_pii,
       sum(total_pages)::BIGINT AS total_pages, sum(pages_with_pii)::BIGINT AS pages_with_pii FROM stats""",
    "message_gate": with_(
        _MESSAGES, RULE_TABLE, found_in("messages", "origin, message_id"), _described("origin, message_id")
    )
    + f"""SELECT origin, message_id, CASE WHEN what IS NULL THEN 'user' ELSE 'pii_warning' END AS role,
       CASE WHEN what IS NULL THEN text ELSE {quoted(UNSAFE_MESSAGE)} || what END AS content
FROM messages LEFT JOIN described USING (origin, message_id)""",
    "doc_gate_phrases": with_(
        *_PAGE_FOUND,
        _PHRASES,
        _with_phrases("pages_", "unique_id, file_path, page_no"),
        REJECTED.replace("FROM found", "FROM all_found"),
        CLEAN,
    )
    + "SELECT unique_id, file_path, page_no FROM clean",
    "message_gate_phrases": with_(
        _MESSAGES,
        RULE_TABLE,
        found_in("messages", "origin, message_id"),
        _PHRASES,
        _with_phrases("messages", "origin, message_id"),
        _described("origin, message_id", "all_found"),
    )
    + f"""SELECT origin, message_id, CASE WHEN what IS NULL THEN 'user' ELSE 'pii_warning' END AS role,
       CASE WHEN what IS NULL THEN text ELSE {quoted(UNSAFE_MESSAGE)} || what END AS content
FROM messages LEFT JOIN described USING (origin, message_id)""",
    "pii_gazetteer": f"""
WITH phrases AS (
  SELECT DISTINCT trim(sentence) AS word
  FROM (SELECT unnest(regexp_split_to_array(text, '[.\n]')) AS sentence FROM benchmark)
  WHERE regexp_full_match(trim(sentence), '[A-Za-z0-9]+ [A-Za-z0-9]+')),
runs AS (
  SELECT doc_id, w[i] || ' ' || w[i + 1] AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i
        FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)))
SELECT doc_id, 'PERSON' AS entity_group, word, 0.9::DOUBLE AS score, count(*) AS n_found
FROM runs JOIN phrases ON run = lower(word) GROUP BY ALL""",
}
