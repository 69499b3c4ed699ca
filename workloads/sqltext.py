"""Common parts of the comparison SQL."""

from __future__ import annotations

from pagewarden.constants import PII_GROUPS, PLACEHOLDER_CONTENT
from pagewarden.functions.pii import RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def tokens(column: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), lambda x: x <> '')"
    )


def collapsed(column: str) -> str:
    return f"trim(regexp_replace({column}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


def described(column: str) -> str:
    return f"coalesce(nullif({collapsed(column)}, ''), {quoted(PLACEHOLDER_CONTENT)})"


FILES = """files AS (
  SELECT doc_id, source AS unique_id, source || '/doc_' || doc_id || '.pdf' AS file_path, text
  FROM documents)"""

def pages_of(lines: int) -> str:
    return f"""pages_ AS (
  SELECT unique_id, file_path, CAST(i + 1 AS INTEGER) AS page_no, 'page_' || (i + 1) AS page_number,
         array_to_string(l[i * {lines} + 1 : i * {lines} + {lines}], chr(10)) AS text
  FROM (SELECT unique_id, file_path, l, unnest(range(0, (len(l) - 1) // {lines} + 1)) AS i
        FROM (SELECT unique_id, file_path, string_split(text, chr(10)) AS l FROM files)))"""


PAGES = pages_of(10)

RULE_ROWS = ", ".join(
    f"({n}, {quoted(r.entity_group)}, {quoted(r.pattern)}, {r.score}::DOUBLE)"
    for n, r in enumerate(RULES)
)
RULE_TABLE = f"rules(rule_no, entity_group, pattern, score) AS (VALUES {RULE_ROWS})"
LISTED = "(" + ", ".join(map(quoted, PII_GROUPS)) + ")"


def found_in(source: str, keys: str, name: str = "found") -> str:
    """All findings of a table with a `text` column; needs RULE_TABLE."""
    return f"""{name} AS (
  SELECT {keys}, rule_no, entity_group, score, unnest(m) AS word, generate_subscripts(m, 1) AS place
  FROM (SELECT {keys}, rule_no, entity_group, score, regexp_extract_all(text, pattern) AS m
        FROM {source}, rules))"""


def listed(threshold: float = 0.8) -> str:
    return f"entity_group IN {LISTED} AND score >= {threshold}"


PAGE_FOUND = found_in("pages_", "unique_id, file_path, page_no")
REJECTED = f"rejected AS (SELECT DISTINCT unique_id, file_path FROM found WHERE {listed()})"
CLEAN = """clean AS (
  SELECT * FROM pages_ ANTI JOIN rejected USING (unique_id, file_path))"""
RECORDS = f"""records AS (
  SELECT unique_id, file_path, page_no, page_number, {described('text')} AS llm_generated FROM clean)"""

# All clean pages as records.
INDEXED = (FILES, PAGES, RULE_TABLE, PAGE_FOUND, REJECTED, CLEAN, RECORDS)


def vector_of(source: str, keys: str, column: str, name: str) -> str:
    """(keys, bucket, w) of a text column."""
    return f"""{name} AS (
  SELECT {keys}, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 1536 AS INTEGER) AS bucket,
         CAST(count(*) AS INTEGER) AS w
  FROM (SELECT {keys}, unnest({tokens(column)}) AS t FROM {source})
  GROUP BY ALL)"""


def best_pages(
    k: int = 10,
    asked: str = "SELECT item_id AS question_id, text AS question FROM benchmark",
    visible: str = "",
) -> tuple[str, ...]:
    """Best k records per question by text; `visible` may narrow the pairs."""
    return (
        f"asked AS ({asked})",
        vector_of("records", "unique_id, file_path, page_no", "llm_generated", "page_vec"),
        vector_of("asked", "question_id", "question", "question_vec"),
        "page_len AS (SELECT unique_id, file_path, page_no, sqrt(sum(w * w)::DOUBLE) AS n FROM page_vec GROUP BY ALL)",
        "question_len AS (SELECT question_id, sqrt(sum(w * w)::DOUBLE) AS n FROM question_vec GROUP BY ALL)",
        """dots AS (
  SELECT question_id, unique_id, file_path, page_no, sum(p.w * q.w)::DOUBLE AS dot
  FROM page_vec p JOIN question_vec q USING (bucket) GROUP BY ALL)""",
        f"""scored AS (
  SELECT a.question_id, r.unique_id, r.file_path, r.page_no,
         round(coalesce(dot / (pl.n * ql.n), 0.0) + 1.0, 6) AS score
  FROM asked a CROSS JOIN records r
  LEFT JOIN dots USING (question_id, unique_id, file_path, page_no)
  LEFT JOIN page_len pl USING (unique_id, file_path, page_no)
  LEFT JOIN question_len ql USING (question_id)
  {visible})""",
        f"""ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY question_id ORDER BY score DESC, unique_id, file_path, page_no) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= {k})""",
        """hits AS (
  SELECT question_id, rank, unique_id, file_path, page_no, page_number, llm_generated, score
  FROM ranked JOIN records USING (unique_id, file_path, page_no))""",
    )


CONTEXTS = """contexts AS (
  SELECT question_id,
         string_agg(chr(10) || 'Document ' || rank || ':' || chr(10) || 'Source: ' || file_path || chr(10)
                    || 'Page: ' || page_number || chr(10) || 'Content: ' || llm_generated || chr(10), ''
                    ORDER BY rank) AS context,
         arg_min(llm_generated, rank) AS best
  FROM hits GROUP BY question_id)"""


def best_vectors(k: int, score: str, where: str = "true", after: str = "true") -> str:
    return f"""
SELECT question_id, rank, vec_id, score FROM (
  SELECT question_id, vec_id, label, score,
         CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT q.vec_id AS question_id, v.vec_id, v.label, round(coalesce({score}, 0.0) + 1.0, 6) AS score
        FROM embeddings v, (SELECT b.item_id AS vec_id, e.embedding
                            FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id) q
        WHERE {where}))
WHERE rank <= {k} AND {after}"""


COSINE = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
INNER = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
