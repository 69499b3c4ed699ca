"""Index records, vectors, writing and listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.constants import ENRICH_FAILED
from pagewarden.functions.text import (
    or_placeholder,
    collapse_space,
    vector_entries,
    with_hashed_vector,
)
from pagewarden.operators.chat import session_info as session_info_of
from pagewarden.operators.index import files_of
from pagewarden.operators.models import complete_with, describe, stored_vectors
from pagewarden.operators.screening import (
    clean_pages,
    file_stats,
    ingest_report,
    screen_documents,
)
from pagewarden.plans.ingest import index_records as records_of
from pagewarden.plans.ingest import ingest as run_ingest
from pagewarden.plans.ingest import ingest_pages, requested
from pagewarden.session import fresh_path
from pagewarden.sources.pages import read_files, split_pages, write_folders
from pagewarden.sources.requests import bulk_requests
from workloads import intake, screening
from workloads.inputs import documents, files, new_index, page_index, table, vectors
from workloads.intake import bulk_request_rows
from workloads.sqltext import (
    FILES,
    INDEXED,
    PAGE_FOUND,
    PAGES,
    RULE_TABLE,
    described,
    listed,
    pages_of,
    quoted,
    tokens,
    vector_of,
    with_,
)

STORED_DIM = 64
# Files that a task writes, and shelves that it puts their folders on.
FILES_PER_TASK = 1000
SHELVES_PER_TASK = 8


def _record_rows(records):
    return records.select(
        "unique_id",
        "file_path",
        "page_no",
        "page_number",
        "llm_generated",
        "contains_pii",
        F.size("text_embedding.indices").cast("bigint").alias("n_buckets"),
        F.aggregate(
            "text_embedding.values", F.lit(0).cast("bigint"), lambda total, w: total + w
        ).alias("n_tokens"),
    )


def index_records(spark, sf_dir):
    return _record_rows(records_of(clean_pages(documents(spark, sf_dir))))


def ingest(spark, sf_dir):
    index = new_index(spark)
    run_ingest(documents(spark, sf_dir), index)
    return _record_rows(index.read())


def reingest(spark, sf_dir):
    """The same files twice, the second time in place of the first."""
    index = new_index(spark)
    run_ingest(documents(spark, sf_dir), index)
    run_ingest(documents(spark, sf_dir), index, replace=True)
    return _record_rows(index.read())


def _report_row(spark, done):
    names = done._fields[1:]
    return spark.createDataFrame([done[1:]], ", ".join(f"{name} bigint" for name in names))


def ingest_counts(spark, sf_dir):
    """What the run itself counted."""
    return _report_row(spark, run_ingest(documents(spark, sf_dir), new_index(spark)))


def ingest_refused(spark, sf_dir):
    """Every seventh file carries a warning and is refused."""
    warning = F.when(F.col("doc_id") % 7 == 0, F.lit("checked by hand"))
    index = new_index(spark)
    run_ingest(files(spark, sf_dir).withColumn("pii_warning", warning), index)
    return _record_rows(index.read())


def _load_detector():
    """Finds very long capitalised words, and fails on pages of fewer than five words."""
    import re

    def detect(text):
        if len([word for word in re.split("[ \t\n\f\r]+", text) if word]) < 5:
            raise ValueError("too short")
        return [{"entity_group": "PERSON", "word": w, "score": 0.9} for w in re.findall("[A-Z][a-z]{9,}", text)]

    return detect


def ingest_detected(spark, sf_dir):
    """Rules and a detector; pages that it fails on count as unsafe."""
    done = run_ingest(documents(spark, sf_dir), new_index(spark), detector=_load_detector, on_error="closed")
    return _report_row(spark, done)


def bulk_ingest(spark, sf_dir):
    """Files of high quality, asked for in bulk requests: indexed, and what became of each."""
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = files(spark, sf_dir)
    requests = bulk_requests(bulk_request_rows(rows.drop("text").join(wanted, "doc_id", "left_semi")))
    found, _ = requested(rows.select("file_path", "text"), requests)
    index = new_index(spark)
    run_ingest(found, index)
    indexed = files_of(index.read()).withColumnRenamed("num_pages", "num_pages_processed")
    stats = ingest_report(file_stats(screen_documents(found))).drop("num_pages_processed")
    joined = stats.join(indexed, ["unique_id", "file_path"], "left")
    return joined.withColumn("num_pages_processed", F.coalesce("num_pages_processed", F.lit(0)))


def _web_text(content):
    """The text of a web page's bytes, as one page."""
    import re

    text = content.decode()
    text = re.sub(r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ", text)
    return [re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]+>", " ", text)).strip()]


def ingest_files(spark, sf_dir):
    """Web pages as binary files, a folder for each, read back with an extractor and indexed."""
    path = fresh_path(spark, "files")
    raw = table(spark, sf_dir, "pages")
    tasks = max(spark.sparkContext.defaultParallelism, -(-raw.count() // FILES_PER_TASK))
    # Shelves of folders are listed by tasks; a single folder of all would be by the driver.
    shelf = F.pmod(F.xxhash64("page_id"), F.lit(tasks * SHELVES_PER_TASK))
    html = raw.where("html IS NOT NULL").select(
        shelf.alias("shelf"), "page_id", F.regexp_replace("html", "[\r\n]", " ").alias("value")
    )
    write_folders(html.repartition(tasks, "shelf"), ["shelf", "page_id"], path, line_end=" ")
    pages, _ = read_files(spark, path, _web_text, pattern="*.txt")
    # Spark reads some 30 small files in a task, and each task would write a table of its own.
    pages = pages.coalesce(tasks)
    number = F.regexp_extract("file_path", "page_id=([0-9]+)", 1)
    named = pages.withColumns({"file_path": number, "unique_id": F.concat(F.lit("web"), (number.cast("long") % 5).cast("string"))})
    index = new_index(spark)
    ingest_pages(named, index)
    return _record_rows(index.read())


def placeholder_fill(spark, sf_dir):
    """Single lines as content: many are empty."""
    lines = split_pages(documents(spark, sf_dir), lines_per_page=1)
    return lines.select(
        "unique_id",
        "file_path",
        "page_no",
        or_placeholder(collapse_space(F.col("text"))).alias("llm_generated"),
    )


def zero_vector_fill(spark, sf_dir):
    stored = vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    filled = stored_vectors(
        table(spark, sf_dir, "documents").select("doc_id"), stored, "doc_id", dim=STORED_DIM
    )
    square = F.aggregate(
        "text_embedding",
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
    )
    return filled.select(
        "doc_id",
        F.size("text_embedding").cast("bigint").alias("dim"),
        F.round(square, 6).alias("norm2"),
    )


def hash_embedding(spark, sf_dir):
    hashed = with_hashed_vector(table(spark, sf_dir, "documents"), "text")
    return vector_entries(hashed, ["doc_id"])


def page_description(spark, sf_dir):
    return describe(split_pages(documents(spark, sf_dir))).drop("text", "page_number")


def enrich_fallback(spark, sf_dir):
    """A client that counts words and fails on pages with fewer than five."""

    def load():
        def count_words(page):
            n = len([word for word in page.split(" ") if word])
            if n < 5:
                raise ValueError("too short")
            return f"{n} words"

        return count_words

    pages = describe(split_pages(documents(spark, sf_dir))).drop("text")
    replied = complete_with(pages, load, "llm_generated", "reply", ENRICH_FAILED)
    return replied.select("unique_id", "file_path", "page_no", "reply")


def indexed_tenants(spark, sf_dir):
    return page_index(spark, sf_dir).tenants()


def indexed_tenants_after(spark, sf_dir):
    return page_index(spark, sf_dir).tenants(n=5, after="src12")


def list_docs(spark, sf_dir):
    return page_index(spark, sf_dir).list_docs(["src3", "src7", "no such tenant"])


def list_docs_totals(spark, sf_dir):
    listed = page_index(spark, sf_dir).files()
    return listed.groupBy("unique_id").agg(
        F.sum("num_pages").alias("num_pages"), F.count(F.lit(1)).alias("num_docs")
    )


def session_info(spark, sf_dir):
    """A session is a conversation; its upload is the document of the same number."""
    messages = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    uploads = files(spark, sf_dir).select(F.col("doc_id").alias("session"))
    return session_info_of(messages, uploads)


QUERIES = {
    "index_records": index_records,
    "ingest": ingest,
    "reingest": reingest,
    "ingest_counts": ingest_counts,
    "ingest_refused": ingest_refused,
    "ingest_detected": ingest_detected,
    "ingest_files": ingest_files,
    "bulk_ingest": bulk_ingest,
    "placeholder_fill": placeholder_fill,
    "zero_vector_fill": zero_vector_fill,
    "hash_embedding": hash_embedding,
    "page_description": page_description,
    "enrich_fallback": enrich_fallback,
    "indexed_tenants": indexed_tenants,
    "indexed_tenants_after": indexed_tenants_after,
    "list_docs": list_docs,
    "list_docs_totals": list_docs_totals,
    "session_info": session_info,
}

_RECORDS = with_(*INDEXED) + f"""SELECT unique_id, file_path, page_no, page_number, llm_generated,
       false AS contains_pii,
       len(list_distinct(list_transform(t, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 1536)))::BIGINT AS n_buckets,
       len(t)::BIGINT AS n_tokens
FROM (SELECT *, {tokens('llm_generated')} AS t FROM records)"""

SQL = {
    "index_records": _RECORDS,
    "ingest": _RECORDS,
    "reingest": _RECORDS,
    "ingest_counts": "SELECT files_to_process AS files, files_with_pii, total_pages, pages_with_pii,"
    " 0::BIGINT AS refused, 0::BIGINT AS detect_errors FROM (" + screening.SQL["bulk_stats"] + ")",
    "ingest_refused": "SELECT r.* FROM (" + _RECORDS + """) r SEMI JOIN (SELECT doc_id, source || '/doc_' || doc_id || '.pdf' AS file_path
      FROM documents WHERE doc_id % 7 <> 0) USING (file_path)""",
    "ingest_detected": with_(FILES, PAGES, RULE_TABLE, PAGE_FOUND)
    + rf"""SELECT count(DISTINCT file_path) AS files, count(DISTINCT file_path) FILTER (bad) AS files_with_pii,
       count(*) AS total_pages, count(*) FILTER (bad) AS pages_with_pii, 0::BIGINT AS refused,
       count(*) FILTER (n < 5) AS detect_errors
FROM (SELECT file_path, n, n < 5 OR regexp_matches(text, '[A-Z][a-z]{{9,}}') OR f.page_no IS NOT NULL AS bad
      FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '[ 	

]+'), lambda x: x <> '')) AS n FROM pages_) p
      LEFT JOIN (SELECT DISTINCT unique_id, file_path, page_no FROM found WHERE {listed()}) f
      USING (unique_id, file_path, page_no))""",
    "ingest_files": with_(
        f"""pages_ AS (
  SELECT 'web' || page_id % 5 AS unique_id, CAST(page_id AS VARCHAR) AS file_path, 1::INTEGER AS page_no,
         'page_1' AS page_number, text
  FROM ({intake.SQL["page_text"].replace("html,", "regexp_replace(html, '[\\r\\n]', ' ', 'g'),")}))""",
        RULE_TABLE,
        PAGE_FOUND,
        *INDEXED[-3:],
    )
    + _RECORDS[_RECORDS.index("SELECT unique_id, file_path, page_no, page_number, llm_generated,\n       false") :],
    "bulk_ingest": "SELECT r.* FROM ("
    + screening.SQL["ingest_report"]
    + """) r JOIN (SELECT source || '/doc_' || doc_id || '.pdf' AS file_path
      FROM documents JOIN labels USING (doc_id) WHERE quality = 1) USING (file_path)""",
    "placeholder_fill": with_(FILES, pages_of(1))
    + f"SELECT unique_id, file_path, page_no, {described('text')} AS llm_generated FROM pages_",
    "zero_vector_fill": f"""
SELECT doc_id, {STORED_DIM}::BIGINT AS dim,
       round(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 0.0), 6) AS norm2
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "hash_embedding": with_(vector_of("documents", "doc_id", "text", "vec")) + "SELECT * FROM vec",
    "page_description": with_(FILES, PAGES)
    + r"""SELECT unique_id, file_path, page_no,
       trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')) AS llm_generated FROM pages_""",
    "enrich_fallback": with_(FILES, PAGES)
    + rf"""SELECT unique_id, file_path, page_no,
       CASE WHEN n < 5 THEN {quoted(ENRICH_FAILED)} ELSE n || ' words' END AS reply
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '')) AS n FROM pages_)""",
    "indexed_tenants": with_(*INDEXED)
    + "SELECT unique_id, count(*) AS doc_count FROM records GROUP BY ALL ORDER BY unique_id LIMIT 10",
    "indexed_tenants_after": with_(*INDEXED)
    + """SELECT unique_id, count(*) AS doc_count FROM records WHERE unique_id > 'src12'
GROUP BY ALL ORDER BY unique_id LIMIT 5""",
    "list_docs": with_(*INDEXED)
    + """SELECT unique_id, file_path, count(*) AS num_pages FROM records
WHERE unique_id IN ('src3', 'src7', 'no such tenant') GROUP BY ALL""",
    "list_docs_totals": with_(*INDEXED)
    + """SELECT unique_id, count(*) AS num_pages, count(DISTINCT file_path) AS num_docs
FROM records GROUP BY ALL""",
    "session_info": """
SELECT session, coalesce(m, 0) AS n_messages, coalesce(d, 0) AS n_documents
FROM (SELECT conv_id AS session, count(*) AS m FROM conversations GROUP BY ALL)
FULL JOIN (SELECT doc_id AS session, count(*) AS d FROM documents GROUP BY ALL) USING (session)""",
}
