"""Pages and requests out of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.session import fresh_path
from pagewarden.sources.pages import split_pages, web_pages
from pagewarden.sources.requests import (
    bulk_requests,
    manifest_requests,
    upload_requests,
    with_progress,
)
from workloads.inputs import documents, files, table
from workloads.sqltext import FILES, PAGES, with_

# Requests name at most this many files each.
FILES_PER_REQUEST = 1000


def page_split(spark, sf_dir):
    return split_pages(documents(spark, sf_dir))


def page_text(spark, sf_dir):
    return web_pages(table(spark, sf_dir, "pages"))


def _landed(spark, sf_dir):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return files(spark, sf_dir).withColumn("name", name)


def upload_events(spark, sf_dir):
    return upload_requests(_landed(spark, sf_dir)).drop("model_id")


def bulk_request_rows(rows):
    """Requests of bounded length out of single files."""
    part = F.floor(F.col("doc_id") / FILES_PER_REQUEST)
    grouped = rows.groupBy("unique_id", part.alias("part"))
    return grouped.agg(F.collect_list("file_path").alias("file_paths"))


def bulk_events(spark, sf_dir):
    return bulk_requests(bulk_request_rows(files(spark, sf_dir)))


def write_manifests(spark, rows) -> str:
    """Bulk requests as JSON manifests, a file each; returns their folder.

    All manifests of a tenant lie in a folder of its name.
    """
    path = fresh_path(spark, "manifests")
    named = F.transform("file_paths", lambda p: F.struct(p.alias("name")))
    manifests = bulk_request_rows(rows).select("unique_id", F.to_json(named).alias("value"))
    manifests.write.option("maxRecordsPerFile", 1).partitionBy("unique_id").text(path)
    return path


def manifest_events(spark, sf_dir):
    path = write_manifests(spark, files(spark, sf_dir))
    return manifest_requests(spark, path, tenant=r"/unique_id=([^/]+)/")


def progress(spark, sf_dir):
    placed = with_progress(files(spark, sf_dir).drop("text"), "unique_id", "doc_id")
    return placed.select("unique_id", "file_path", "position", "total", "progress")


QUERIES = {
    "page_split": page_split,
    "page_text": page_text,
    "upload_events": upload_events,
    "bulk_events": bulk_events,
    "manifest_events": manifest_events,
    "progress": progress,
}

SQL = {
    "page_split": with_(FILES, PAGES)
    + "SELECT unique_id, file_path, page_no, page_number, text FROM pages_",
    "page_text": r"""
SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'),
  '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM pages""",
    "upload_events": with_(FILES)
    + """SELECT unique_id, file_path, true AS use_local_storage,
       unique_id || '_doc_' || doc_id || '.pdf' AS file_key FROM files""",
    "bulk_events": with_(FILES) + "SELECT unique_id, file_path FROM files",
    "manifest_events": with_(FILES) + "SELECT unique_id, file_path FROM files",
    "progress": with_(FILES)
    + """SELECT unique_id, file_path, position, total, round(position / total, 6) AS progress
FROM (SELECT unique_id, file_path,
        row_number() OVER (PARTITION BY unique_id ORDER BY doc_id) AS position,
        count(*) OVER (PARTITION BY unique_id) AS total FROM files)""",
}
