"""Deletes from the index, and cleared sessions. Each query works on an index of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.operators.chat import clear_sessions
from pagewarden.operators.index import files_of
from pagewarden.operators.models import describe
from pagewarden.sources.pages import split_pages
from pagewarden.sources.requests import bulk_requests
from workloads.inputs import documents, files, new_index, table
from workloads.intake import bulk_request_rows, write_manifests
from workloads.sqltext import FILES, PAGES, tokens, with_

MATCHED = "src1-7"


def _filled_index(spark, sf_dir):
    """All pages, screened or not, without vectors."""
    index = new_index(spark)
    index.append(describe(split_pages(documents(spark, sf_dir))))
    return index


def _left(index, deleted):
    return files_of(index.read()).withColumn("deleted", F.lit(deleted).cast("bigint"))


def delete_exact(spark, sf_dir):
    """Delete the longest file."""
    rows = files(spark, sf_dir)
    longest = rows.agg(
        F.max(F.struct(F.length("text").alias("size"), "doc_id", "file_path")).alias("top")
    ).first()["top"]
    index = _filled_index(spark, sf_dir)
    return _left(index, index.delete_path(longest["file_path"]))


def delete_match(spark, sf_dir):
    index = _filled_index(spark, sf_dir)
    return _left(index, index.delete_match(MATCHED))


def _labelled(spark, sf_dir, column, value):
    marked = table(spark, sf_dir, "labels").where(F.col(column) == value).select("doc_id")
    return files(spark, sf_dir).join(marked, "doc_id", "left_semi")


def delete_bulk(spark, sf_dir):
    """Delete the files labelled toxic."""
    index = _filled_index(spark, sf_dir)
    bulk = bulk_request_rows(_labelled(spark, sf_dir, "toxic", 1))
    return _left(index, index.delete_files(bulk_requests(bulk)))


def delete_manifest(spark, sf_dir):
    """Delete the files labelled as of low quality, named in manifests."""
    index = _filled_index(spark, sf_dir)
    manifests = write_manifests(spark, _labelled(spark, sf_dir, "quality", 0))
    return _left(index, index.delete_manifest(manifests))


def clear_session(spark, sf_dir):
    """Clear the sessions that hold a system message."""
    turns = table(spark, sf_dir, "conversations")
    cleared = turns.where("role = 'system'").select("conv_id")
    return clear_sessions(turns, cleared, "conv_id").select("conv_id", "turn", "role")


QUERIES = {
    "delete_exact": delete_exact,
    "delete_match": delete_match,
    "delete_bulk": delete_bulk,
    "delete_manifest": delete_manifest,
    "clear_session": clear_session,
}


def _survivors(gone):
    return (
        with_(FILES, PAGES, f"gone AS ({gone})")
        + """SELECT unique_id, file_path, count(*) AS num_pages,
       (SELECT count(*) FROM pages_ SEMI JOIN gone USING (file_path)) AS deleted
FROM pages_ ANTI JOIN gone USING (file_path) GROUP BY ALL"""
    )


def _labelled_sql(condition):
    return f"SELECT file_path FROM files JOIN labels USING (doc_id) WHERE {condition}"


SQL = {
    "delete_exact": _survivors(
        "SELECT file_path FROM files ORDER BY length(text) DESC, doc_id DESC LIMIT 1"
    ),
    "delete_match": _survivors(
        f"SELECT file_path FROM files WHERE list_has_any({tokens('file_path')}, ['src1', '7'])"
    ),
    "delete_bulk": _survivors(_labelled_sql("toxic = 1")),
    "delete_manifest": _survivors(_labelled_sql("quality = 0")),
    "clear_session": """
SELECT conv_id, turn, role FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
}
