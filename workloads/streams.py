"""Streams that read the given tables to their end and give what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.schema import MESSAGE
from pagewarden.session import fresh_path
from pagewarden.sources.requests import upload_requests, upload_stream
from pagewarden.streaming.jobs import (
    chat_stream,
    ingest_stream,
    latest_counts,
    session_stream,
    transcript,
    transcript_stream,
)
from workloads import asking, indexing, intake, screening
from workloads.inputs import as_files, new_index, page_index, table


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    # The pattern lets one file and a folder of files pass alike.
    return upload_stream(spark, f"{sf_dir}/{name}.parque[t]", schema)


def _drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_message_gate(spark, sf_dir):
    """Documents pasted as messages, read back from the transcript."""
    pasted = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    path, checkpoint = fresh_path(spark, "transcript"), fresh_path(spark, "steps")
    cores = spark.sparkContext.defaultParallelism
    _drain(transcript_stream(pasted, path, checkpoint, partitions=cores))
    return spark.read.parquet(path).select("doc_id", "role", "content")


def stream_ingest(spark, sf_dir):
    arriving = as_files(_stream(spark, sf_dir, "documents")).drop("doc_id")
    index = new_index(spark)
    cores = spark.sparkContext.defaultParallelism
    _drain(ingest_stream(arriving, index, fresh_path(spark, "steps"), partitions=cores))
    return indexing._record_rows(index.read())


def stream_ingest_twice(spark, sf_dir):
    """The stream starts anew with its checkpoint lost: every file replaces itself."""
    index = new_index(spark)
    cores = spark.sparkContext.defaultParallelism
    for _ in range(2):
        arriving = as_files(_stream(spark, sf_dir, "documents")).drop("doc_id")
        _drain(ingest_stream(arriving, index, fresh_path(spark, "steps"), partitions=cores))
    return indexing._record_rows(index.read())


def stream_uploads(spark, sf_dir):
    rows = as_files(_stream(spark, sf_dir, "documents"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    requests = upload_requests(rows.withColumn("name", name)).drop("model_id")
    path = fresh_path(spark, "requests")
    _drain(
        requests.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", fresh_path(spark, "steps"))
    )
    return spark.read.parquet(path)


def stream_sessions(spark, sf_dir):
    path = fresh_path(spark, "sessions")
    turns = _stream(spark, sf_dir, "conversations").select(*MESSAGE.fieldNames())
    _drain(session_stream(turns, path, fresh_path(spark, "steps")))
    return latest_counts(spark.read.parquet(path))


def stream_chat(spark, sf_dir):
    """Questions that arrive on a stream, and their answers."""
    arriving = _stream(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("message_id"), "text"
    )
    path = fresh_path(spark, "chat")
    index = page_index(spark, sf_dir)
    _drain(chat_stream(arriving, index, path, fresh_path(spark, "steps")))
    return transcript(spark, path)


QUERIES = {
    "stream_message_gate": stream_message_gate,
    "stream_ingest": stream_ingest,
    "stream_ingest_twice": stream_ingest_twice,
    "stream_uploads": stream_uploads,
    "stream_sessions": stream_sessions,
    "stream_chat": stream_chat,
}

SQL = {
    "stream_message_gate": "SELECT message_id AS doc_id, role, content FROM ("
    + screening.SQL["message_gate"]
    + ") WHERE origin = 'document'",
    "stream_ingest": indexing.SQL["ingest"],
    "stream_ingest_twice": indexing.SQL["ingest"],
    "stream_uploads": intake.SQL["upload_events"],
    "stream_chat": "SELECT * FROM ("
    + asking.SQL["chat_transcript"]
    + ") WHERE message_id LIKE 'item-%'",
    "stream_sessions": "SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY ALL",
}
