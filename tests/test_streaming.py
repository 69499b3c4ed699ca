from pyspark.sql import types as T

from pagewarden.operators.index import PageIndex, files_of
from pagewarden.operators.screening import gate_messages
from pagewarden.sources.requests import upload_stream
from pagewarden.plans.ingest import ingest
from pagewarden.streaming.jobs import (
    batch_sizes,
    chat_stream,
    ingest_stream,
    latest_counts,
    session_stream,
    transcript,
    transcript_stream,
)

FILES = T.StructType([T.StructField(n, T.StringType()) for n in ("unique_id", "file_path", "text")])
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("text", T.StringType())])


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def land(spark, schema, folder, *rows):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)


def test_transcript_equals_the_batch_gate(spark, tmp_path):
    folder, out, steps = (str(tmp_path / n) for n in ("in", "out", "steps"))
    land(spark, TURNS, folder, (1, "hello"), (1, "mail a@b.com"))
    drain(transcript_stream(upload_stream(spark, folder, TURNS), out, steps))
    land(spark, TURNS, folder, (2, "again"))
    drain(transcript_stream(upload_stream(spark, folder, TURNS), out, steps))
    written = spark.read.parquet(out).select("conv_id", "role", "content")
    expected = gate_messages(spark.read.parquet(folder)).select("conv_id", "role", "content")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, expected.collect()))
    assert spark.read.parquet(out).where("role = 'pii_warning'").count() == 1


def test_ingestion_goes_on_and_repeats_nothing(spark, tmp_path):
    folder, steps, rejects = (str(tmp_path / n) for n in ("in", "steps", "rejects"))
    index = PageIndex(spark, str(tmp_path / "index"))
    land(spark, FILES, folder, ("a", "f", "fine"), ("a", "g", "call 555-1234"))
    drain(ingest_stream(upload_stream(spark, folder, FILES), index, steps, rejects=rejects))
    land(spark, FILES, folder, ("b", "h", "fine"))
    drain(ingest_stream(upload_stream(spark, folder, FILES), index, steps, rejects=rejects))
    drain(ingest_stream(upload_stream(spark, folder, FILES), index, steps, rejects=rejects))
    paths = sorted(r["file_path"] for r in files_of(index.read()).collect())
    assert paths == ["f", "h"] and index.read().count() == 2
    assert [r["file_path"] for r in spark.read.parquet(rejects).collect()] == ["g"]


def test_backlog_in_steps(spark, tmp_path):
    folder = str(tmp_path / "in")
    index = PageIndex(spark, str(tmp_path / "index"))
    for name in "fgh":
        land(spark, FILES, folder, ("a", name, "fine"))
    stream = upload_stream(spark, folder, FILES, files_per_batch=1)
    drain(ingest_stream(stream, index, str(tmp_path / "steps"), partitions=2))
    versions = list((tmp_path / "index").glob("records/version=*/batch=uploads-*"))
    assert len(versions) == 3 and index.read().count() == 3


def test_lost_checkpoint_doubles_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    index = PageIndex(spark, str(tmp_path / "index"))
    land(spark, FILES, folder, ("a", "f", "fine"), ("a", "g", "good"))
    for attempt in ("first", "second"):
        drain(ingest_stream(upload_stream(spark, folder, FILES), index, str(tmp_path / attempt)))
    assert index.read().count() == 2


def test_chat(spark, tmp_path):
    folder, out, steps = (str(tmp_path / n) for n in ("in", "out", "steps"))
    schema = T.StructType([T.StructField("message_id", T.LongType()), T.StructField("text", T.StringType())])
    index = PageIndex(spark, str(tmp_path / "index"))
    ingest(spark.createDataFrame([("a", "f", "red apples"), ("a", "g", "green pears")], FILES), index)
    land(spark, schema, folder, (1, "which apples"), (2, "pears for a@b.com"), (3, "pears"))
    query = chat_stream(upload_stream(spark, folder, schema), index, out, steps, k=1).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(batch_sizes(query)) == 3
    got = {(r["message_id"], r["role"]): r["content"] for r in spark.read.parquet(out).collect()}
    assert set(got) == {(1, "user"), (1, "assistant"), (2, "pii_warning"), (3, "user"), (3, "assistant")}
    assert got[1, "assistant"] == "red apples" and got[3, "assistant"] == "green pears"


def test_a_lost_checkpoint_doubles_no_message(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = T.StructType([T.StructField("message_id", T.LongType()), T.StructField("text", T.StringType())])
    index = PageIndex(spark, str(tmp_path / "index"))
    ingest(spark.createDataFrame([("a", "f", "red apples")], FILES), index)
    land(spark, schema, folder, (1, "which apples"), (2, "mail a@b.com"))
    for steps in ("first", "second"):
        stream = upload_stream(spark, folder, schema)
        drain(chat_stream(stream, index, out, str(tmp_path / steps), k=1))
        land(spark, schema, folder, (3, "more apples"))
    rows = sorted((r["message_id"], r["role"]) for r in transcript(spark, out).collect())
    assert rows == [(1, "assistant"), (1, "user"), (2, "pii_warning"), (3, "assistant"), (3, "user")]


def test_new_files_are_not_deleted(spark, tmp_path):
    index = PageIndex(spark, str(tmp_path / "index"))
    for name in "fgh":
        ingest(spark.createDataFrame([("a", name, "fine")], FILES), index, replace=True)
    assert sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "index" / "deletes").glob("*/*")) == 0
    ingest(spark.createDataFrame([("a", "f", "new"), ("a", "i", "new")], FILES), index, replace=True)
    assert sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "index" / "deletes").glob("*/*")) == 1
    assert sorted(r["llm_generated"] for r in index.read().collect()) == ["fine", "fine", "new", "new"]


def test_session_counters(spark, tmp_path):
    folder, out, steps = (str(tmp_path / n) for n in ("in", "out", "steps"))
    land(spark, TURNS, folder, (1, "a"), (1, "b"), (2, "c"))
    drain(session_stream(upload_stream(spark, folder, TURNS), out, steps))
    land(spark, TURNS, folder, (1, "d"))
    drain(session_stream(upload_stream(spark, folder, TURNS), out, steps))
    got = {tuple(r) for r in latest_counts(spark.read.parquet(out)).collect()}
    assert got == {(1, 3), (2, 1)}
