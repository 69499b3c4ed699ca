"""Nothing is lost, doubled or overwritten: odd vectors, repeated writes, several streams."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.operators.cells import place_in_cells, train_cells
from pagewarden.operators.index import PageIndex, files_of
from pagewarden.operators.models import complete_with
from pagewarden.operators.search import nearest
from pagewarden.plans.ask import retrieve
from pagewarden.plans.ingest import ingest
from pagewarden.sources.requests import upload_stream
from pagewarden.streaming.jobs import ingest_stream

FILES = T.StructType([T.StructField(n, T.StringType()) for n in ("unique_id", "file_path", "text")])
NAN = float("nan")


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def land(spark, folder, *rows):
    spark.createDataFrame(list(rows), FILES).coalesce(1).write.mode("append").parquet(folder)


def paths(index):
    return sorted(r["file_path"] for r in index.read().collect())


@pytest.mark.parametrize("odd", [[NAN, 1.0], [float("inf"), 1.0], [None, 1.0], None, [1.0]])
def test_odd_vectors_take_no_hits(spark, odd):
    good = [(i, [1.0, float(i)]) for i in range(1, 31)]
    rows = good + [(100 + i, odd) for i in range(12)]
    records = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "question_id long, question_embedding array<double>")
    hits = nearest(records, asked, 5, ids=["vec_id"], vector="embedding", dim=2).collect()
    assert sorted(r["vec_id"] for r in hits) == [26, 27, 28, 29, 30]


@pytest.fixture()
def pages(spark, tmp_path):
    index = PageIndex(spark, str(tmp_path / "index"))
    rows = [("a" if i % 2 else "b", f"f{i}", f"word{i} apples and pears") for i in range(12)]
    ingest(spark.createDataFrame(rows, FILES), index)
    return index, rows


def test_hits_after_an_append_are_not_doubled(spark, pages):
    index, rows = pages
    ingest(spark.createDataFrame(rows, FILES), index)
    asked = spark.createDataFrame([(1, "word3 apples")], "question_id long, question string")
    hits = retrieve(index.read(), asked, k=4).orderBy("rank").collect()
    assert [r["rank"] for r in hits] == [1, 2, 3, 4]
    assert [r["file_path"] for r in hits[:2]] == ["f3", "f3"]


def test_texts_are_read_from_files_with_hits_only(spark, pages):
    index, rows = pages
    for i in range(6):
        ingest(spark.createDataFrame([("c", f"late{i}", f"other{i} things")], FILES), index)
    asked = spark.createDataFrame([(1, "other2 things")], "question_id long, question string")
    found = retrieve(index.read(), asked, k=1)
    assert [r["file_path"] for r in found.collect()] == ["late2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "record_file" in plan or "file_path" in plan


def test_cells_with_tenants_and_unplaced_records(spark, pages):
    index, rows = pages
    records = index.read()
    centres = train_cells(records, 3, "text_embedding", iterations=2)
    placed = place_in_cells(records, centres, "text_embedding")
    asked = spark.createDataFrame(
        [(1, "word3 apples", ["a"]), (2, "word4 pears", ["b"])],
        "question_id long, question string, unique_ids array<string>",
    )
    exact = {(r["question_id"], r["file_path"]) for r in retrieve(records, asked, k=3).collect()}
    every = retrieve(placed, asked, k=3, centres=centres, n_probe=3)
    assert {(r["question_id"], r["file_path"]) for r in every.collect()} == exact
    one = retrieve(placed, asked, k=12, centres=centres, n_probe=1).collect()
    assert one and all(r["unique_id"] == {1: "a", 2: "b"}[r["question_id"]] for r in one)
    unplaced = placed.withColumn("cell", F.lit(None).cast("int"))
    none = retrieve(unplaced, asked, k=3, centres=centres, n_probe=1)
    assert {(r["question_id"], r["file_path"]) for r in none.collect()} == exact


def test_two_streams_into_one_index(spark, tmp_path):
    index = PageIndex(spark, str(tmp_path / "index"))
    land(spark, str(tmp_path / "x"), ("a", "f", "fine"), ("a", "g", "good"))
    land(spark, str(tmp_path / "y"), ("a", "h", "hello"))
    for name in "xy":
        drain(ingest_stream(upload_stream(spark, str(tmp_path / name), FILES), index, str(tmp_path / f"steps-{name}")))
    assert paths(index) == ["f", "g", "h"]


def test_lost_checkpoint_with_other_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    index = PageIndex(spark, str(tmp_path / "index"))
    land(spark, folder, ("a", "f", "fine"))
    drain(ingest_stream(upload_stream(spark, folder, FILES), index, str(tmp_path / "one")))
    land(spark, folder, ("a", "g", "good"))
    drain(ingest_stream(upload_stream(spark, folder, FILES), index, str(tmp_path / "one")))
    drain(ingest_stream(upload_stream(spark, folder, FILES), index, str(tmp_path / "two")))
    assert paths(index) == ["f", "g"]


def test_versions_after_the_last_delete_are_not_compared(spark, pages):
    index, rows = pages
    index.delete_path("f1")
    ingest(spark.createDataFrame([("a", "new", "text")], FILES), index)
    assert "f1" not in paths(index) and "new" in paths(index) and files_of(index.read()).count() == 12


def test_hung_calls_spoil_no_others(spark):
    def load():
        def client(text):
            if text.startswith("hang"):
                time.sleep(30)
            return text.upper()

        return client

    rows = [(f"hang{i}",) for i in range(8)] + [(f"good{i}",) for i in range(6)]
    frame = spark.createDataFrame(rows, "prompt string").coalesce(1)
    started = time.monotonic()
    done = complete_with(frame, load, "prompt", "reply", "failed", tries=1, timeout=1.0).collect()
    assert {r["reply"] for r in done if r["prompt"].startswith("good")} == {f"GOOD{i}" for i in range(6)}
    assert {r["reply"] for r in done if r["prompt"].startswith("hang")} == {"failed"}
    assert time.monotonic() - started < 25
