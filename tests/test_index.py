import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewarden.operators.index import PageIndex, files_of
from pagewarden.plans.ingest import index_records, ingest, requested
from pagewarden.sources.pages import split_pages


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), "unique_id string, file_path string, text string")


def records(spark, *rows):
    return index_records(split_pages(documents(spark, *rows)))


@pytest.fixture
def index(spark, tmp_path):
    return PageIndex(spark, str(tmp_path / "index"))


def contents(index):
    return sorted((r["unique_id"], r["file_path"], r["num_pages"]) for r in files_of(index.read()).collect())


def test_create_twice(index):
    assert index.create() and not index.create()
    assert index.read().count() == 0
    assert index.tenants().collect() == []


def test_writing_to_a_created_index(spark, index):
    index.create()
    index.append(records(spark, ("a", "f", "x")))
    index.append(records(spark, ("a", "f", "x")).where("false"))
    assert contents(index) == [("a", "f", 1)]
    assert index.delete_path("f") == 1 and contents(index) == []


def test_each_task_may_write_for_itself(spark, index):
    index.append(records(spark, ("a", "f", "x"), ("b", "g", "y")), gather=False)
    assert contents(index) == [("a", "f", 1), ("b", "g", 1)]


def test_tenants_in_shared_folders(spark, tmp_path):
    index = PageIndex(spark, str(tmp_path / "index"), buckets=4)
    assert index.create()
    index.append(records(spark, *[(f"t{i}", "f", f"text {i}") for i in range(20)]))
    assert len(list((tmp_path / "index").glob("records/version=*/batch=*/bucket=*"))) <= 4
    assert len(contents(index)) == 20
    some = index.read(["t3", "t7"])
    assert sorted(r["llm_generated"] for r in some.collect()) == ["text 3", "text 7"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    assert index.delete_path("f", unique_id="t3") == 1
    assert len(contents(index.compact(str(tmp_path / "compact")))) == 19


def test_requests_for_files(spark):
    files = spark.createDataFrame([("f", "one"), ("g", "two")], "file_path string, text string")
    requests = spark.createDataFrame([("a", "f"), ("b", "f"), ("a", "none")], "unique_id string, file_path string")
    found, missing = requested(files, requests)
    assert sorted(map(tuple, found.select("unique_id", "text").collect())) == [("a", "one"), ("b", "one")]
    assert [r["error"] for r in missing.collect()] == ["No such file: none"]


def test_reading_no_index_fails(index):
    with pytest.raises(FileNotFoundError):
        index.read()


def test_append_adds_and_replace_replaces(spark, index):
    index.append(records(spark, ("a", "f", "old"), ("a", "g", "stays")))
    index.append(records(spark, ("a", "f", "old")))
    assert contents(index) == [("a", "f", 2), ("a", "g", 1)]
    index.append(records(spark, ("a", "f", "new")), replace=True)
    assert contents(index) == [("a", "f", 1), ("a", "g", 1)]
    assert {r["llm_generated"] for r in index.read().collect()} == {"new", "stays"}


def test_repeated_batch_is_written_once(spark, index):
    first = index.append(records(spark, ("a", "f", "x")), batch_id="b-0")
    index.append(records(spark, ("a", "g", "y")), batch_id="b-1")
    assert index.append(records(spark, ("a", "f", "x")), batch_id="b-0") == first
    assert contents(index) == [("a", "f", 1), ("a", "g", 1)]


def test_unfinished_write_is_not_read(spark, index):
    index.append(records(spark, ("a", "f", "x")), batch_id="whole")
    index.append(records(spark, ("a", "g", "y")), batch_id="broken")
    marker = next(Path(index.path).glob("records/version=*/batch=broken/_SUCCESS"))
    marker.unlink()
    assert contents(index) == [("a", "f", 1)]
    # The next write does not take the number of the broken one.
    assert index.append(records(spark, ("a", "h", "z"))) == 3


def test_tenant_names_survive_as_text(spark, index):
    index.append(records(spark, ("007", "f", "x"), ("a b/c=d", "g", "y"), ("2024-01-01", "h", "z")))
    assert [r["unique_id"] for r in index.tenants().collect()] == ["007", "2024-01-01", "a b/c=d"]


def test_delete_exact_and_match(spark, index):
    rows = [("a", "x/one.pdf", "1"), ("b", "x/one.pdf", "1"), ("a", "y/two.pdf", "2"), ("a", "z/three.txt", "3")]
    index.append(records(spark, *rows))
    assert index.delete_path("x/one") == 0
    assert index.delete_path("x/one.pdf", unique_id="b") == 1
    assert contents(index) == [("a", "x/one.pdf", 1), ("a", "y/two.pdf", 1), ("a", "z/three.txt", 1)]
    # One shared token is enough.
    assert index.delete_match("other.pdf") == 2
    assert contents(index) == [("a", "z/three.txt", 1)]
    assert index.delete_match("other.pdf") == 0


def test_delete_crosses_tenants_unless_told(spark, index):
    index.append(records(spark, ("a", "f", "1"), ("b", "f", "2")))
    assert index.delete_path("f") == 2


def test_file_can_come_back_after_a_delete(spark, index):
    index.append(records(spark, ("a", "f", "1")))
    index.delete_path("f")
    index.append(records(spark, ("a", "f", "2")))
    assert [r["llm_generated"] for r in index.read().collect()] == ["2"]


def test_bulk_and_manifest_delete(spark, index, tmp_path):
    index.append(records(spark, ("a", "f", "1"), ("a", "g", "2"), ("b", "f", "3"), ("b", "h", "4")))
    requests = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "g")], "unique_id string, file_path string")
    assert index.delete_files(requests) == 1
    (tmp_path / "m.json").write_text('[{"name": "f"}, {"name": "h"}, {"name": "none"}]')
    assert index.delete_manifest(str(tmp_path / "m.json")) == 2
    assert contents(index) == [("a", "g", 1)]


def test_compact_keeps_what_is_left(spark, index, tmp_path):
    index.append(records(spark, ("a", "f", "1"), ("b", "g", "2")))
    index.delete_path("f")
    target = index.compact(str(tmp_path / "compact"))
    assert contents(target) == [("b", "g", 1)]
    assert target.read().schema == index.read().schema


def test_ingest_then_delete_leaves_nothing(spark, index):
    ingest(documents(spark, ("a", "f", "fine"), ("a", "g", "a@b.com")), index)
    assert contents(index) == [("a", "f", 1)]
    assert index.delete_match("f") == 1
    assert contents(index) == []


def test_rejects_are_written(spark, index, tmp_path):
    path = str(tmp_path / "rejects")
    ingest(documents(spark, ("a", "f", "fine"), ("a", "g", "a@b.com")), index, rejects=path)
    rows = spark.read.parquet(path).collect()
    assert [(r["file_path"], r["page_no"]) for r in rows] == [("g", 1)]


def test_files_are_screened_once(spark, index, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked_at(text):
        seen.add(1)
        return text

    path = str(tmp_path / "rejects")
    files = documents(spark, ("a", "f", "fine"), ("a", "g", "a@b.com"))
    for _ in range(2):
        ingest(files.withColumn("text", looked_at.asNondeterministic()("text")), index, batch_id="one", rejects=path)
    assert seen.value == 4
    assert contents(index) == [("a", "f", 1)]
    assert spark.read.parquet(path).count() == 1


def test_tenants_in_pages(spark, index):
    index.append(records(spark, *[(f"t{i:02d}", "f", "x") for i in range(13)]))
    first = [r["unique_id"] for r in index.tenants().collect()]
    assert first == [f"t{i:02d}" for i in range(10)]
    rest = [r["unique_id"] for r in index.tenants(after=first[-1]).collect()]
    assert rest == ["t10", "t11", "t12"]


def test_list_docs(spark, index):
    index.append(records(spark, ("a", "f", "\n" * 10), ("b", "g", "x"), ("c", "h", "x")))
    rows = sorted(map(tuple, index.list_docs(["a", "b", "nobody"]).collect()))
    assert rows == [("a", "f", 2), ("b", "g", 1)]


def test_reading_a_tenant_prunes_partitions(spark, index):
    index.append(records(spark, ("a", "f", "1"), ("b", "g", "2")))
    plan = index.read(["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(unique_id" in plan and "= a)" in plan
