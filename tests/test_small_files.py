"""Many small files, written and read."""

import glob
import os

from pyspark.sql import functions as F

from pagewarden.sources import pages


def test_folders_are_those_that_spark_writes(spark, tmp_path):
    rows = [(i % 3, i, f"é text {i}") for i in range(20)] + [(1, None, "no key"), (2, 50, "one"), (2, 50, "one")]
    frame = spark.createDataFrame(rows, "shelf int, id int, value string").repartition(2, "shelf")
    frame.write.option("lineSep", " ").partitionBy("shelf", "id").text(f"{tmp_path}/spark")
    pages.write_folders(frame, ["shelf", "id"], f"{tmp_path}/own", line_end=" ")

    def held(place):
        files = glob.glob(f"{tmp_path}/{place}/shelf=*/id=*/*.txt")
        return {os.path.relpath(os.path.dirname(f), f"{tmp_path}/{place}"): open(f, encoding="utf-8").read() for f in files}

    assert held("own") == held("spark") and len(held("own")) == 22
    # Spark's writer leaves checksums and a marker; each was a file, and a process, more.
    assert sum(len(files) for _, _, files in os.walk(f"{tmp_path}/own")) == 22


def test_frames_of_pages_hold_many_files(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"{i}.txt").write_text("one\ntwo" if i else "bad")
    monkeypatch.setattr(pages, "FRAME_ROWS", 20)

    def extract(content):
        if content == b"bad":
            raise ValueError("no page")
        return content.decode().split("\n")

    found, failed = pages.read_files(spark, str(tmp_path), extract, "*.txt")
    assert found.count() == 58 and found.where("page_no = 2 AND text = 'two'").count() == 29
    assert [r["error"] for r in failed.collect()] == ["ValueError: no page"]
    assert found.select(F.countDistinct("file_path")).first()[0] == 29
