"""Files and raw pages as page rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.constants import LINES_PER_PAGE
from pagewarden.functions.text import page_texts, with_markup_text

# Pages of files that a task hands on at a time: characters, and rows.
FRAME_CHARS = 4 << 20
FRAME_ROWS = 10_000
# Spark's name for a folder without a key.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def page_name(page_no):
    return F.concat(F.lit("page_"), page_no.cast("string"))


def split_pages(
    documents: DataFrame, text: str = "text", lines_per_page: int = LINES_PER_PAGE
) -> DataFrame:
    """One row per page: the other columns, `page_no` from 1, `page_number`, `text`.

    Page i holds the text of page i; the reference's loop gives it the text of
    the page before.
    """
    others = [c for c in documents.columns if c != text]
    lined = documents.withColumn("_lines", F.split(text, "\n"))
    pages = lined.select(
        *others, F.posexplode(page_texts("_lines", lines_per_page)).alias("_at", "_page")
    )
    number = F.col("_at") + 1
    return pages.select(
        *others,
        number.alias("page_no"),
        page_name(number).alias("page_number"),
        F.col("_page").alias("text"),
    )


def web_pages(raw: DataFrame, html: str = "html") -> DataFrame:
    """Raw web pages with their readable text instead of the markup."""
    return with_markup_text(raw, html).drop(html)


def write_folders(rows: DataFrame, keys: list[str], path: str, line_end: str = "\n") -> None:
    """Text files in a folder for each combination of keys, as `partitionBy(*keys).text(path)`
    names the folders; keys are numbers or plain words, and equal ones should come to one task.

    For many small files. Hadoop starts two processes for each file on a local disk, which
    takes more time than all the rest, so tasks write there themselves.
    """
    place = urlparse(path)
    if place.scheme not in ("", "file"):
        rows.write.option("lineSep", line_end).partitionBy(*keys).text(path)
        return
    names = [
        F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY))) for key in keys
    ]
    (value,) = (name for name in rows.columns if name not in keys)
    root = place.path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = ((folder.as_py(), text) for batch in batches for folder, text in zip(*batch.columns))
        for folder, texts in groupby(cells, itemgetter(0)):
            os.makedirs(f"{root}/{folder}", exist_ok=True)
            # Under another name until it is whole: a task may be tried again.
            unfinished = f"{root}/{folder}/.{uuid.uuid4().hex}"
            with open(unfinished, "w", encoding="utf-8", newline="") as file:
                for _, text in texts:
                    file.write((text.as_py() or "") + line_end)
            os.replace(unfinished, f"{root}/{folder}/part.txt")
        yield from ()

    filed = rows.select(F.concat_ws("/", *names).alias("folder"), value).sortWithinPartitions("folder")
    filed.mapInArrow(write, "folder string").write.format("noop").mode("overwrite").save()
    os.makedirs(root, exist_ok=True)


def read_files(
    spark: SparkSession,
    path: str,
    extractor: Callable[[bytes], list[str]],
    pattern: str = "*.pdf",
) -> tuple[DataFrame, DataFrame]:
    """Pages of binary files, and the files that could not be read.

    `extractor` turns the bytes of one file into the texts of its pages. A file
    it fails on becomes a row of the second DataFrame and stops no other file.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("file_path"), "content")
    )

    def extracted(file_path: str, content: bytes) -> list[tuple]:
        try:
            texts = list(extractor(bytes(content)))
            return [(file_path, at, text, None) for at, text in enumerate(texts, 1)]
        except Exception as problem:
            return [(file_path, 0, None, f"{type(problem).__name__}: {problem}")]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A frame for each file costs more than most files; one for all of a batch may outgrow the worker.
        held, size = [], 0
        for batch in batches:
            for file_path, content in zip(batch["file_path"], batch["content"]):
                found = extracted(file_path, content)
                held += found
                size += sum(len(text or "") for _, _, text, _ in found)
                if size > FRAME_CHARS or len(held) > FRAME_ROWS:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    names = ["file_path", "page_no", "text", "error"]
    rows = files.mapInPandas(extract, "file_path string, page_no int, text string, error string")
    pages = rows.where("error is null").select(
        "file_path", "page_no", page_name(F.col("page_no")).alias("page_number"), "text"
    )
    return pages, rows.where("error is not null").select("file_path", "error")
