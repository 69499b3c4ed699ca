"""What the physical plans must and must not hold."""

import re

import pytest

from pagewarden.operators.screening import (
    accepted_pages,
    bulk_stats,
    clean_pages,
    file_stats,
    screen_documents,
)
from pagewarden.operators.index import files_of
from pagewarden.plans.ingest import index_records

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def documents(spark):
    scan = spark.read.parquet(DOCUMENTS)
    return scan.selectExpr("source AS unique_id", "string(doc_id) AS file_path", "text")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SCREENING = {
    "yes or no": clean_pages,
    "listed": lambda d: accepted_pages(screen_documents(d)),
    "stats": lambda d: file_stats(screen_documents(d)),
}


@pytest.mark.parametrize("step", SCREENING.values(), ids=SCREENING)
def test_screening_neither_shuffles_nor_leaves_the_jvm(documents, step):
    text = plan(step(documents))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_embedding_does_not_shuffle(documents):
    text = plan(index_records(clean_pages(documents)))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


def test_texts_are_cut_and_screened_once(documents):
    text = plan(index_records(clean_pages(documents)))
    assert len(re.findall(r"split\(text", text)) == 1
    assert len(re.findall(r"exists\(", text)) == 1
    assert len(re.findall(r"regexp_extract_all\(.{0,40}@", plan(accepted_pages(screen_documents(documents))))) <= 1


def test_totals_are_added_up_before_the_shuffle(documents):
    text = plan(bulk_stats(file_stats(screen_documents(documents))))
    assert "partial_sum" in text


def test_counting_reads_no_text(spark, documents):
    from workloads.inputs import page_index

    text = plan(files_of(page_index(spark, "/root/testdata/sf0.001").read()))
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schema and all("llm_generated" not in s and "embedding" not in s for s in schema)
