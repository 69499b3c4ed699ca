"""Ingestion: screen whole files, describe and embed the pages of clean ones, index them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagewarden.constants import DEFAULT_THRESHOLD, LINES_PER_PAGE
from pagewarden.functions.phrases import PhraseList
from pagewarden.functions.pii import RULES, Rule, entities, listed
from pagewarden.functions.text import or_placeholder, with_hashed_vector
from pagewarden.operators.index import PageIndex
from pagewarden.operators.detectors import Detector, detect_with
from pagewarden.operators.models import describe, refuse_warned
from pagewarden.operators.screening import (
    FILE_KEY,
    REPORT,
    accepted_pages,
    bad_pages,
    bulk_stats,
    clean_pages,
    gate_pages,
    gate_report,
    screen_documents,
    with_errors,
)
from pagewarden.session import drop_path, fresh_path
from pagewarden.sources.pages import split_pages

# A column of rows that must not be described.
WARNING = "pii_warning"

Step = Callable[[DataFrame], DataFrame]


def index_records(
    pages: DataFrame,
    describer: Step = describe,
    embedder: Callable[[DataFrame, str], DataFrame] = with_hashed_vector,
    embed_source: str = "llm_generated",
) -> DataFrame:
    """Records of accepted pages.

    `embed_source` is the description, or `text` for the page itself.
    """
    described = describer(pages).withColumn(
        "llm_generated", or_placeholder(F.col("llm_generated"))
    )
    records = embedder(described, embed_source).withColumn("contains_pii", F.lit(False))
    return records if "model_id" in records.columns else records.withColumn(
        "model_id", F.lit(None).cast("string")
    )


def requested(files: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (file_path, text) that requests (unique_id, file_path) ask for, and
    the requests no file answers.

    The tenant is the one of the request. Requests are narrow beside texts, so
    the planner sends them to the files as long as they are small enough.
    """
    found = files.drop("unique_id").join(requests, "file_path")
    missing = requests.join(files.select("file_path"), "file_path", "left_anti")
    return found, missing.withColumn("error", F.concat(F.lit("No such file: "), F.col("file_path")))


class Ingested(NamedTuple):
    """What became of the files of one call; `refused` and `detect_errors` count pages."""

    version: int
    files: int
    files_with_pii: int
    total_pages: int
    pages_with_pii: int
    refused: int
    detect_errors: int


def _found(pages: DataFrame, threshold, rules, detector, on_error) -> DataFrame:
    """Page rows with the findings of the rules, and of the detector if there is one."""
    ruled = listed(entities(F.col("text"), rules), threshold)
    if not detector:
        return pages.withColumns({"found": ruled, "detect_error": F.lit(None).cast("string")})
    detected = detect_with(pages, detector, threshold=threshold, on_error=on_error)
    return detected.withColumn("found", F.concat(ruled, F.col("found")))


def ingest_pages(
    pages: DataFrame,
    index: PageIndex,
    *,
    threshold: float = DEFAULT_THRESHOLD,
    rules: Iterable[Rule | PhraseList] = RULES,
    describer: Step = describe,
    embedder: Callable[[DataFrame, str], DataFrame] = with_hashed_vector,
    embed_source: str = "llm_generated",
    batch_id: str | None = None,
    replace: bool = False,
    gather: bool = True,
    rejects: str | None = None,
    detector: Callable[[], Detector] | None = None,
    on_error: str = "open",
) -> Ingested:
    """As `ingest`, for rows of pages: (unique_id, file_path, page_no, page_number, text).

    Pages come as rows from readers of binary files (`sources.pages.read_files`). They are
    screened once, into a table that the gate reads.
    """
    batch_id = batch_id or uuid.uuid4().hex
    place = fresh_path(pages.sparkSession, "screened")
    try:
        _found(pages, threshold, list(rules), detector, on_error).write.parquet(place)
        screened = pages.sparkSession.read.parquet(place)
        accepted, _, stats = gate_pages(screened)
        counts = bulk_stats(stats).first()
        errors = screened.where("detect_error IS NOT NULL").count()
        if rejects:
            bad = screened.where(F.size("found") > 0).select(*FILE_KEY, "page_no", "found")
            with_errors(bad).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        records = index_records(accepted.drop("detect_error"), describer, embedder, embed_source)
        return Ingested(index.append(records, batch_id, replace, gather), *counts, 0, errors)
    finally:
        drop_path(pages.sparkSession, place)


def ingest(
    documents: DataFrame,
    index: PageIndex,
    *,
    threshold: float = DEFAULT_THRESHOLD,
    rules: Iterable[Rule | PhraseList] = RULES,
    lines_per_page: int = LINES_PER_PAGE,
    describer: Step = describe,
    embedder: Callable[[DataFrame, str], DataFrame] = with_hashed_vector,
    embed_source: str = "llm_generated",
    batch_id: str | None = None,
    replace: bool = False,
    gather: bool = True,
    rejects: str | None = None,
    detector: Callable[[], Detector] | None = None,
    on_error: str = "open",
) -> Ingested:
    """Index the clean ones among (unique_id, file_path, text) rows; returns what became of all.

    All files are screened before any is described, for descriptions are the
    costly step. With `rejects`, the pages that rejected their files are written
    below that path, in a folder of the batch, before the version counts; a repeated
    batch overwrites them. Files are screened once either way.

    A `detector` finds personal data besides the rules, page by page; see
    `operators.detectors.detect_with`. Rows that carry a `pii_warning` are not described
    and not indexed; they stand among the rejects.
    """
    batch_id, rules = batch_id or uuid.uuid4().hex, list(rules)
    spark = documents.sparkSession
    refused = 0
    if WARNING in documents.columns:
        documents, warned = refuse_warned(documents, WARNING)
        documents, warned = documents.drop(WARNING), split_pages(warned, lines_per_page=lines_per_page)
        refused = warned.count()
        if rejects:
            warned.select(*FILE_KEY, "page_no", F.col(WARNING).alias("pii_warnings"), "error").write.mode(
                "overwrite"
            ).parquet(f"{rejects}/batch={batch_id}-refused")

    def index_pages(pages: DataFrame) -> int:
        return index.append(index_records(pages, describer, embedder, embed_source), batch_id, replace, gather)

    if detector:
        done = ingest_pages(
            split_pages(documents, lines_per_page=lines_per_page),
            index,
            threshold=threshold,
            rules=rules,
            describer=describer,
            embedder=embedder,
            embed_source=embed_source,
            batch_id=batch_id,
            replace=replace,
            gather=gather,
            rejects=rejects,
            detector=detector,
            on_error=on_error,
        )
        return done._replace(refused=refused)
    if not rejects:
        observed = Observation()
        version = index_pages(clean_pages(documents, threshold, rules, lines_per_page, observed))
        return Ingested(version, *[observed.get[name] or 0 for name in REPORT], refused, 0)
    place = fresh_path(spark, "screened")
    try:
        screen_documents(documents, threshold, rules, lines_per_page).write.parquet(place)
        screened = spark.read.parquet(place)
        bad_pages(screened).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        return Ingested(index_pages(accepted_pages(screened)), *gate_report(screened).first(), refused, 0)
    finally:
        drop_path(spark, place)
