"""Questions: embed, find the nearest pages, build contexts and prompts, answer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.constants import DEFAULT_K, SUMMARY_QUESTION, VECTOR_DIM
from pagewarden.functions.prompts import answer_prompt, context_text
from pagewarden.functions.text import with_hashed_vector
from pagewarden.operators.cells import cell_visits
from pagewarden.operators.models import answer_with, best_hit_answer
from pagewarden.operators.search import (
    QUESTION_LIMIT,
    all_questions,
    nearest,
    pinned,
    tenant_visits,
    with_records,
)
from pagewarden.schema import PAGE_KEY, PLACE

NO_CELL = "none"
HIT_FIELDS = ["rank", "unique_id", "file_path", "page_no", "page_number", "llm_generated", "score"]


def retrieve(
    records: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    *,
    condition: Column | None = None,
    filter_mode: str = "pre",
    embedder: Callable[[DataFrame, str, str], DataFrame] = with_hashed_vector,
    dim: int = VECTOR_DIM,
    metric: str = "cosine",
    centres: np.ndarray | None = None,
    n_probe: int = 8,
    question_limit: int = QUESTION_LIMIT,
) -> DataFrame:
    """Best pages for (question_id, question[, unique_ids]) rows, one row per hit.

    A question with `unique_ids` sees pages of those tenants only. `condition`
    cuts the pages before the search (`pre`) or the k hits after it (`post`,
    which may leave fewer than k). With `centres`, only records in the `n_probe`
    cells nearest to a question, and those without a cell, are compared, so near
    pages may be missed; tenants and cells go together. Records read by
    `PageIndex.read` may be equal in all they hold and stay apart.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode must be 'pre' or 'post'")
    embedded = embedder(questions, "question", "question_embedding")
    # Used by the search and by the fetching of texts after it.
    asked, _ = pinned(embedded.select("question_id", "question_embedding"), question_limit)
    pool = records.where(condition) if condition is not None and filter_mode == "pre" else records
    cell = visits = None
    if "unique_ids" in questions.columns:
        cell, visits = "unique_id", tenant_visits(questions)
    # With every cell probed there is nothing to leave out.
    if centres is not None and n_probe < len(centres):
        near = cell_visits(asked, centres, n_probe).withColumn("cell", F.col("cell").cast("string"))
        unplaced = asked.select("question_id", F.lit(NO_CELL).alias("cell"))
        near = near.unionByName(unplaced)
        place = F.coalesce(F.col("cell").cast("string"), F.lit(NO_CELL))
        if cell:
            both = visits.join(near, "question_id")
            visits = both.select("question_id", F.concat_ws("/", "cell", "unique_id").alias("_visit"))
            pool = pool.withColumn("_visit", F.concat_ws("/", place, "unique_id"))
        else:
            visits = near.withColumnRenamed("cell", "_visit")
            pool = pool.withColumn("_visit", place)
        cell = "_visit"
    ids = [*PAGE_KEY, *(PLACE if set(PLACE) <= set(records.columns) else [])]
    hits = nearest(
        pool,
        asked,
        k,
        ids=ids,
        dim=dim,
        metric=metric,
        cell=cell,
        visits=visits,
        question_limit=question_limit,
    )
    found = with_records(hits, records, asked, k=k, ids=ids)
    if condition is not None and filter_mode == "post":
        found = found.where(condition)
    return found.select("question_id", *HIT_FIELDS)


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Every question with `hits`, `context` and `prompt`."""
    gathered = all_questions(questions, hits.select("question_id", *HIT_FIELDS))
    return gathered.withColumn("context", context_text(F.col("hits"))).withColumn(
        "prompt", answer_prompt(F.col("context"), F.col("question"))
    )


def answer(questions: DataFrame, hits: DataFrame, load: Callable | None = None, **options) -> DataFrame:
    """Adds `answer`: a model's reply, or the best hit's text without a model."""
    asked = prompts(questions, hits)
    if load is None:
        return asked.withColumn("answer", best_hit_answer())
    return answer_with(asked, load, **options)


def summary_questions(requests: DataFrame) -> DataFrame:
    """The fixed summary question for each (question_id, unique_ids) row."""
    return requests.select("question_id", F.lit(SUMMARY_QUESTION).alias("question"), "unique_ids")


def summarise(
    records: DataFrame, requests: DataFrame, k: int = DEFAULT_K, load: Callable | None = None
) -> DataFrame:
    """Summaries of tenants. The reference searches all tenants; this one the given."""
    questions = summary_questions(requests)
    return answer(questions, retrieve(records, questions, k), load)
