"""Nearest vectors and pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pagewarden.constants import WIDE_K
from pagewarden.operators.cells import CellIndex, place_in_cells, train_cells
from pagewarden.operators.search import (
    all_questions,
    hits_envelope as envelope_of,
    nearest,
    where_clauses,
    with_records,
)
from pagewarden.plans.ask import retrieve
from pagewarden.plans.ingest import ingest
from pagewarden.session import fresh_path
from workloads.inputs import documents, files, new_index, page_index, questions, table, vector_questions, vectors
from workloads.sqltext import COSINE, INDEXED, INNER, best_pages, best_vectors, with_

DIM = 64
N_CELLS = 32
N_LABEL_PROBES = 3
N_TENANTS = 4
LABELS = [0, 1, 2]


def _nearest_vectors(spark, sf_dir, k=10, records=None, **options):
    pool = vectors(spark, sf_dir) if records is None else records
    return nearest(
        pool,
        vector_questions(spark, sf_dir),
        k,
        ids=["vec_id"],
        vector="embedding",
        dim=DIM,
        **options,
    )


def knn_exact(spark, sf_dir):
    return _nearest_vectors(spark, sf_dir)


def knn_exact_blocks(spark, sf_dir):
    """The way taken when questions are too many to send to every task."""
    return _nearest_vectors(spark, sf_dir, question_limit=0)


def knn_k100(spark, sf_dir):
    return _nearest_vectors(spark, sf_dir, WIDE_K)


def knn_inner_product(spark, sf_dir):
    return _nearest_vectors(spark, sf_dir, metric="inner_product")


def knn_filtered_pre(spark, sf_dir):
    pool = vectors(spark, sf_dir).where(F.col("label").isin(LABELS))
    return _nearest_vectors(spark, sf_dir, records=pool)


def knn_filtered_post(spark, sf_dir):
    pool = vectors(spark, sf_dir)
    hits = with_records(
        _nearest_vectors(spark, sf_dir), pool, vector_questions(spark, sf_dir), ids=["vec_id"]
    )
    kept = hits.where(F.col("label").isin(LABELS))
    return kept.select("question_id", "rank", "vec_id", "score")


_cells = {}


def cell_index(spark, sf_dir, centres_of):
    """Vectors by cells, written once per session for each way to make the centres."""
    key = (spark.sparkContext.applicationId, sf_dir, centres_of.__name__)
    if key not in _cells:
        index = CellIndex(spark, fresh_path(spark, "cells"), ["vec_id"], tenant="label")
        index.build(vectors(spark, sf_dir), centres_of(vectors(spark, sf_dir)))
        _cells[key] = index
    return _cells[key]


def label_centres(pool):
    """A cell for each label: the mean of its vectors."""
    parts = pool.select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("centre"))
    centres = np.array([[x for _, x in row["centre"]] for row in rows.orderBy("label").collect()])
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def learnt_centres(pool):
    return train_cells(pool, N_CELLS)


def knn_cells(spark, sf_dir):
    """A third of the cells that labels make, each vector kept in two."""
    asked = vector_questions(spark, sf_dir)
    return cell_index(spark, sf_dir, label_centres).nearest(asked, n_probe=N_LABEL_PROBES)


def knn_cells_tenant(spark, sf_dir):
    """The same, and a question sees the vectors of one label only."""
    asked = vector_questions(spark, sf_dir)
    visits = asked.select("question_id", (F.col("question_id") % N_TENANTS).alias("label"))
    return cell_index(spark, sf_dir, label_centres).nearest(asked, n_probe=N_LABEL_PROBES, visits=visits)


def knn_cells_all(spark, sf_dir):
    """All of the cells that were learnt from the vectors."""
    asked = vector_questions(spark, sf_dir)
    return cell_index(spark, sf_dir, learnt_centres).nearest(asked, n_probe=N_CELLS)


def knn_cells_learnt(spark, sf_dir):
    """The nearest of the learnt cells; how many of the exact hits that finds."""
    asked = vector_questions(spark, sf_dir)
    found = cell_index(spark, sf_dir, learnt_centres).nearest(asked, n_probe=N_CELLS // 2)
    exact = knn_exact(spark, sf_dir).select("question_id", "vec_id", F.lit(1).alias("hit"))
    joined = exact.join(found.select("question_id", "vec_id", F.lit(1).alias("seen")), ["question_id", "vec_id"], "left")
    return joined.groupBy("question_id").agg(F.count("hit").alias("n_exact"), F.count("seen").alias("n_found"))


def text_retrieval(spark, sf_dir):
    hits = retrieve(page_index(spark, sf_dir).read(), questions(spark, sf_dir))
    return hits.select("question_id", "rank", "unique_id", "file_path", "page_no", "score")


def retrieval_after_append(spark, sf_dir):
    """The same files indexed twice without replacing: two records of each page, one hit each."""
    index = new_index(spark)
    for _ in range(2):
        ingest(documents(spark, sf_dir), index)
    hits = retrieve(index.read(), questions(spark, sf_dir))
    return hits.select("question_id", "rank", "unique_id", "file_path", "page_no", "score")


def text_cells_all(spark, sf_dir):
    """Text search over cells learnt from the page vectors, all of them probed."""
    records = page_index(spark, sf_dir).read()
    centres = train_cells(records, N_CELLS, "text_embedding", iterations=3)
    placed = place_in_cells(records, centres, "text_embedding")
    hits = retrieve(placed, questions(spark, sf_dir), centres=centres, n_probe=N_CELLS)
    return hits.select("question_id", "rank", "unique_id", "file_path", "page_no", "score")


def _tenant_questions(spark, sf_dir):
    """A question may see the tenant of the document of the same number."""
    owners = files(spark, sf_dir).select(
        F.col("doc_id").alias("question_id"), F.array("unique_id").alias("unique_ids")
    )
    return questions(spark, sf_dir).join(owners, "question_id")


def tenant_filter(spark, sf_dir):
    hits = retrieve(page_index(spark, sf_dir).read(), _tenant_questions(spark, sf_dir))
    return hits.select("question_id", "rank", "unique_id", "file_path", "page_no", "score")


def tenant_filter_blocks(spark, sf_dir):
    hits = retrieve(
        page_index(spark, sf_dir).read(), _tenant_questions(spark, sf_dir), question_limit=0
    )
    return hits.select("question_id", "rank", "unique_id", "file_path", "page_no", "score")


def _clauses():
    return where_clauses(
        must=[F.col("page_no") >= 2],
        should=[F.col("unique_id") == "src1", F.col("llm_generated").contains("tion")],
        must_not=[F.col("unique_id").isin("src2", "src3")],
    )


def bool_filter(spark, sf_dir):
    records = page_index(spark, sf_dir).read()
    hits = retrieve(records, questions(spark, sf_dir), condition=_clauses())
    return hits.select("question_id", "rank", "unique_id", "file_path", "page_no", "score")


def bool_filter_post(spark, sf_dir):
    records = page_index(spark, sf_dir).read()
    hits = retrieve(
        records, questions(spark, sf_dir), condition=_clauses(), filter_mode="post"
    )
    return hits.select("question_id", "rank", "unique_id", "file_path", "page_no", "score")


def retrieval_all_questions(spark, sf_dir):
    """Every question of the table, also those that may see no tenant with records."""
    asked = questions(spark, sf_dir)
    owners = files(spark, sf_dir).select(
        F.col("doc_id").alias("question_id"),
        F.when(F.length("text") < 1000, F.array("unique_id"))
        .otherwise(F.array().cast("array<string>"))
        .alias("unique_ids"),
    )
    hits = retrieve(page_index(spark, sf_dir).read(), asked.join(owners, "question_id"))
    return all_questions(asked, hits.select("question_id", "rank", "file_path", "score")).select(
        "question_id", F.size("hits").cast("bigint").alias("n_hits")
    )


def hits_envelope(spark, sf_dir):
    """The wide search of an agent's tool."""
    asked = questions(spark, sf_dir)
    hits = retrieve(page_index(spark, sf_dir).read(), asked, WIDE_K)
    nested = envelope_of(
        all_questions(asked, hits), ["unique_id", "file_path", "page_number", "llm_generated"]
    )
    return nested.select("question_id", F.posexplode("hits.hits").alias("place", "hit")).select(
        "question_id",
        "place",
        F.col("hit._source.file_path").alias("file_path"),
        F.col("hit._source.page_number").alias("page_number"),
        F.col("hit._source.llm_generated").alias("llm_generated"),
        F.col("hit._score").alias("score"),
    )


QUERIES = {
    "knn_exact": knn_exact,
    "knn_exact_blocks": knn_exact_blocks,
    "knn_k100": knn_k100,
    "knn_inner_product": knn_inner_product,
    "knn_filtered_pre": knn_filtered_pre,
    "knn_filtered_post": knn_filtered_post,
    "knn_cells": knn_cells,
    "knn_cells_tenant": knn_cells_tenant,
    "knn_cells_all": knn_cells_all,
    "knn_cells_learnt": knn_cells_learnt,
    "text_retrieval": text_retrieval,
    "retrieval_after_append": retrieval_after_append,
    "text_cells_all": text_cells_all,
    "tenant_filter": tenant_filter,
    "tenant_filter_blocks": tenant_filter_blocks,
    "bool_filter": bool_filter,
    "bool_filter_post": bool_filter_post,
    "retrieval_all_questions": retrieval_all_questions,
    "hits_envelope": hits_envelope,
}

_LABELS = "label IN (" + ", ".join(map(str, LABELS)) + ")"
_HIT = "SELECT question_id, rank, unique_id, file_path, page_no, score FROM hits"
_TENANT = with_(
    *INDEXED,
    *best_pages(visible="JOIN documents d ON d.doc_id = a.question_id AND d.source = r.unique_id"),
)
_CLAUSES = """(page_no >= 2 AND (unique_id = 'src1' OR contains(llm_generated, 'tion'))
       AND NOT unique_id IN ('src2', 'src3'))"""



def _in_cells(seen="true"):
    """Best vectors of the probed cells: of cells by label means, two homes and some probes each."""
    near = "round(list_cosine_similarity(a.embedding::DOUBLE[], c.centre), 9)"
    return f"""
WITH means AS (
  SELECT label, list(x ORDER BY i) AS centre FROM (
    SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, {DIM} + 1)) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label),
closest AS (
  SELECT a.vec_id, c.label AS cell, row_number() OVER (PARTITION BY a.vec_id ORDER BY {near} DESC, c.label) AS nth
  FROM embeddings a, means c),
asked AS (SELECT b.item_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
met AS (
  SELECT DISTINCT q.vec_id AS item_id, v.vec_id FROM closest q JOIN closest v USING (cell)
  WHERE q.nth <= {N_LABEL_PROBES} AND v.nth <= 2)
SELECT question_id, rank, vec_id, score FROM (
  SELECT item_id AS question_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT q.item_id, v.vec_id, round({COSINE} + 1.0, 6) AS score
        FROM asked q JOIN met USING (item_id) JOIN embeddings v USING (vec_id) WHERE {seen}))
WHERE rank <= 10"""


SQL = {
    "knn_exact": best_vectors(10, COSINE),
    "knn_exact_blocks": best_vectors(10, COSINE),
    "knn_k100": best_vectors(WIDE_K, COSINE),
    "knn_inner_product": best_vectors(10, INNER),
    "knn_filtered_pre": best_vectors(10, COSINE, where=_LABELS),
    "knn_filtered_post": best_vectors(10, COSINE, after=_LABELS),
    "knn_cells": _in_cells(),
    "knn_cells_tenant": _in_cells(f"v.label = q.item_id % {N_TENANTS}"),
    "knn_cells_all": best_vectors(10, COSINE),
    "text_retrieval": with_(*INDEXED, *best_pages()) + _HIT,
    "retrieval_after_append": with_(*INDEXED, *best_pages())
    + """SELECT * FROM (
  SELECT question_id, unique_id, file_path, page_no, score,
         CAST(row_number() OVER (PARTITION BY question_id
                                 ORDER BY score DESC, unique_id, file_path, page_no, copy) AS INTEGER) AS rank
  FROM scored, (VALUES (1), (2)) copies(copy)) WHERE rank <= 10""",
    "text_cells_all": with_(*INDEXED, *best_pages()) + _HIT,
    "tenant_filter": _TENANT + _HIT,
    "tenant_filter_blocks": _TENANT + _HIT,
    "bool_filter": with_(*INDEXED, *best_pages(visible=f"WHERE {_CLAUSES}")) + _HIT,
    "bool_filter_post": with_(*INDEXED, *best_pages()) + _HIT + f" WHERE {_CLAUSES}",
    "retrieval_all_questions": with_(
        *INDEXED,
        *best_pages(
            visible="""JOIN documents d ON d.doc_id = a.question_id AND d.source = r.unique_id
              AND length(d.text) < 1000"""
        ),
    )
    + """SELECT item_id AS question_id, count(h.rank) AS n_hits
FROM benchmark LEFT JOIN hits h ON h.question_id = item_id GROUP BY ALL""",
    "hits_envelope": with_(*INDEXED, *best_pages(WIDE_K))
    + """SELECT question_id, CAST(rank - 1 AS INTEGER) AS place, file_path, page_number, llm_generated, score
FROM hits""",
}
