"""Nearest records for a table of questions.

Every task scores its records against a block of questions with one matrix
product and hands on its best k per question, so what is shuffled grows with
questions and tasks, never with pairs. Restricting a question to some records
(tenants, index cells) works by a `cell` column: a question is scored only in
the cells it visits.

Up to `QUESTION_LIMIT` questions are sent to the tasks, and the records are not
shuffled at all. More questions are laid out as blocks of records against blocks
of questions; a cell that holds much of the data becomes many blocks. Sparse counts
are scored by whole numbers (`pagewarden.operators.counting`), and without cells the
records pass by a block of questions some at a time: a task holds its questions and a
bounded number of records, however many it compares. Records are then known by a number
in the order of their ids, so that a hit is three numbers until the best are found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewarden.constants import DEFAULT_K, VECTOR_DIM
from pagewarden.operators.counting import Counts, CountSearch, best_by_counts
from pagewarden.schema import PAGE_KEY, PLACE
from pagewarden.session import bound_batches, drop_path, fresh_path

QUESTION_LIMIT = 4096
VISIT_LIMIT = 1_000_000
HIT_LIMIT = 100_000
PRUNE_LIMIT = 1_000
MERGE_WAYS = 64
# Numbers held at a time: in one matrix, in a block of records, in one of questions.
MATRIX_CELLS = 4_000_000
RECORD_CELLS = 8_000_000
QUESTION_CELLS = 8_000_000
# Sparse vectors in a block: rows, and places that are not zero.
SPARSE_ROWS = 1 << 17
RECORD_ENTRIES = 4_000_000
QUESTION_ENTRIES = 4_000_000
# Sparse vectors that pass by the questions at a time, and tasks for each core to do so.
PASSING_ROWS = 1 << 16
PASSING_ENTRIES = 4_000_000
PASSES = 3
# Hits of one question that are ranked without a step before.
RANKED_AT_ONCE = 100_000


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of doubles. A missing vector, one of the wrong length, or one with an element
    that is null or not finite, is all zeros."""
    return _matrix_and_lengths(vectors, dim)[0]


def _matrix_and_lengths(
    vectors: pa.Array | pa.ChunkedArray, dim: int, used: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles and the lengths of the vectors.

    With `used`, rows hold only those places; lengths are of the whole vectors.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if n and pa.types.is_struct(vectors.type):
        indices, values = vectors.field("indices"), vectors.field("values")
        rows = np.repeat(np.arange(n), _numbers(indices.value_lengths().fill_null(0)))
        places = _numbers(indices.flatten())
        weights = _numbers(values.flatten()).astype(np.float64)
        lengths = np.sqrt(np.bincount(rows, weights=weights * weights, minlength=n))
        if used is not None:
            column = np.full(dim, -1)
            column[used] = np.arange(len(used))
            places = column[places]
            kept = places >= 0
            rows, places, weights = rows[kept], places[kept], weights[kept]
        out = np.zeros((n, dim if used is None else len(used)))
        out[rows, places] = weights
        return _finite(out, lengths)
    out = np.zeros((n, dim))
    if n:
        sizes = _numbers(vectors.value_lengths().fill_null(0))
        flat = _numbers(vectors.flatten()).astype(np.float64)
        whole = sizes == dim
        out[whole] = flat[np.repeat(whole, sizes)].reshape(-1, dim)
    lengths = np.sqrt(np.einsum("ij,ij->i", out, out))
    out, lengths = _finite(out, lengths)
    return (out if used is None else out[:, used]), lengths


def _finite(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector with an element that is null or no finite number counts as all zeros."""
    bad = ~np.isfinite(lengths)
    if bad.any():
        rows[bad], lengths[bad] = 0.0, 0.0
    return rows, lengths


class _Questions:
    """Vectors of the questions, cut to the places any of them uses."""

    def __init__(self, vectors: pa.Array | pa.ChunkedArray, dim: int, metric: str):
        matrix, self.lengths = _matrix_and_lengths(vectors, dim)
        self.dim, self.metric = dim, metric
        used = np.flatnonzero(matrix.any(axis=0))
        # A cut costs more than it saves where most places are in use.
        self.used = used if len(used) < dim // 2 else None
        self.matrix = matrix if self.used is None else matrix[:, used]

    def __len__(self) -> int:
        return len(self.matrix)

    def scores(self, which: np.ndarray, records: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Questions by records: similarity + 1, to six places.

        Zero vectors have similarity 0.
        """
        similarity = self.matrix[which] @ records.T
        if self.metric == "cosine":
            # One division per vector; a vector of no length stays zero.
            similarity /= np.outer(_or_one(self.lengths[which]), _or_one(lengths))
        similarity += 1.0
        return np.floor(similarity * 1e6 + 0.5) / 1e6


def _or_one(lengths: np.ndarray) -> np.ndarray:
    return np.where(lengths > 0, lengths, 1.0)


def _id_order(ids: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    keys = pa.Table.from_batches([ids]).take(pa.array(rows))
    by_id = [(name, "ascending") for name in keys.column_names]
    return pc.sort_indices(keys, sort_keys=by_id).to_numpy()


class _Best:
    """Best k records per question among those offered, ties by record id."""

    def __init__(self, k: int, n_questions: int):
        self.k = k
        self.floor = np.full(n_questions, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.held = 0
        self.room = max(4 * k * n_questions, 100_000)

    def offer(
        self, which: np.ndarray, scores: np.ndarray, ids: pa.RecordBatch, rows: np.ndarray
    ) -> None:
        """Scores are questions `which` by records `rows`."""
        floor = self.floor[which]
        n = scores.shape[1]
        if n > self.k:
            kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
            floor = np.maximum(floor, kth)
        above, level = scores > floor[:, None], scores == floor[:, None]
        if np.count_nonzero(level) > 2 * self.k * len(which):
            # Many copies of one text: of equal scores the first k by id are enough.
            order = _id_order(ids, rows)
            ordered = level[:, order]
            level[:, order] = ordered & (np.cumsum(ordered, axis=1) <= self.k)
        question, record = np.nonzero(above | level)
        if len(question) == 0:
            return
        part = ids.take(pa.array(rows[record])).to_pandas()
        part.insert(0, "_q", which[question])
        part.insert(1, "_score", scores[question, record])
        self.parts.append(part)
        self.held += len(part)
        if self.held > self.room:
            self.trim()

    def trim(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        pool = pd.concat(self.parts, ignore_index=True)
        ids = list(pool.columns[2:])
        pool = pool.sort_values(["_q", "_score", *ids], ascending=[True, False] + [True] * len(ids))
        pool = pool[pool.groupby("_q").cumcount() < self.k]
        last = pool.groupby("_q")["_score"].agg(["size", "min"])
        full = last[last["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self.parts, self.held = [pool], len(pool)
        return pool


def _score_batch(
    best: _Best,
    questions: _Questions,
    visits: dict | None,
    batch: pa.RecordBatch,
    ids: list[str],
) -> None:
    """Offer the records of a batch, a matrix of bounded size at a time."""
    step = max(64, MATRIX_CELLS // max(questions.matrix.shape))
    for at in range(0, batch.num_rows, step):
        _score_slice(best, questions, visits, batch.slice(at, step), ids)


def _score_slice(best, questions, visits, batch, ids) -> None:
    records, lengths = _matrix_and_lengths(
        batch.column("_vector"), questions.dim, questions.used
    )
    keys = batch.select(ids)
    if visits is None:
        groups = [(np.arange(len(questions)), np.arange(len(records)))]
    else:
        codes, names = pd.factorize(batch.column("_cell").to_pandas().to_numpy())
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
        groups = [
            (visits[name], order[bounds[i] : bounds[i + 1]])
            for i, name in enumerate(names)
            if name in visits
        ]
    for which, rows in groups:
        best.offer(which, questions.scores(which, records[rows], lengths[rows]), keys, rows)


def _result(best: _Best, question_ids: pa.Array, schema: pa.Schema) -> pa.Table:
    pool = best.trim()
    if pool is None:
        return schema.empty_table()
    columns = [question_ids.take(pa.array(pool["_q"].to_numpy()))]
    columns += [pa.array(pool[name].to_numpy(), from_pandas=True) for name in pool.columns[2:]]
    columns.append(pa.array(pool["_score"].to_numpy()))
    return pa.table(
        [column.cast(field.type) for column, field in zip(columns, schema)], schema=schema
    )


def nearest(
    records: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    *,
    ids: list[str] = PAGE_KEY,
    vector: str = "text_embedding",
    question_id: str = "question_id",
    question_vector: str = "question_embedding",
    dim: int = VECTOR_DIM,
    metric: str = "cosine",
    cell: str | None = None,
    visits: DataFrame | None = None,
    question_limit: int = QUESTION_LIMIT,
) -> DataFrame:
    """Exact best k records per question: (question_id, rank, ids…, score).

    `metric` is `cosine` or `inner_product`. With `cell` and `visits`
    (question_id, cell) a question is compared only with records of its cells.
    """
    if metric not in ("cosine", "inner_product"):
        raise ValueError(f"unknown metric {metric!r}")
    if (cell is None) != (visits is None):
        raise ValueError("cell and visits go together")
    wanted = questions.select(
        F.col(question_id).alias("_qid"), F.col(question_vector).alias("_qvec")
    )
    candidates = records.select(
        *ids,
        F.col(vector).alias("_vector"),
        *([F.col(cell).alias("_cell")] if cell else []),
    )
    routes = (
        visits.select(F.col(question_id).alias("_qid"), F.col(cell).alias("_cell")).distinct()
        if cell
        else None
    )
    found_type = T.StructType(
        [T.StructField(question_id, wanted.schema["_qid"].dataType)]
        + [T.StructField(name, records.schema[name].dataType) for name in ids]
        + [T.StructField("score", T.DoubleType())]
    )

    # Both reads are bounded by their limits, whatever the tables hold.
    few = wanted.limit(question_limit + 1).toArrow()
    fits = few.num_rows <= question_limit
    few_routes = None
    if fits and routes is not None:
        few_routes = routes.limit(VISIT_LIMIT + 1).toArrow()
        fits = few_routes.num_rows <= VISIT_LIMIT
    if fits:
        found = _with_sent_questions(
            candidates, few, few_routes, k, ids, dim, metric, found_type
        )
        return _merge(found, k, question_id, ids)
    kinds = [rows.schema[name].dataType for rows, name in ((candidates, "_vector"), (wanted, "_qvec"))]
    numbered = None
    if routes is None and isinstance(kinds[0], T.StructType) and _same_kind(*kinds):
        numbered, numbers = _numbered(candidates, ids)
        found, parts = _with_passing_records(numbered, wanted, k, dim, metric, question_id)
        best = _merge(found, k, question_id, ["_no"], parts * k <= RANKED_AT_ONCE)
        hits = best.join(numbered.select("_no", *ids), "_no").select(question_id, "rank", *ids, "score")
    else:
        found, parts = _with_question_blocks(
            candidates, wanted, routes, k, ids, dim, metric, found_type
        )
        at_once = parts is not None and parts * k <= RANKED_AT_ONCE
        hits = _merge(found, k, question_id, ids, at_once)
    # As a table: counting the hits and fetching their records would each search anew.
    path = fresh_path(hits.sparkSession, "hits")
    hits.write.parquet(path)
    if numbered is not None:
        drop_path(hits.sparkSession, numbers)
    return hits.sparkSession.read.schema(hits.schema).parquet(path)


def _same_kind(left: T.DataType, right: T.DataType) -> bool:
    return left.simpleString() == right.simpleString()


def _with_sent_questions(candidates, few, few_routes, k, ids, dim, metric, found_type):
    visits = None
    if few_routes is not None:
        position = {q: i for i, q in enumerate(few["_qid"].to_pylist())}
        pairs: dict = {}
        for q, name in zip(few_routes["_qid"].to_pylist(), few_routes["_cell"].to_pylist()):
            if q in position and name is not None:
                pairs.setdefault(name, []).append(position[q])
        visits = {name: np.array(sorted(qs)) for name, qs in pairs.items()}
        if len(visits) <= PRUNE_LIMIT:
            # Reaches the scan: partitions and row groups of other cells are skipped.
            candidates = candidates.where(F.col("_cell").isin(list(visits)))
    # Plain data: unlike functions, broadcast values bring no classes along.
    payload = candidates.sparkSession.sparkContext.broadcast(
        (few["_qid"].combine_chunks(), few["_qvec"].combine_chunks(), visits)
    )
    schema = to_arrow_schema(found_type)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, vectors, routes = payload.value
        questions = _Questions(vectors, dim, metric)
        best = _Best(k, len(questions))
        if len(questions):
            for batch in batches:
                _score_batch(best, questions, routes, batch, ids)
        yield from _result(best, question_ids, schema).to_batches()

    return candidates.mapInArrow(score, found_type)


def _with_question_blocks(candidates, wanted, routes, k, ids, dim, metric, found_type):
    sparse = isinstance(candidates.schema["_vector"].dataType, T.StructType)
    n_questions = _n_blocks(wanted, "_qvec", QUESTION_CELLS, QUESTION_ENTRIES, dim)
    question_blocks = max(1, wanted.agg(n_questions).first()[0])
    asked = wanted.withColumn(
        "_block", F.pmod(F.xxhash64("_qid"), F.lit(question_blocks)).cast("int")
    )
    blocks = F.explode(F.sequence(F.lit(0), F.lit(question_blocks - 1).cast("int")))
    part = F.xxhash64(*ids)
    parts, most = _parts_of(candidates, dim), None
    if routes is None:
        most = candidates.agg(parts).first()[0]
        n_parts = F.lit(most).cast("bigint")
        asked = asked.withColumn("_cell", F.lit(0))
        placed = candidates.withColumn("_cell", F.lit(0)).withColumn("_parts", n_parts)
        asked = asked.withColumn("_parts", n_parts)
    else:
        # Cells that no question visits drop out with their records.
        visited = routes.select("_cell").distinct()
        sizes = candidates.join(visited, "_cell", "left_semi").groupBy("_cell").agg(parts.alias("_parts"))
        # Left to the planner, records would be shuffled by cell before it sees
        # how few the sizes are.
        sizes, few = pinned(sizes, VISIT_LIMIT)
        sizes = F.broadcast(sizes) if few else sizes
        placed = candidates.join(sizes, "_cell")
        asked = asked.join(routes, "_qid").join(sizes, "_cell")
    placed = (
        placed.withColumn("_part", F.pmod(part, F.col("_parts")))
        .withColumn("_block", blocks)
        .drop("_parts")
    )
    asked = asked.withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))
    ).drop("_parts")
    schema = to_arrow_schema(found_type)
    place = ["_cell", "_part", "_block"]
    step = max(1, QUESTION_CELLS // dim)

    def score_all(left: pa.Table, right: pa.Table) -> pa.Table:
        questions = _Questions(right["_qvec"], dim, metric)
        best = _Best(k, len(questions))
        for batch in left.to_batches():
            _score_batch(best, questions, None, batch, ids)
        return _result(best, right["_qid"].combine_chunks(), schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        found = []
        if sparse:
            # Counts are multiplied as such; what is no count, or long, goes with the rest.
            records = Counts(left["_vector"], dim)
            if records.whole.all():
                questions = Counts(right["_qvec"], dim)
                short = questions.short()
                found.append(score_counts(left, records, right.filter(pa.array(short)), questions.of(short)))
                right = right.filter(pa.array(~short))
        for at in range(0, right.num_rows, step):
            found.append(score_all(left, right.slice(at, step)))
        return pa.concat_tables(found) if found else schema.empty_table()

    def score_counts(left: pa.Table, records: Counts, right: pa.Table, questions: Counts) -> pa.Table:
        keys = left.select(ids).combine_chunks()
        by_id = pc.sort_indices(
            keys, sort_keys=[(name, "ascending") for name in ids], null_placement="at_start"
        ).to_numpy()
        question, record, scores = best_by_counts(records, questions, k, by_id, metric == "cosine")
        columns = [right["_qid"].take(pa.array(question)).combine_chunks()]
        columns += [keys[name].take(pa.array(record)).combine_chunks() for name in ids]
        columns.append(pa.array(scores))
        return pa.table(
            [column.cast(field.type) for column, field in zip(columns, schema)], schema=schema
        )

    pairs = placed.groupBy(*place).cogroup(asked.groupBy(*place))
    return pairs.applyInArrow(score, found_type), most


def _numbered(candidates: DataFrame, ids: list[str]) -> tuple[DataFrame, str]:
    """The records as a table with numbers in the order of their ids, and where it stands."""
    path = fresh_path(candidates.sparkSession, "numbered")
    ordered = candidates.select(*ids, "_vector").orderBy(*map(F.asc, ids))
    numbered = ordered.withColumn("_no", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return candidates.sparkSession.read.schema(numbered.schema).parquet(path), path


def _with_passing_records(numbered, wanted, k, dim, metric, question_id):
    """Best k (question, number of the record, score) of every part of the records."""
    # A batch waits whole for the questions to be gone through.
    bound_batches(numbered.sparkSession)
    cores = numbered.sparkSession.sparkContext.defaultParallelism
    blocks = _n_blocks(wanted, "_qvec", QUESTION_CELLS, QUESTION_ENTRIES, dim)
    n_blocks = max(1, wanted.agg(blocks).first()[0])
    most_parts = -(-PASSES * cores // n_blocks)
    few = min(max(1, RECORD_CELLS // dim), 1000)
    n_parts = max(1, min(-(-numbered.count() // few), most_parts))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    block = F.pmod(F.xxhash64("_qid"), F.lit(n_blocks)).cast("int")
    part = F.pmod(F.xxhash64("_no"), F.lit(n_parts)).cast("int")
    asked = wanted.withColumn("_block", block).withColumn("_part", every(n_parts))
    place = (F.col("_block") * n_parts + F.col("_part")).alias("_place")
    asked = asked.select(place, F.lit(None).cast("bigint").alias("_no"), "_qid", F.col("_qvec").alias("_vector"))
    passing = numbered.withColumn("_part", part).withColumn("_block", every(n_blocks))
    passing = passing.select(place, "_no", F.lit(None).cast(wanted.schema["_qid"].dataType).alias("_qid"), "_vector")
    # Questions have no number, so they come before the records of their place.
    laid = asked.unionByName(passing).repartitionById(n_blocks * n_parts, "_place")
    laid = laid.sortWithinPartitions("_place", "_no")
    found_type = T.StructType(
        [
            T.StructField(question_id, wanted.schema["_qid"].dataType),
            T.StructField("_no", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    schema = to_arrow_schema(found_type)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, at = None, None
        for batch in batches:
            places = batch.column("_place").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if lo < hi and places[lo] != at:
                    if search is not None:
                        yield from search.hits(schema)
                    search, at = _Passing(k, dim, metric), places[lo]
                if lo < hi:
                    search.take(batch.slice(lo, hi - lo))
        if search is not None:
            yield from search.hits(schema)

    return laid.mapInArrow(score, found_type), n_parts


class _Passing:
    """A block of questions by which records pass, some at a time.

    Whole counts are added up; what is no count, or long, is multiplied as numbers.
    """

    def __init__(self, k: int, dim: int, metric: str):
        self.k, self.dim, self.metric = k, dim, metric
        self.asked: list[pa.RecordBatch] = []
        self.waiting: list[pa.RecordBatch] = []
        self.rows = self.entries = 0
        self.counts: CountSearch | None = None

    def take(self, batch: pa.RecordBatch) -> None:
        """Questions first, then the records, which have a number."""
        n_asked = batch.column("_no").null_count
        if n_asked:
            self.asked.append(batch.slice(0, n_asked))
        records = batch.slice(n_asked)
        if records.num_rows and self.asked:
            self._begin()
        # A batch may be larger than what is wanted at a time.
        for at in range(0, records.num_rows, PASSING_ROWS):
            some = records.slice(at, PASSING_ROWS)
            self.waiting.append(some)
            self.rows += some.num_rows
            self.entries += pc.sum(some.column("_vector").field("indices").value_lengths()).as_py() or 0
            if self.rows >= PASSING_ROWS or self.entries >= PASSING_ENTRIES:
                self._pass()

    def _begin(self) -> None:
        asked = pa.Table.from_batches(self.asked)
        self.asked = []
        self.question_ids = asked["_qid"].combine_chunks()
        vectors = asked["_vector"].combine_chunks()
        questions = Counts(vectors, self.dim)
        short = questions.short()
        self.short, self.long = np.flatnonzero(short), np.flatnonzero(~short)
        self.long_vectors = vectors.take(pa.array(self.long))
        questions = questions if short.all() else questions.of(short)
        self.counts = CountSearch(questions, self.k, self.metric == "cosine")
        self.others: dict[tuple[bool, int], _Best] = {}

    def _pass(self) -> None:
        if not self.waiting or self.counts is None:
            return
        numbers, vectors = (
            pa.chunked_array([batch.column(name) for batch in self.waiting]).combine_chunks()
            for name in ("_no", "_vector")
        )
        self.waiting, self.rows, self.entries = [], 0, 0
        records, ranks = Counts(vectors, self.dim), numbers.to_numpy()
        whole = records.whole
        if whole.all():
            self.counts.offer(records, ranks)
        else:
            self.counts.offer(records.of(whole), ranks[whole])
            odd = pa.array(~whole)
            asked = self.counts.questions.vectors()
            self._multiply(True, asked, pa.record_batch([numbers.filter(odd), vectors.filter(odd)], ["_no", "_vector"]))
        if len(self.long):
            self._multiply(False, self.long_vectors, pa.record_batch([numbers, vectors], ["_no", "_vector"]))

    def _multiply(self, short: bool, asked: pa.Array, records: pa.RecordBatch) -> None:
        step = max(1, MATRIX_CELLS // self.dim)
        for at in range(0, len(asked), step):
            questions = _Questions(asked.slice(at, step), self.dim, self.metric)
            best = self.others.setdefault((short, at), _Best(self.k, len(questions)))
            _score_batch(best, questions, None, records, ["_no"])

    def hits(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self._pass()
        if self.counts is None:
            return
        question, numbers, scores = self.counts.best()
        found = [(self.short[question], numbers, scores)]
        step = max(1, MATRIX_CELLS // self.dim)
        for (short, at), best in self.others.items():
            pool = best.trim()
            if pool is not None:
                which = (self.short if short else self.long)[at : at + step]
                found.append((which[pool["_q"].to_numpy()], pool["_no"].to_numpy(), pool["_score"].to_numpy()))
        for question, numbers, scores in found:
            for lo in range(0, len(question), PASSING_ROWS):
                span = slice(lo, lo + PASSING_ROWS)
                ids = self.question_ids.take(pa.array(question[span])).cast(schema.field(0).type)
                yield pa.record_batch([ids, pa.array(numbers[span]), pa.array(scores[span])], schema=schema)


def _n_blocks(rows: DataFrame, vector: str, cells: int, entries: int, dim: int) -> Column:
    """Blocks of bounded size for all rows: by numbers held, for sparse vectors by places in use."""
    count = F.count(F.lit(1))
    if not isinstance(rows.schema[vector].dataType, T.StructType):
        return F.ceil(count / max(1, cells // dim))
    places = F.coalesce(F.sum(F.greatest(F.size(f"{vector}.values"), F.lit(0)).cast("bigint")), F.lit(0))
    return F.greatest(F.ceil(count / SPARSE_ROWS), F.ceil(places / entries))


def _parts_of(records: DataFrame, dim: int) -> Column:
    """Blocks for so many records: of bounded size, and for a few thousand records
    or more at least one per core."""
    cores = records.sparkSession.sparkContext.defaultParallelism
    by_size = _n_blocks(records, "_vector", RECORD_CELLS, RECORD_ENTRIES, dim)
    few = min(max(1, RECORD_CELLS // dim), 1000)
    by_cores = F.least(F.ceil(F.count(F.lit(1)) / few), F.lit(cores).cast("bigint"))
    return F.greatest(by_size, by_cores, F.lit(1).cast("bigint"))


def pinned(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The rows worked out once and held, if there are at most `limit`, and whether so.

    For rows of bounded width: vectors and ids, no texts.
    """
    few = rows.limit(limit + 1).toArrow()
    if few.num_rows > limit:
        return rows, False
    return rows.sparkSession.createDataFrame(few, rows.schema), True


def _merge(
    found: DataFrame, k: int, question_id: str, ids: list[str], at_once: bool = False
) -> DataFrame:
    """Best k of the tasks' best k: first in parts of each question's hits, then over all.
    Few enough are ranked `at_once`.

    The parts come from a hash of the ids; the task's number would do as well but
    counts as random, and the planner prunes no partitions by random hits.
    """
    order = [F.desc("score"), *map(F.asc, ids)]
    by_group = W.partitionBy(question_id, "_group").orderBy(*order)
    over_all = W.partitionBy(question_id).orderBy(*order)
    if not at_once:
        found = (
            found.withColumn("_group", F.pmod(F.xxhash64(*ids), F.lit(MERGE_WAYS)))
            .withColumn("rank", F.row_number().over(by_group))
            .where(F.col("rank") <= k)
        )
    return (
        found.withColumn("rank", F.row_number().over(over_all))
        .where(F.col("rank") <= k)
        .select(question_id, "rank", *ids, "score")
    )


def with_records(
    hits: DataFrame,
    records: DataFrame,
    questions: DataFrame,
    *,
    k: int = DEFAULT_K,
    ids: list[str] = PAGE_KEY,
    hit_limit: int = HIT_LIMIT,
) -> DataFrame:
    """Hits with the columns of their records.

    Texts are fetched for the hits only. A question has at most k hits, so up to
    `hit_limit` of them in all are worked out once and broadcast, and the records stay in
    place; with more the planner chooses. Records that carry their place (file and row)
    are found by it: equal keys stay apart, and only files that hold hits are read.
    """
    hits, few = pinned(hits, hit_limit)
    on = ids
    if set(PLACE) <= set(ids):
        # A place is never null, a key may be.
        on, records = PLACE, records.drop(*PAGE_KEY)
        files = [row[0] for row in hits.select(PLACE[0]).distinct().collect()] if few else []
        if few and len(files) <= PRUNE_LIMIT:
            records = records.where(F.col(PLACE[0]).isin(files))
    return records.join(F.broadcast(hits) if few else hits, on)


def all_questions(questions: DataFrame, hits: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Every question once, with its hits as an array by rank; empty if none was found."""
    fields = [c for c in hits.columns if c != question_id]
    ordered = [F.col("rank")] + [F.col(c) for c in fields if c != "rank"]
    grouped = hits.groupBy(question_id).agg(
        F.array_sort(F.collect_list(F.struct(*ordered))).alias("hits")
    )
    joined = questions.join(grouped, question_id, "left")
    none = F.array().cast(grouped.schema["hits"].dataType)
    return joined.withColumn("hits", F.coalesce("hits", none))


def hits_envelope(found: DataFrame, source_fields: Iterable[str]) -> DataFrame:
    """Nests the hits of `all_questions` as hits.hits[] of (_source, _score)."""
    names = list(source_fields)
    nested = F.transform(
        "hits",
        lambda hit: F.struct(
            F.struct(*[hit[name].alias(name) for name in names]).alias("_source"),
            hit["score"].alias("_score"),
        ),
    )
    return found.withColumn("hits", F.struct(nested.alias("hits")))


def tenant_visits(
    questions: DataFrame, question_id: str = "question_id", unique_ids: str = "unique_ids"
) -> DataFrame:
    """Which tenants each question may see: (question_id, unique_id)."""
    return questions.select(question_id, F.explode(unique_ids).alias("unique_id"))


def where_clauses(
    must: Iterable[Column] = (),
    should: Iterable[Column] = (),
    must_not: Iterable[Column] = (),
) -> Column:
    """One condition: all of `must`, any of `should`, none of `must_not`."""
    condition = F.lit(True)
    for clause in must:
        condition = condition & clause
    options = list(should)
    if options:
        any_of = F.lit(False)
        for clause in options:
            any_of = any_of | clause
        condition = condition & any_of
    for clause in must_not:
        condition = condition & ~clause
    return condition
