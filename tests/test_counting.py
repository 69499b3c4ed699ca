"""Search over blocks of sparse counts against a plain one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pagewarden.operators import counting, search
from pagewarden.operators.counting import Counts, best_by_counts

DIM = 40
SPARSE = "struct<indices:array<int>,values:array<int>>"


def vectors(rng, n, most=4):
    made = []
    for _ in range(n):
        places = rng.choice(DIM, rng.integers(0, 9), replace=False)
        made.append({"indices": sorted(places.tolist()), "values": rng.integers(1, most + 1, len(places)).tolist()})
    return made


def plain(records, asked, k, by_id, cosine=True):
    """(question, record, score): every pair scored with matrices of doubles."""
    def dense(rows):
        out = np.zeros((len(rows), DIM))
        for i, row in enumerate(rows):
            out[i, row["indices"]] = row["values"]
        return out

    left, right = dense(asked), dense(records)
    similarity = left @ right.T
    if cosine:
        lengths = [np.sqrt((m * m).sum(axis=1)) for m in (left, right)]
        similarity /= np.outer(*[np.where(x > 0, x, 1.0) for x in lengths])
    scores = np.floor((similarity + 1.0) * 1e6 + 0.5) / 1e6
    rank = np.empty(len(records), int)
    rank[by_id] = np.arange(len(records))
    return [
        (q, r, scores[q, r])
        for q in range(len(asked))
        for r in sorted(range(len(records)), key=lambda r: (-scores[q, r], rank[r]))[:k]
    ]


def counts(rows):
    kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.int32()))])
    return Counts(pa.array(rows, kind), DIM)


@pytest.mark.parametrize("most", [1, 4, 60, 300, 70_000])
@pytest.mark.parametrize("cosine", [True, False])
def test_best_by_counts(monkeypatch, most, cosine):
    monkeypatch.setattr(counting, "SIDE_BY_SIDE", 32)
    monkeypatch.setattr(counting, "HELD", 50)
    rng = np.random.default_rng(most)
    records, asked = vectors(rng, 300, most), vectors(rng, 40)
    # Copies, more of them than hits are wanted, and records that share no word with anything.
    records += [records[7]] * 50 + [{"indices": [], "values": []}] * 3
    by_id = rng.permutation(len(records))
    questions = counts(asked)
    assert questions.short().all()
    got = best_by_counts(counts(records), questions, 5, by_id, cosine)
    assert list(zip(*(x.tolist() for x in got))) == plain(records, asked, 5, by_id, cosine)


def test_fewer_records_than_hits():
    rng = np.random.default_rng(2)
    records, asked = vectors(rng, 3), vectors(rng, 4)
    got = best_by_counts(counts(records), counts(asked), 10, np.arange(3), True)
    assert list(zip(*(x.tolist() for x in got))) == plain(records, asked, 10, np.arange(3))


def test_what_is_short():
    rows = [
        {"indices": [1], "values": [counting.MOST_WORDS]},
        {"indices": [1], "values": [counting.MOST_WORDS + 1]},
        {"indices": [1, 1], "values": [1, 2]},
        {"indices": [1], "values": [-1]},
        {"indices": [1], "values": [None]},
        {"indices": None, "values": None},
        None,
    ]
    assert counts(rows).short().tolist() == [True, False, False, False, False, True, True]


@pytest.mark.parametrize("odd", [False, True])
def test_blocks_find_what_sent_questions_find(spark, monkeypatch, odd):
    """Long questions, null vectors and, if odd, a count below zero go the dense way."""
    monkeypatch.setattr(search, "SPARSE_ROWS", 70)
    rng = np.random.default_rng(3)
    records = [(i // 2, f"r{i % 2}", v) for i, v in enumerate(vectors(rng, 200) + [None, None])]
    if odd:
        records.append((500, "r0", {"indices": [3, 5], "values": [-2, 1]}))
    asked = [(i, v) for i, v in enumerate(vectors(rng, 90) + vectors(rng, 10, 300) + [None])]
    left = spark.createDataFrame(records, f"a int, b string, text_embedding {SPARSE}")
    right = spark.createDataFrame(asked, f"question_id int, question_embedding {SPARSE}")

    def found(limit):
        hits = search.nearest(left, right, 5, ids=["a", "b"], dim=DIM, question_limit=limit)
        return sorted(map(tuple, hits.collect()))

    assert found(0) == found(1000)


def test_records_are_copied_for_few_blocks(spark, monkeypatch):
    """Blocks were cut as if every place were in use: one for each 5 records here."""
    monkeypatch.setattr(search, "QUESTION_CELLS", 5 * DIM)
    monkeypatch.setattr(search, "RECORD_CELLS", 5 * DIM)
    rows = [(i, v) for i, v in enumerate(vectors(np.random.default_rng(4), 60))]
    table = spark.createDataFrame(rows, f"id int, v {SPARSE}")
    blocks = search._n_blocks(table, "v", search.QUESTION_CELLS, search.QUESTION_ENTRIES, DIM)
    assert table.agg(blocks).first()[0] == 1


def test_hits_are_worked_out_once(spark):
    """Counting the hits and fetching their records must not search twice."""
    rows = [(i, v) for i, v in enumerate(vectors(np.random.default_rng(5), 20))]
    left = spark.createDataFrame(rows, f"id int, text_embedding {SPARSE}")
    right = left.toDF("question_id", "question_embedding")
    hits = search.nearest(left, right, 3, ids=["id"], dim=DIM, question_limit=0)
    assert "FlatMapCoGroups" not in hits._jdf.queryExecution().executedPlan().toString()


def passing(records, asked, size):
    """Batches as a task gets them: questions first, then the records."""
    kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.int32()))])
    numbers = [None] * len(asked) + list(range(len(records)))
    ids = [*range(len(asked)), *[None] * len(records)]
    columns = [pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array(asked + records, kind)]
    batch = pa.record_batch(columns, names=["_no", "_qid", "_vector"])
    return [batch.slice(at, size) for at in range(0, batch.num_rows, size)]


@pytest.mark.parametrize("rows, entries", [(64, 10**6), (10**6, 300), (7, 10**6)])
def test_a_task_holds_few_of_the_records(monkeypatch, rows, entries):
    """All records of a block, 16 million places, were held and copied several times at once."""
    monkeypatch.setattr(search, "PASSING_ROWS", rows)
    monkeypatch.setattr(search, "PASSING_ENTRIES", entries)
    rng = np.random.default_rng(6)
    records, asked = vectors(rng, 500), vectors(rng, 40) + vectors(rng, 5, 300)
    records[100:300:20] = [{"indices": [3, 5], "values": [-2, 1]}] * 10
    block = search._Passing(5, DIM, "cosine")
    for batch in passing(records, asked, 33):
        block.take(batch)
        assert block.rows < rows and block.entries < entries
        assert sum(len(some) for some in block.waiting) == block.rows
    schema = pa.schema([("q", pa.int64()), ("_no", pa.int64()), ("score", pa.float64())])
    found = [tuple(row.values()) for batch in block.hits(schema) for row in batch.to_pylist()]
    # Counts and other records each give their best.
    best = [hit for q in range(len(asked)) for hit in sorted((h for h in found if h[0] == q), key=lambda h: (-h[2], h[1]))[:5]]
    assert best == plain(records, asked, 5, np.arange(len(records)))


def test_records_offered_in_any_order():
    rng = np.random.default_rng(8)
    records, asked = vectors(rng, 300) + [{"indices": [], "values": []}] * 3, vectors(rng, 30)
    one_by_one = counting.CountSearch(counts(asked), 5, True)
    offered = counts(records)
    for some in np.array_split(rng.permutation(len(records)), 9):
        one_by_one.offer(offered.of(some), some)
    got = list(zip(*(x.tolist() for x in one_by_one.best())))
    assert got == plain(records, asked, 5, np.arange(len(records)))


def test_ranking_leaves_other_questions_alone(monkeypatch):
    """Each addition sorted the hits of all questions of the block again."""
    ranking = counting._Ranking(2, 1000)
    everyone = np.arange(1000)
    ranking.add(everyone, everyone, np.ones(1000))
    sorted_rows = []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    ranking.add(np.array([3, 3, 7]), np.array([1, 2, 5]), np.array([1.5, 1.0, 1.0]))
    assert sorted_rows == [5]
    question, ranks, _ = ranking.best()
    assert ranks[question == 3].tolist() == [1, 2] and ranks[question == 7].tolist() == [5, 7]
