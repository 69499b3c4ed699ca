import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.operators import search
from pagewarden.functions.text import with_hashed_vector
from pagewarden.operators.cells import (
    CellIndex,
    cell_visits,
    place_in_cells,
    read_centres,
    train_cells,
    write_centres,
)
from pagewarden.operators.index import PageIndex
from pagewarden.operators.search import (
    all_questions,
    hits_envelope,
    nearest,
    where_clauses,
    with_records,
)
from pagewarden.plans.ask import retrieve
from pagewarden.plans.ingest import index_records
from pagewarden.sources.pages import split_pages

DIM = 8


def brute(records, questions, k, metric="cosine", allowed=None):
    """{question: [(id, score), …]} by comparing everything."""
    out = {}
    for q, qv in questions:
        scored = []
        for rid, group, v in records:
            if allowed is not None and group not in allowed.get(q, ()):
                continue
            a = np.zeros(DIM) if v is None or len(v) != DIM else np.float32(v).astype(float)
            b = np.float32(qv).astype(float)
            s = float(a @ b)
            if metric == "cosine":
                n = np.sqrt(a @ a) * np.sqrt(b @ b)
                s = s / n if n > 0 else 0.0
            scored.append((-(np.floor((s + 1) * 1e6 + 0.5) / 1e6), rid))
        out[q] = [(rid, -s) for s, rid in sorted(scored)[:k]]
    return out


def as_dict(hits):
    out = {}
    for r in hits.orderBy("question_id", "rank").collect():
        out.setdefault(r["question_id"], []).append((r["rid"], r["score"]))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    # Few distinct coordinates make many equal scores; a third of the rows is one vector.
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 5}", [float(x) for x in rng.integers(-2, 3, DIM)]) for i in range(600)]
    same = [1.0] * DIM
    rows += [(1000 + i, "hot", same) for i in range(300)]
    rows += [(2000, "g1", None), (2001, "g1", []), (2002, "g2", [0.0] * DIM), (2003, "g2", [1.0, 2.0])]
    questions = [(f"q{i}", [float(x) for x in rng.integers(-2, 3, DIM)]) for i in range(7)]
    questions += [("zero", [0.0] * DIM), ("same", same)]
    records = spark.createDataFrame(rows, "rid long, grp string, vec array<float>").repartition(5)
    asked = spark.createDataFrame(questions, "question_id string, question_embedding array<float>")
    return rows, questions, records, asked


def run(data, k=10, **options):
    _, _, records, asked = data
    return nearest(records, asked, k, ids=["rid"], vector="vec", dim=DIM, **options)


@pytest.fixture(params=[4096, 0], ids=["sent", "blocks"])
def limit(request, monkeypatch):
    # Small blocks, so that the hot group is cut up.
    monkeypatch.setattr(search, "RECORD_CELLS", 50 * DIM)
    monkeypatch.setattr(search, "QUESTION_CELLS", 4 * DIM)
    monkeypatch.setattr(search, "MATRIX_CELLS", 100 * DIM)
    return request.param


@pytest.mark.parametrize("k", [1, 10, 250, 2000])
def test_exact(data, limit, k):
    assert as_dict(run(data, k, question_limit=limit)) == brute(*data[:2], k)


def test_inner_product(data, limit):
    got = as_dict(run(data, metric="inner_product", question_limit=limit))
    assert got == brute(*data[:2], 10, "inner_product")


def test_groups(spark, data, limit):
    allowed = {f"q{i}": ["hot", f"g{i % 5}"] for i in range(5)} | {"q5": ["nobody"], "same": ["g0"]}
    visits = spark.createDataFrame([(q, g) for q, gs in allowed.items() for g in gs * 2], "question_id string, grp string")
    got = as_dict(run(data, cell="grp", visits=visits, question_limit=limit))
    expected = {q: hits for q, hits in brute(*data[:2], 10, allowed=allowed).items() if hits}
    assert got == expected and "q5" not in got


def test_no_questions(spark, data, limit):
    rows, questions, records, asked = data
    got = nearest(records, asked.where("false"), ids=["rid"], vector="vec", dim=DIM, question_limit=limit)
    assert got.count() == 0


def test_no_records(spark, data, limit):
    rows, questions, records, asked = data
    got = nearest(records.where("false"), asked, ids=["rid"], vector="vec", dim=DIM, question_limit=limit)
    assert got.count() == 0


def test_bad_options(data):
    with pytest.raises(ValueError):
        run(data, metric="euclid")
    with pytest.raises(ValueError):
        run(data, cell="grp")


def test_all_cells_is_exact_and_fewer_is_a_share(spark, data):
    rows, questions, records, asked = data
    centres = train_cells(records.where("size(vec) = 8"), 6, "vec")
    placed = place_in_cells(records, centres, "vec")
    exact = brute(rows, questions, 10)

    def probe(n):
        visits = cell_visits(asked, centres, n)
        return as_dict(nearest(placed, asked, ids=["rid"], vector="vec", dim=DIM, cell="cell", visits=visits))

    assert probe(6) == exact
    recall = []
    for n in (1, 3, 6):
        got = probe(n)
        recall.append(sum(len({r for r, _ in got.get(q, [])} & {r for r, _ in exact[q]}) for q in exact))
    assert recall[0] <= recall[1] <= recall[2] == 10 * len(questions)
    assert recall[1] > 0.5 * recall[2]


def test_index_by_cells(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a", f"f{i}", " ".join([f"w{i % 3}"] * 3 + [f"x{i}"])) for i in range(30)],
        "unique_id string, file_path string, text string",
    )
    plain = index_records(split_pages(docs))
    write_centres(spark, train_cells(plain, 3, "text_embedding"), str(tmp_path / "centres"))
    centres = read_centres(spark, str(tmp_path / "centres"))
    assert centres.shape == (3, 1536)

    def embed(df, column):
        return place_in_cells(with_hashed_vector(df, column), centres, "text_embedding")

    index = PageIndex(spark, str(tmp_path / "index"))
    index.append(index_records(split_pages(docs), embedder=embed))
    asked = spark.createDataFrame([(1, "w1 x4"), (2, "w2")], "question_id int, question string")

    def hits(**options):
        return sorted(map(tuple, retrieve(index.read(), asked, 5, **options).collect()))

    assert hits(centres=centres, n_probe=3) == hits()
    scored = retrieve(index.read(), asked, 30).select("question_id", "file_path", "score")
    some = retrieve(index.read(), asked, 5, centres=centres, n_probe=1).select(scored.columns)
    assert 0 < some.count() <= 10 and {*some.collect()} <= {*scored.collect()}


def test_filter_after_is_part_of_the_unfiltered(data):
    rows, _, records, asked = data
    hits = run(data)
    kept = with_records(hits, records, asked, ids=["rid"]).where("grp = 'g1'").select(hits.columns)
    everything = {tuple(r) for r in hits.collect()}
    some = {tuple(r) for r in kept.collect()}
    assert some < everything


def test_records_of_hits_both_ways(data):
    rows, _, records, asked = data
    hits = run(data)
    few, many = (
        with_records(hits, records, asked, ids=["rid"], hit_limit=n).select("question_id", "rid", "grp").collect()
        for n in (search.HIT_LIMIT, 0)
    )
    assert sorted(few) == sorted(many) and len(few) == hits.count()


def test_many_hits_keep_records_without_a_key(spark):
    """Joined by their keys, records with a null in these lost their hits where hits were many."""
    records = spark.createDataFrame(
        [(None, "f", 0, "a", 0, "x"), ("t", None, 0, "a", 1, "y"), ("t", "f", 0, "b", 0, "z")],
        "unique_id string, file_path string, page_no int, record_file string, record_row long, llm_generated string",
    )
    ids = [*search.PAGE_KEY, *search.PLACE]
    hits = records.select(F.lit(1).alias("question_id"), F.lit(1).alias("rank"), *ids, F.lit(1.0).alias("score"))
    few, many = (
        with_records(hits, records, None, ids=ids, hit_limit=n).select("unique_id", "file_path", "llm_generated").collect()
        for n in (search.HIT_LIMIT, 0)
    )
    assert len(many) == 3 and set(few) == set(many)


def test_every_question_has_a_row(spark, data):
    rows, questions, records, asked = data
    visits = spark.createDataFrame([("q0", "g1")], "question_id string, grp string")
    hits = run(data, 2, cell="grp", visits=visits)
    got = {r["question_id"]: r["hits"] for r in all_questions(asked.select("question_id"), hits).collect()}
    assert len(got) == len(questions) and [h["rank"] for h in got["q0"]] == [1, 2]
    assert got["q1"] == []
    nested = hits_envelope(all_questions(asked.select("question_id"), hits), ["rid"]).where("question_id = 'q0'").first()
    assert [h["_source"]["rid"] for h in nested["hits"]["hits"]] == [h["rid"] for h in got["q0"]]


def test_clauses(spark):
    df = spark.range(10)
    even, big, five = F.col("id") % 2 == 0, F.col("id") > 6, F.col("id") == 5
    def ids(**c):
        return [r[0] for r in df.where(where_clauses(**c)).orderBy("id").collect()]
    assert ids() == list(range(10))
    assert ids(must=[even], must_not=[big]) == [0, 2, 4, 6]
    assert ids(should=[big, five]) == [5, 7, 8, 9]
    assert ids(must=[even], should=[big, five]) == [8]


def test_cell_index(spark, data, tmp_path):
    rows, questions, records, asked = data
    sound = records.where(f"size(vec) = {DIM}")
    index = CellIndex(spark, str(tmp_path / "cells"), ["rid"], vector="vec", tenant="grp")
    with pytest.raises(FileNotFoundError):
        index.read()
    centres = train_cells(sound, 6, "vec")
    assert index.build(records, centres, group_bytes=1 << 14) == 1
    kept, read = index.read()
    assert kept.count() == 2 * records.count() and np.allclose(read, centres)
    whole = index.nearest(asked, 10, n_probe=6)
    exact = run(data, 10)
    assert sorted(whole.select(exact.columns).collect()) == sorted(exact.collect())
    # Fewer cells: hits are scored exactly and each comes once; the filter reaches the scan.
    some = index.nearest(asked, 10, n_probe=2)
    found = as_dict(some)
    assert all(len({rid for rid, _ in hits}) == len(hits) for hits in found.values())
    scores = as_dict(run(data, len(rows)))
    assert all(dict(scores[q])[rid] == score for q, hits in found.items() for rid, score in hits)
    assert "PushedFilters: [In(cell" in index.nearest(asked, 10, n_probe=1)._jdf.queryExecution().executedPlan().toString()
    # Tenants: what one question sees of its tenant, with all cells probed, is exact.
    visits = spark.createDataFrame([("q0", "g1"), ("q1", "hot")], "question_id string, grp string")
    seen = as_dict(index.nearest(asked, 10, n_probe=6, visits=visits))
    assert seen == brute(rows, [q for q in questions if q[0] in ("q0", "q1")], 10, allowed={"q0": {"g1"}, "q1": {"hot"}})
    assert index.build(sound, centres) == 2


def test_recall_of_cells(spark, tmp_path):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(40, 16))
    vectors = [(i, (middles[i % 40] + 0.6 * rng.normal(size=16)).tolist()) for i in range(4000)]
    pool = spark.createDataFrame(vectors, "rid int, v array<double>")
    asked = pool.where("rid % 40 = 7 and rid < 2000").selectExpr("rid as question_id", "v as question_embedding")
    index = CellIndex(spark, str(tmp_path / "cells"), ["rid"], vector="v")
    index.build(pool, train_cells(pool, 32, "v"))
    exact = nearest(pool, asked, 10, ids=["rid"], vector="v", dim=16)
    found = index.nearest(asked, 10, n_probe=8)
    both = found.join(exact.select("question_id", "rid"), ["question_id", "rid"], "left_semi").count()
    assert both >= 0.9 * exact.count()
