import random

import pytest
from common import clashing
from pyspark.sql import types as T

import numpy as np
from pagewarden.llm import polytope
from pagewarden.llm.links import components
from pagewarden.llm.queries import op5_embedding_duplicates, table


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    path = list(range(40))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) if seed == 0 else [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {k: v for k, v in brute_components(edges).items() if any(a != b and k in (a, b) for a, b in edges)}
    assert {r["id"]: r["component"] for r in found} == want and len(found) == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def brute(rows, least=0.93):
    """Links and components by comparing all pairs; one entry per row, in order."""
    usable = [
        i for i, (vec_id, v, label) in enumerate(rows)
        if vec_id is not None and label is not None and v is not None
        and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    units = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in usable}
    links, edges = [0] * len(rows), []
    for n, i in enumerate(usable):
        for j in usable[:n]:
            if rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least - 1e-12:
                links[i] += 1
                links[j] += 1
                edges.append((rows[i][0], rows[j][0]))
    roots = brute_components(edges)
    return sorted(((r[0], links[i], roots.get(r[0], r[0])) for i, r in enumerate(rows)), key=repr)


def check(spark, rows, **how):
    found = polytope.link(spark.createDataFrame(rows, VECTORS), **how).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def near(rng, v, cosine):
    w = rng.normal(size=len(v))
    w -= (w @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_links_of_crowds_blocks_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = []
    for label in range(3):
        centre = rng.normal(size=64)
        for _ in range(60):
            rows.append((len(rows), near(rng, centre, rng.uniform(0.955, 0.999)).astype(np.float32).tolist(), label))
        rows += [(len(rows) + i, rows[-1][1], label) for i in range(5)]
        rows += [(len(rows) + i, rng.normal(size=64).astype(np.float32).tolist(), label) for i in range(20)]
    check(spark, rows)
    check(spark, rows, block=16)


def test_a_long_chain(spark):
    # Each vector is linked with the next alone; ids fall along the chain but for the first.
    n, turn = 500, np.arccos(0.955)
    ids = np.array([0, *range(n - 1, 0, -1)])
    assert (polytope._roots(n, ids[:-1], ids[1:]) == 0).all()
    v, rows = np.eye(n + 1)[0], []
    for at, vec_id in enumerate(ids.tolist()):
        rows.append((vec_id, v.astype(np.float32).tolist(), 0))
        v = np.cos(turn) * v + np.sin(turn) * np.eye(n + 1)[at + 1]
    check(spark, rows, axes=1)


@pytest.mark.parametrize("seed", range(5))
def test_roots(seed):
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, 200, (2, 150))
    roots = brute_components(zip(i.tolist(), j.tolist()))
    assert [roots.get(x, x) for x in range(200)] == polytope._roots(200, i, j).tolist()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for pair in range(400):
        v = rng.normal(size=64)
        rows += [(2 * pair, v.tolist(), 0), (2 * pair + 1, near(rng, v, 0.935).tolist(), 0)]
    found = polytope.link(spark.createDataFrame(rows, VECTORS))
    assert found.where("n_links > 0").count() >= 0.95 * len(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0] * 4, 0), (4, [nan, 1.0, 0.0, 0.0], 0), (5, [inf, 1.0, 0.0, 0.0], 0),
        (6, [None, 1.0, 0.0, 0.0], 0), (7, [1.0, 2.0, 3.0, 4.0], 0), (8, [2.0, 4.0, 6.0, 8.0], 0),
        (8, [2.0, 4.0, 6.0, 8.0], 0), (9, [1.0, 2.0, 3.0, 4.0], None), (10, [1.0, 2.0, 3.0, 4.0], 1),
        (11, [1.0, 2.0, 3.0], 0), (12, [1e-30, 2e-30, 3e-30, 4e-30], 0), (None, [1.0, 2.0, 3.0, 4.0], 0),
        (13, [-1.0, -2.0, -3.0, -4.0], 0), (14, [5.0], 0), (15, [7.0], 0),
    ]
    found = polytope.link(clashing(spark.createDataFrame(rows, VECTORS), "keys", "copies", "first", "d1")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert polytope.link(spark.createDataFrame([], VECTORS)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding", "label").collect()]
    found = op5_embedding_duplicates(spark, folder).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == brute(rows)
