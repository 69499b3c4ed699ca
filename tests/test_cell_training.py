"""What tasks hold while cells are learnt."""

import numpy as np

from pagewarden.operators import cells


def test_cells_learn_from_sparse_vectors_in_bounded_parts(spark, monkeypatch):
    seen = {}

    class Means:
        def __init__(self, **options):
            pass

        def fit(self, rows):
            seen["rows"] = rows.rdd.glom().map(lambda part: [row["features"] for row in part]).collect()
            return self

        def clusterCenters(self):
            return np.eye(2)

    monkeypatch.setattr(cells, "KMeans", Means)
    monkeypatch.setattr(cells, "TRAIN_ROWS", 10)
    # Out of order, and a place that comes twice: its last entry counts.
    rows = [([7, 2, 7], [1, 3, i + 1]) for i in range(35)] + [([], []), ([1], [0])]
    vectors = spark.createDataFrame([(v,) for v in rows], "v struct<indices:array<int>,values:array<int>>").coalesce(1)
    cells.train_cells(vectors, 2, "v", dim=1000)
    assert len(seen["rows"]) == 4 and max(map(len, seen["rows"])) <= 10
    found = [row for part in seen["rows"] for row in part]
    assert all(type(v).__name__ == "SparseVector" and v.size == 1000 for v in found)
    assert sorted((v[2], v[7]) for v in found) == [(3.0, i + 1.0) for i in range(35)]
