"""Hashed vectors of many texts, some at a time."""

import pyarrow as pa
import pytest

from pagewarden.functions import text as texts
from pagewarden.functions.text import with_hashed_vector
from pagewarden.session import BATCH_BYTES


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_tokens_are_counted_some_texts_at_a_time(monkeypatch, limit):
    rows = ["a b a", None, "", "é", "long " * 30, "b,c", None, "x1 x1 x2"]
    whole = texts._counts_of_part(pa.array(rows), 1536)
    seen = []
    part = texts._counts_of_part
    monkeypatch.setattr(texts, "TOKEN_BYTES", limit)
    monkeypatch.setattr(texts, "_counts_of_part", lambda some, dim: seen.append(some.to_pylist()) or part(some, dim))
    assert texts._token_counts(pa.array(rows), 1536).to_pylist() == whole.to_pylist()
    assert [row for some in seen for row in some] == rows
    assert all(len(some) == 1 or sum(len((r or "").encode()) for r in some) <= limit for some in seen)
    assert texts._token_counts(pa.array([], pa.string()), 1536).to_pylist() == []


def test_hashing_bounds_the_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(1 << 30))
        with_hashed_vector(spark.createDataFrame([("a b",)], "text string"), "text")
        assert int(spark.conf.get(name)) == BATCH_BYTES
    finally:
        spark.conf.set(name, before)
