import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from common import ODD_TEXTS, clashing, documents, odd

from pagewarden.llm import bpe
from pagewarden.llm.batches import BATCH_BYTES, bound_batches
from pagewarden.llm.queries import op1_bpe, table, vocabulary

RANKS = vocabulary()
EXACT = tiktoken.Encoding(
    "exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)


def ids_of(frame):
    coded = bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
    return [(r["text"], r["ids"]) for r in coded.collect()]


def test_merges_match_the_library():
    rng = random.Random(3)
    alphabet = ["a", "b", "e", "r", "th", "ing", "é", "ß", "漢", "🙂", " ", "0", "the"]
    for _ in range(3000):
        piece = "".join(rng.choices(alphabet, k=rng.randrange(1, 25))).encode()
        assert bpe.merge(piece, RANKS) == list(EXACT._encode_single_piece(piece))


def test_one_very_long_part():
    piece = b"abcab" * 40000
    assert bpe.merge(piece, RANKS) == list(EXACT._encode_single_piece(piece))


def test_lowest_rank_first_and_leftmost_of_equals():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258}
    assert bpe.merge(b"aaa", ranks) == [257]
    assert bpe.merge(b"aaaa", ranks) == [256, 256]
    assert bpe.merge(b"baa", ranks) == [98, 256]


def test_odd_texts(spark):
    for text, ids in ids_of(odd(spark)):
        assert ids == EXACT.encode_ordinary(text or "")


def test_round_trip_and_clashing_columns(spark):
    frame = clashing(documents(spark, ODD_TEXTS), "ids", "decoded", "batches")
    coded = bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)
    for row in coded.collect():
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert row["batches"] == "extra batches"


def test_one_pass_gives_what_two_give(spark):
    frame = clashing(odd(spark), "ids", "decoded", "coded")
    two = bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)
    one = bpe.round_trip(frame, RANKS, public_tokenizers.PATTERN)
    assert sorted(one.columns) == sorted(two.columns)
    rows = [sorted(map(repr, f.select(two.columns).collect())) for f in (one, two)]
    assert rows[0] == rows[1]


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        lowered = str(BATCH_BYTES)
        for given, then in (("64m", lowered), ("1gb", lowered), ("512k", "512k"), ("1048576b", "1048576b")):
            spark.conf.set(name, given)
            bound_batches(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


def test_empty_table(spark):
    assert bpe.round_trip(documents(spark, ODD_TEXTS).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert ids_of(documents(spark, ODD_TEXTS).limit(0)) == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in op1_bpe(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = EXACT.encode_ordinary(text or "")
        assert found[doc_id]["n_tokens"] == len(ids)
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 3])
def test_small_memory_gives_the_same_ids(spark, monkeypatch, size):
    monkeypatch.setattr(bpe, "REMEMBERED", size)
    for text, ids in ids_of(documents(spark, ODD_TEXTS)):
        assert ids == EXACT.encode_ordinary(text or "")
