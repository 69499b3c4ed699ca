import random

import numpy as np
import pytest
from common import clashing, documents, odd
from test_links import brute_components

from pagewarden.llm import minhash
from pagewarden.llm.queries import op3_near_duplicates


def brute(rows, counted=False):
    """Class of every row by comparing all pairs of documents."""

    def bag(text):
        words = (text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
        words = [w for w in words if w]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        return {r: runs.count(r) if counted else 1 for r in runs}

    kinds = {}
    for doc_id, text in rows:
        if doc_id is not None and bag(text):
            kinds.setdefault(frozenset(bag(text).items()), []).append(doc_id)
    bags = [(dict(k), ids) for k, ids in kinds.items()]
    edges = [(ids[0], i) for _, ids in bags for i in ids]
    for n, (a, ids) in enumerate(bags):
        for b, others in bags[:n]:
            both = sum(min(v, b[k]) for k, v in a.items() if k in b)
            if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                edges.append((ids[0], others[0]))
    roots = brute_components(edges)
    return sorted(((d, None if d is None else roots.get(d, d)) for d, _ in rows), key=repr)


def check(spark, frame, **how):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    found = minhash.near_duplicates(frame, **how).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in found), key=repr) == brute(rows, how.get("counted", False))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"]) for r in found)


def texts(seed, crowd=60):
    """Strangers, copies, chains of small changes and a crowd around one text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    out = []
    for _ in range(8):
        words = [word() for _ in range(rng.choice([3, 5, 6, 40, 200]))]
        out += [" ".join(words)] * rng.randrange(1, 4)
        for _ in range(4):
            words = words[:]
            words[rng.randrange(len(words))] = word()
            out.append("  ".join(words))
    base = [word() for _ in range(120)]
    for _ in range(crowd):
        words = base[:]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = word()
        out.append("\n".join(words))
    rng.shuffle(out)
    return out


def test_classes(spark):
    check(spark, documents(spark, texts(1)))


def test_split_buckets_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_WORDS", 300)
    check(spark, documents(spark, texts(2, 90)), block=8)


def test_counted(spark):
    more = ["one two three four five six " * n for n in (1, 5, 6, 30)]
    check(spark, documents(spark, texts(3, 20) + more), counted=True)


def test_odd_texts(spark):
    check(spark, clashing(odd(spark), "row", "size", "entries", "bucket"))
    same_id = documents(spark, ["a b c d e f", "g h i j k l", "g h i j k l", "a b c d e f"], [5, 5, 3, 9])
    found = {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(same_id).collect()}
    assert found == {(5, 3), (3, 3), (9, 3)}
    assert minhash.near_duplicates(same_id.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [(1, 1, 1), (0.3, 2.5, 9.7), (5, 5, 0.1)])
def test_entries_agree_as_often_as_weighted_sets_are_alike(weights):
    rng = np.random.default_rng(4)
    element = rng.integers(0, 2**63, 30).astype(np.uint64)
    one = rng.choice(weights, 30) * rng.integers(0, 2, 30)
    two = np.where(rng.random(30) < 0.7, one, rng.choice(weights, 30))
    row = np.repeat([0, 1], 30)
    weight = np.concatenate((one, two)).astype(float)
    some = weight > 0
    k = 4000
    entries = minhash.signatures(row[some], np.tile(element, 2)[some], weight[some], 2, k)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((entries[0] == entries[1]).mean() - want) < 4 * np.sqrt(0.25 / k)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    found = op3_near_duplicates(spark, folder).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in found), key=repr) == brute(rows)
