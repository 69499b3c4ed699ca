import hashlib
import random
from collections import Counter

import pytest
from common import clashing, documents, odd

from pagewarden.llm import suffixes
from pagewarden.llm.queries import op4_repeated_passages


def brute(rows, width=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def check(frame, **how):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    found = suffixes.remove_repeats(frame, **how).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found]
    assert sorted(got, key=repr) == brute(rows, how.get("width", 200))


def texts(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    passages = [line(n) for n in (199, 200, 201, 260, 700)]
    out = [line(rng.randrange(0, 900)) for _ in range(10)]
    for _ in range(25):
        out.append("".join(rng.choice([line(rng.randrange(0, 150)), rng.choice(passages)]) for _ in range(5)))
    out += [out[0], out[0], "ab" * 400, "ab" * 130, "z" * 500, "z" * 199, "z" * 200, passages[4] * 3]
    return out


@pytest.mark.parametrize("how", [{}, {"held": 2}, {"width": 60, "seed": 20}])
def test_repeats(spark, how):
    check(documents(spark, texts(1)), **how)


def test_small_batches_fill_many_levels(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 3)
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 300)
    check(documents(spark, texts(2)))


def test_levels_merge_geometrically():
    rng = random.Random(3)
    levels = suffixes.Levels(10)
    batches = [["".join(rng.choices("ab", k=30)).encode() for _ in range(4)] for _ in range(11)]
    for n, batch in enumerate(batches, 1):
        levels.add(batch)
        assert sorted(size for size, _ in levels.levels) == [1 << b for b in range(8) if n >> b & 1]
    strings = Counter(t[i : i + 10] for batch in batches for t in batch for i in range(21))
    for text, again in zip(levels.text, levels.again):
        assert list(again) == [int(strings[text[i : i + 10]] > 1) for i in range(21)]


def test_a_crowded_seed_is_parted(spark):
    rng = random.Random(6)
    common = "the passage that all of them hold"
    around = ["".join(rng.choices("ab", k=60)) for _ in range(6)]
    crowd = [rng.choice(around) + common + rng.choice(around) for _ in range(120)]
    crowd = [t[: rng.randrange(100, len(t) + 1)] for t in crowd]
    check(documents(spark, crowd), width=90, seed=30, held=7)


def test_places_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        suffixes.repeated_places(documents(spark, ["a"]), width=400, seed=50)


def test_odd_texts(spark):
    check(clashing(odd(spark), "row", "spans", "found", "kept"))
    frame = documents(spark, texts(4)[:3] * 2, [1, 1, 2, 1, None, None])
    check(frame)
    assert suffixes.remove_repeats(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows)]
    names = "doc_id n_bytes n_removed n_spans kept_sha256".split()
    got = [tuple(r[n] for n in names) for r in op4_repeated_passages(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
