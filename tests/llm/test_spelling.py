import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from common import clashing, documents, odd

from pagewarden.llm import spelling
from pagewarden.llm.queries import op12_spelling_variants, table

LETTERS = "abcdefghijklmnopqrstuvwxyzàéüßÀ×ÿ"


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: m for w, m in n.items() if len(w) >= 5 and m >= 3}


def edits(word, letters):
    """All words that one edit of the given letters makes."""
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out |= {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def brute(words):
    letters = set("".join(words))
    out = []
    forms = {}
    for word, n in words.items():
        near = sorted((w for w in edits(word, letters) if w in words), key=lambda w: (-words[w], w))
        best = near[0] if near and words[near[0]] >= 2 * n else None
        forms[word] = best
        out.append([word, n, len(near), best, words[best] if best else None])
    rows = []
    for word, n, n_near, best, best_n in out:
        root = word
        while forms[root]:
            root = forms[root]
        rows.append((word, best, root, n, n_near, best_n))
    return sorted(rows)


def found(frame):
    return sorted(tuple(r[c] for c in "word form root n n_near form_n".split()) for r in frame.collect())


def vocabulary(seed, n):
    """Words, their variants and chains of these, with anagrams and one very long word."""
    rng = random.Random(seed)
    words = {"".join(rng.choices(LETTERS[:8] if rng.random() < 0.7 else LETTERS, k=rng.randrange(5, 9))) for _ in range(n)}
    for _ in range(n):
        words.add(rng.choice(sorted(edits(rng.choice(sorted(words)), "aeß"))))
    words |= {"".join(rng.sample(w, len(w))) for w in sorted(words)[::5]} | {"x" * 3000, "x" * 3001, "y" + "x" * 2999}
    return {w: 3 + int(2 ** (12 * rng.random())) for w in words if len(w) >= 5}


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"block_chars": 60}), (3, {"sample": 40, "block_chars": 200})])
def test_variants_against_all_edits(spark, seed, how):
    words = vocabulary(seed, 250)
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(spelling.variants(frame, **how)) == brute(words)


def test_trees_lose_no_point():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 3, (400, spelling.N_LETTERS)).astype(np.int32) * (rng.random((400, spelling.N_LETTERS)) < 0.1)
    nodes, order = spelling.grow(counts, 5)
    assert sorted(order.tolist()) == list(range(400))
    step = counts[None, :, :] - counts[:, None, :]
    for up, down in ((0, 0), (1, 0), (1, 1)):
        near = (np.maximum(step, 0).sum(axis=2) <= up) & (np.maximum(-step, 0).sum(axis=2) <= down)
        met = np.zeros_like(near)
        for leaf, _, points in spelling.visit(nodes, counts, up, down):
            assert not met[np.ix_(points, order[leaf.lo : leaf.hi])].any()
            met[np.ix_(points, order[leaf.lo : leaf.hi])] = True
        assert (met | ~near).all()
        # The boxes leave most of the points out.
        assert met.mean() < 0.5


def test_one_edit():
    def pair(a, b):
        codes = [np.frombuffer(w.encode("latin-1"), np.uint8)[None] for w in (a, b)]
        return bool(spelling.one_edit(*codes)[0])

    assert pair("house", "mouse") and pair("house", "houses") and pair("aaaa", "aaaaa") and pair("bcd", "abcd")
    assert not pair("house", "house") and not pair("house", "huose") and not pair("abcd", "abdce")


def test_counts_and_odd_texts(spark):
    frame = odd(spark).unionByName(documents(spark, [" ".join(["Straße ÀÉÎÕÜ×÷ Thunder thunder"] * n) for n in range(40)], range(500, 540)))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    words = {r["word"]: r["n"] for r in spelling.counted_words(clashing(frame, "id", "run", "word", "spot")).collect()}
    assert words == counted(rows) and "thunder" in words and "straße" in words


def test_counts_handed_on_early(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD_WORDS", 7)
    monkeypatch.setattr(spelling, "LIST_CHARS", 200)
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abÉé", k=rng.randrange(3, 7))) for _ in range(90))) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
    found = Counter()
    for part in spelling._counter(5, 97)(iter([batch])):
        found.update(dict(zip(part["word"].to_pylist(), part["n"].to_pylist())))
    assert {w: n for w, n in found.items() if n >= 3} == counted(rows)


def test_empty_table(spark):
    assert found(spelling.variants(spelling.counted_words(documents(spark, ["a"]).limit(0)))) == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert found(op12_spelling_variants(spark, sf_dir)) == brute(counted(rows))
