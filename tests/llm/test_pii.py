import hashlib
import random
import re

import pytest
from common import ODD_TEXTS, clashing, documents, odd

from pagewarden.llm import pii
from pagewarden.llm.queries import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns as they are written, with their conditions."""

    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted(
        (m.start(), at, m.end())
        for at, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text)
        if good(kind, m[0])
    )


TRICKY = [
    "a@b.c@d.e x@y a@b. @b.c 1@2.3 é@b.cd .@-.- a@b..c a@@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000255.1.1.1 1.2.3 1..2.3.4 9.9.9.9.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 4111111111111111 2",
    "+1 (124) 555-4766 +1 +12 +123456789012345 +1234567890123456 ++49 30 1234567 +1.......2 +4(",
    "1.2.3.4@5.6.7.8 +1.2.3.4.5.6.7.8.9.0 mixed +4111111111111111",
]


@pytest.mark.parametrize("text", [*TRICKY, *[t or "" for t in ODD_TEXTS]])
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_patterns_on_given_texts(spark):
    for (text,) in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect():
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    pii.base_spans("x" * 300_000 + " " + "7" * 300_000 + "@" * 10_000 + "+1" + "(" * 100_000 + "1." * 100_000)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.learn(table(spark, "/root/testdata/sf0.1", "documents"))


def test_gradients_match_differences():
    import numpy as np

    tagger = pii.Tagger(3, 1)
    rng = np.random.default_rng(2)
    codes, tags = rng.integers(90, 130, (5, 4)), rng.integers(0, pii.TAGS, (5, 4))

    def loss():
        scores = tagger.scores(codes)
        total = 0.0
        for n in range(4):
            ahead = scores[0, n] + tagger.first
            path = scores[0, n, tags[0, n]] + tagger.first[tags[0, n]]
            for t in range(1, 5):
                ahead = pii._log_sum(ahead[:, None] + tagger.follow, 0) + scores[t, n]
                path += scores[t, n, tags[t, n]] + tagger.follow[tags[t - 1, n], tags[t, n]]
            total += pii._log_sum(ahead, 0) - path
        return total / 4

    for w, g in zip(tagger.weights(), tagger.learn(codes, tags)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = w[at]
        w[at] = before + 1e-5
        up = loss()
        w[at] = before - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-5
        w[at] = before


def test_tagger_agrees_with_held_out_spans(spark, tagger):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").where("text RLIKE '[0-9@]'").collect()]
    known = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(tagger, texts, [[] for _ in texts])
    found = sum(len(set(a) & set(k)) for a, k in zip(alone, known))
    assert found >= 0.6 * sum(map(len, known))
    wrong = sum(len(set(a) - set(k)) for a, k in zip(alone, known))
    assert wrong <= 0.1 * sum(map(len, known))


def test_tagger_finds_other_spellings(tagger):
    texts = ["please write to jane.doe (at) example.org before noon", "the words end here and nothing else is said"]
    added = pii.added_spans(tagger, texts, [[], []])
    assert [texts[0][a:b] for a, _, b in added[0]] == ["jane.doe (at) example.org"] and added[1] == []


def test_written_out_examples_of_all_kinds(spark, tagger):
    """Precision and recall on examples that were not learnt from, between words of the given texts."""
    rng = random.Random(99)
    words = " ".join(
        r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").where("NOT text RLIKE '[0-9@]'").limit(50).collect()
    ).split()
    texts, truth = [], []
    for _ in range(600):
        at = rng.randrange(len(words) - 40)
        example, kind = pii._examples(rng)
        before = " ".join(words[at : at + 12]) + " "
        texts.append(before + example + " " + " ".join(words[at + 12 : at + 30]))
        truth.append(None if kind is None else (len(before), kind, len(before) + len(example)))
    found = [set(spans) for spans in pii.added_spans(tagger, texts, [[] for _ in texts])]
    for kind in range(4):
        wanted = [(t, f) for t, f in zip(truth, found) if t and t[1] == kind]
        assert len(wanted) > 30
        assert sum(t in f for t, f in wanted) >= 0.7 * len(wanted), pii.KINDS[kind]
    right = sum(t in f for t, f in zip(truth, found) if t)
    assert right >= 0.9 * sum(map(len, found))


def test_long_texts_of_digits_take_bounded_memory(tagger):
    import tracemalloc

    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789 .", k=1 << 20))] + ["call 5 now"] * 2000
    tracemalloc.start()
    pii.added_spans(tagger, texts, [[] for _ in texts])
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_parts_of_a_long_stretch_agree(tagger, monkeypatch):
    text = "; ".join(["jane.doe (at) example.org", "4111/1111/1111/1111", "call 5 and 7", "10 . 0 . 0 . 1"] * 40)
    whole = pii.added_spans(tagger, [text], [[]])[0]
    monkeypatch.setattr(pii, "LONG", 5 * pii.STRIDE)
    parts = pii.added_spans(tagger, [text], [[]])[0]
    assert len(set(whole) & set(parts)) >= 0.95 * len(whole) > 40


def test_windows_reach_every_hint(tagger):
    text = ("word " * 40 + "1.2.3.4 ") * 20
    assert all(any(lo <= m.start() and m.end() <= hi for lo, hi in pii.stretches(text)) for m in re.finditer("[0-9]", text))
    long = "5" * 3000
    scores = pii._stretch_scores(tagger, [pii._codes(long)])
    assert scores[0].shape == (3000, pii.TAGS)


def test_query_columns(spark, tagger):
    frame = clashing(odd(spark).unionByName(documents(spark, TRICKY, range(100, 105))), "found", "spans", "n_ip")
    rows = pii.find(frame, tagger).collect()
    assert len(rows) == frame.count()
    for row in rows:
        base = plain(row["text"] or "")
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(k == at for _, k, _ in base) for at in range(4)]
        written = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in base)
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(row["spans"].split(","))
        assert row["found"] == "extra found"
    assert pii.find(frame.limit(0), tagger).count() == 0
