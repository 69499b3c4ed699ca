import os
import random

import zstandard
from common import ODD_TEXTS, clashing, documents, odd

from pagewarden.llm import bands
from pagewarden.llm.queries import op6_compression_bands, table

SPACES = " \t\n\x0b\x0c\r"


def counted(text):
    text = text or ""
    words, word = [], ""
    for c in text:
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines, earlier, same = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACES):
            same += line in earlier
            earlier.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        same,
        len(covered),
        failed,
    )


def verdict(text, failed):
    data = (text or "").encode()
    if failed:
        return False
    squeeze = zstandard.ZstdCompressor(level=3).compress

    def outside(part):
        low, high = [b[1:] for b in bands.BANDS if len(part) >= b[0]][-1]
        return not low <= len(squeeze(part)) / len(part) <= high

    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    return not outside(data) and sum(len(c) for c in chunks if outside(c)) * 2 <= len(data)


def compare(frame):
    for row in bands.judge(frame).collect():
        want = counted(row["text"]) if len(row["text"] or "") < 10000 else None
        if want is None:
            continue
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
        assert tuple(row[n] for n in names) == want, row["text"]
        assert row["kept"] == verdict(row["text"], want[-1])


def test_odd_texts(spark):
    compare(odd(spark))


def test_given_texts(spark):
    compare(table(spark, "/root/testdata/sf0.001", "documents"))


def test_small_pieces_and_groups(spark, monkeypatch):
    from pagewarden.llm import arrays

    monkeypatch.setattr(arrays, "PIECE", 64)
    monkeypatch.setattr(bands, "GROUP_WORDS", 10)
    compare(documents(spark, [*ODD_TEXTS, "one two three one two three four " * 9, "long" * 100 + " tail"]))


def test_bands_reject_repeats_and_noise(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choices(vocabulary, k=900))
    lines = "\n".join(f"Entry {i} of the list that never ends and says the same" for i in range(200))
    noise = " ".join(os.urandom(20).hex() + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30)) for _ in range(90))
    rows = bands.judge(documents(spark, [prose, lines, noise])).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, False]


def test_clashing_columns_and_empty_table(spark):
    frame = clashing(documents(spark, ODD_TEXTS), "found", "kept", "ratio", "counts")
    judged = bands.judge(frame)
    assert judged.columns.count("kept") == 1 and dict(judged.dtypes)["kept"] == "boolean"
    assert {r["found"] for r in judged.collect()} == {"extra found"}
    assert judged.limit(0).count() == 0 and bands.judge(frame.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = op6_compression_bands(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    rows = judged.where("quality = 1 AND NOT base_failed").groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in rows}.get(False, 0) == 0
