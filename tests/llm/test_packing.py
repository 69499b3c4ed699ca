import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from common import ODD_TEXTS, clashing, documents, odd
from tokenizers import Tokenizer

from pagewarden.llm import packing
from pagewarden.llm.queries import op13_packing, table

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def best_fit(lengths, width):
    """Sequences of best fit over the pieces themselves, longest first."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, at) for at, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(width - length)
    return len(rooms)


def filled(placed, width):
    """Number of sequences, after a check that each is gapless and short enough."""
    sequences = defaultdict(list)
    for sequence, offset, length in placed:
        sequences[sequence].append((offset, length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= width
    return len(sequences)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    width = rng.choice([16, 50, 64])
    lengths = [min(width, 1 + int(rng.expovariate(1 / rng.choice([3, 10, 30])))) for _ in range(rng.randrange(1, 400))]
    slots, made = packing.plan(Counter(lengths), width)
    placed, ranks = [], defaultdict(list)
    for s in slots:
        for n in range(s.each * s.sequences):
            ranks[s.length].append(s.first + n)
            placed.append((s.sequence + n // s.each, s.offset + n % s.each * s.length, s.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
    assert filled(placed, width) == made == best_fit(lengths, width)


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(1)
    few = {n: 1 + rng.randrange(50) for n in range(1, 257)}
    many = {n: m * 10**9 + rng.randrange(10**9) for n, m in few.items()}
    slots, made = packing.plan(many, 256)
    assert len(slots) < 3 * 256 * 22 and made >= sum(n * m for n, m in many.items()) / 256
    assert sum(s.each * s.sequences for s in slots) == sum(many.values())


def test_a_piece_that_cannot_fit():
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_ids_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 20)
    rng = random.Random(4)
    bits = ["It's", "Größe", "é", "naïve", "42", "x" * 50, " ", "\n", "\t", "漢字", "DON'T", "́", "ΑΣ", "　", "--", "a\xa0b",
            "\x1c", "İ", "½", "ª", "Ÿ", "<|endoftext|>", "…", "\xad", "'S'", "7'll8", "A.B,c!", "🙂", "\x85", "ﬁ", "À×÷ß"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(200))) for _ in range(200)]
    LIBRARY.encode_special_tokens = True
    wanted = [LIBRARY.encode(text, add_special_tokens=False).ids for text in texts]
    source = Path(PATH).read_text(encoding="utf-8")
    encoder = packing.Encoder(source)
    assert encoder.words is not None
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(pa.array(texts))] == wanted
    encoder.words = None
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(pa.array(texts))] == wanted


def test_plain_lines_are_cut_like_whole_texts():
    rng = random.Random(5)
    marks = ["'s", "'T", "'", "''d", "$$$", "...", ",", "12", "x'll", "a-b", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\x85"]
    words = ["the", "The", "NAÏVE", "Ärger", "straße", "ÿ", "Þorn", "×", "÷", "µ", "ªº", "²³", "½", "Σας", "ΟΔΟΣ", "e\u0301", "İ"]
    texts = ["".join(rng.choice(marks + words * 2) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    encoder = packing.Encoder(Path(PATH).read_text())
    found = encoder.encode(pa.array(texts))
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1], text


def test_marks_and_capitals_make_no_other_words(monkeypatch):
    encoder = packing.Encoder(Path(PATH).read_text())
    asked, encode = [], encoder.known.work
    monkeypatch.setattr(encoder.known, "work", lambda texts: asked.extend(texts) or encode(texts))
    for text in ["Haus, haus. HAUS! haus", "haus; Ärger; ärger$$$\nÄRGER12, haus."]:
        encoder.encode(pa.array([text]))
    assert sorted(word for word in asked if word[:1].isalpha()) == ["haus", "ärger"]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder(Path(path).read_text(encoding="utf-8"))
    (ids,) = encoder.encode(pa.array(["Two words, and more"]))
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(path).encode("Two words, and more").ids


def test_ids_on_given_texts(spark):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    found = packing.Encoder(Path(PATH).read_text(encoding="utf-8")).encode(pa.array(texts))
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_odd_texts_and_clashing_columns(spark, width):
    frame = clashing(odd(spark), "piece", "found", "rank", "offset", "first")
    packed = packing.pack(packing.pieces(frame, PATH, width=width), width=width).collect()
    assert packed[0]["found"] == "extra found" and packed[0]["first"] == "extra first"
    filled([(r["sequence_id"], r["offset"], r["length"]) for r in packed], width)
    wanted = Counter()
    for row in frame.collect():
        ids = ids_of(row["text"])
        for i, lo in enumerate(range(0, len(ids), width)):
            wanted[row["doc_id"], i, lo, tuple(ids[lo : lo + width])] += 1
    found = Counter(
        (r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in packed
    )
    assert found == wanted


def test_empty_table(spark):
    assert packing.pack(packing.pieces(documents(spark, ODD_TEXTS).limit(0), PATH)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = op13_packing(spark, sf_dir).collect()
    texts = dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    wanted = []
    for doc_id, text in texts.items():
        ids = np.array(ids_of(text), "<u4")
        for i, lo in enumerate(range(0, len(ids), 4096)):
            part = ids[lo : lo + 4096]
            wanted.append((doc_id, i, lo, len(part), zlib.crc32(part.tobytes())))
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found) == sorted(wanted)
    made = filled([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 4096)
    assert made == best_fit([r["length"] for r in rows], 4096)
