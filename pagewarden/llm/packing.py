"""Token sequences of bounded length, as few as best fit makes them.

Texts become token ids with an end token; only those longer than a sequence are cut.
How many pieces there are of each length is all that planning needs: best fit goes down
the lengths and places counts, not pieces, and every move takes a whole range of like
sequences at once. Its plan has a row for each range of sequences that take pieces of
one length at one place. There are at most three times as many ranges as lengths, and a
sequence holds fewer distinct lengths than the root of twice its width, so the plan has
a bound that no corpus moves. Pieces then get a rank among those of their length, from
counts by file and their order in it, and find their slot by length and rank.

A null text counts as empty and is the end token alone. Null and repeated ids and other
columns play no part: every row is packed, an empty table gives no rows, and a column
named like an output is replaced. Pieces of equal length are alike to the plan; which of
them takes which slot follows the order in which they were written.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.batches import bound_batches
from pagewarden.llm.links import written
from pagewarden.llm.names import others, own
from pagewarden.llm.remember import Remembered

WIDTH = 4096
END = 1
# Characters whose words are looked up at once; a longer text is cut before a blank.
AT_ONCE = 1 << 21
# Words that a worker remembers, twice so many at most.
WORDS_KEPT = 400_000
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids:binary>>"


class Slots(NamedTuple):
    """Pieces of one length, by rank from `first`: `each` of them in every one of `sequences` sequences."""

    length: int
    first: int
    each: int
    sequences: int
    sequence: int
    offset: int


def plan(counts: Mapping[int, int], width: int = WIDTH) -> tuple[list[Slots], int]:
    """Best fit over counts of lengths, longest first: the slots, and how many sequences there are."""
    slots: list[Slots] = []
    # Ranges of sequences (first, how many) by the room they have left, and these rooms in order.
    ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    made = 0

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, many))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= width:
            raise ValueError(f"a piece of {length} tokens does not fit into {width}")
        rest, rank = counts[length], 0
        while rest:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, many = width, made, -(-rest // (width // length))
                made += many
            # The fullest sequence that fits stays the fullest until it is full.
            each = room // length
            full = min(many, rest // each)
            if full:
                slots.append(Slots(length, rank, each, full, first, width - room))
                leave(room - each * length, first, full)
                rank, rest = rank + each * full, rest - each * full
            if full < many and rest:
                slots.append(Slots(length, rank, rest, 1, first + full, width - room))
                leave(room - rest * length, first + full, 1)
                full, rest = full + 1, 0
            leave(room, first + full, many - full)
    return slots, made


def _bytes_as_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else one from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0x100)} - {0xAD}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_LETTERS = _bytes_as_letters()
# Words of these characters alone are the same in normal form, and lower-cased one by one.
_PLAIN = regex.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_BYTES = bytes([*b" ", *range(ord("!"), ord("~") + 1), *({*range(0xC0, 0x100)} - {0xD7, 0xF7})])
# A word of plain letters and what is behind it, which no token joins unless it has an apostrophe.
_MARKS = "([a-zà-öø-ÿ])([!-&(-@\\[-`{-~]+(?: |$))"
_WRITTEN = {c: "".join(_LETTERS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def _word_pattern(source: dict) -> str | None:
    """What the tokenizer takes as words, if it drops white space and lowers case; none if it works otherwise."""
    normal, split = source.get("normalizer") or {}, source.get("pre_tokenizer") or {}
    steps, parts = normal.get("normalizers", []), split.get("pretokenizers", [])
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if steps != [{"type": "NFC"}, blanks, {"type": "Lowercase"}] or len(parts) != 2:
        return None
    words, letters = parts
    if words.get("behavior") != "Removed" or not words.get("invert") or letters.get("type") != "ByteLevel":
        return None
    if letters.get("add_prefix_space") or letters.get("use_regex") or source.get("post_processor"):
        return None
    pattern = words["pattern"].get("Regex", "")
    # Letters that follow one another must be one word.
    return pattern if r"[\p{L}]+" in pattern else None


def _is_plain(line: str) -> bool:
    if line.isascii():
        raw = line.encode()
    else:
        try:
            raw = line.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not raw.translate(None, _PLAIN_BYTES)


class Encoder:
    """Ids of texts by a tokenizer file.

    Where white space parts words for good, the ids of a text are those of what lies
    between its blanks, and these are remembered. Each is looked up once for many texts,
    lines of plain characters in lower case, and marks behind a word apart from it. Words
    of plain letters go straight to the tokenizer's merges. Other tokenizers get whole texts.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True
        pattern = _word_pattern(json.loads(source))
        self.words = regex.compile(pattern) if pattern else None
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known = Remembered(self._encode, WORDS_KEPT)

    def _whole(self, texts: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(code.ids, "<u4").tobytes() for code in codes]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found: list = [None] * len(texts)
        # Letters alone are one word.
        plain = [
            (i, text.lower())
            for i, text in enumerate(texts)
            if text.isalpha() and (text.isascii() or _PLAIN.fullmatch(text))
        ]
        for i, _ in plain:
            found[i] = b""
        others = [i for i, ids in enumerate(found) if ids is None]
        words = [self.words.findall(texts[i].lower()) if _PLAIN.fullmatch(texts[i]) else None for i in others]
        rest = iter(self._whole([texts[i] for i, some in zip(others, words) if some is None]))
        ids = {word: self._merge(word) for word in set(chain.from_iterable(filter(None, words)))}
        ids_of = ids.__getitem__
        for i, text in plain:
            found[i] = self._merge(text)
        for i, some in zip(others, words):
            found[i] = next(rest) if some is None else b"".join(map(ids_of, some))
        return found

    def _merge(self, word: str) -> bytes:
        written = word if word.isascii() else word.translate(_WRITTEN)
        return b"".join([self.coded[token.id] for token in self.tokenizer.model.tokenize(written)])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Unsigned little-endian 32-bit ids of every text."""
        if self.words is None:
            return [self._whole([text.as_py() or ""])[0] for text in texts]
        found: list[list[bytes]] = [[] for _ in range(len(texts))]
        for group in _groups(texts):
            for (row, _), ids in zip(group, self._ids_of_parts([part for _, part in group])):
                found[row].append(ids)
        return [b"".join(parts) for parts in found]

    def _ids_of_parts(self, parts: list[str]) -> Iterator[bytes]:
        # No token and no step before the tokens reaches across a blank or line feed.
        lines = pa.array([_on_one_line(part) for part in parts], pa.string())
        words = pc.split_pattern(pc.replace_substring_regex(lines, _MARKS, r"\1 \2"), " ")
        ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
        numbered = words.flatten().dictionary_encode()
        ids = self.known.look(numbered.dictionary.to_pylist())
        word, pool = numbered.indices.to_numpy(), np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts, many = (np.cumsum(sizes) - sizes)[word], sizes[word]
        upto = np.cumsum(many)
        placed = pool[np.repeat(firsts - upto + many, many) + np.arange(many.sum())]
        at = 0
        for end in np.concatenate([[0], upto])[ends].tolist():
            yield placed[at:end].tobytes()
            at = end


def _on_one_line(part: str) -> str:
    return " ".join([line.lower() if _is_plain(line) else line for line in part.split("\n")])


def _cut(text: str) -> Iterator[str]:
    """The text in parts that are encoded alike alone: each starts at a blank or line feed."""
    lo = 0
    while len(text) - lo > AT_ONCE:
        blank, line = text.find(" ", lo + AT_ONCE), text.find("\n", lo + AT_ONCE)
        at = min((x for x in (blank, line) if x >= 0), default=len(text))
        yield text[lo:at]
        lo = at
    yield text[lo:]


def _groups(texts: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """Parts of texts with their rows, about `AT_ONCE` characters at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for part in _cut(text.as_py() or ""):
            held.append((row, part))
            size += len(part)
            if size >= AT_ONCE:
                yield held
                held, size = [], 0
    yield held


def pieces(
    docs: DataFrame, tokenizer: str, text: str = "text", end: int = END, width: int = WIDTH
) -> DataFrame:
    """A row for every piece of a text: its other columns, piece, start, length and ids.

    `tokenizer` is the path of a tokenizer file, read by the driver. Ids are unsigned
    little-endian 32-bit numbers in a row. Strings of special tokens are ordinary text.
    """
    bound_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast((file.read(), []))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # One thread for each task.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        source, kept = sent.value
        if not kept:
            kept.append(Encoder(source))
        last = np.uint32(end).astype("<u4").tobytes()
        for batch in batches:
            out = []
            for ids in kept[0].encode(batch):
                ids += last
                parts = [ids[lo : lo + 4 * width] for lo in range(0, len(ids), 4 * width)]
                out.append(
                    [
                        {"piece": i, "start": i * width, "length": len(part) // 4, "ids": part}
                        for i, part in enumerate(parts)
                    ]
                )
            kind = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
            yield pa.array(out, pa.list_(pa.struct(kind)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    (name,) = own(docs, "found")
    kept = others(docs, text, "piece", "start", "length", "ids")
    return docs.select(*kept, F.explode(F.arrow_udf(run, PIECES)(F.col(text))).alias(name)).select(*kept, f"{name}.*")


def pack(
    pieces: DataFrame,
    length: str = "length",
    width: int = WIDTH,
    sequence: str = "sequence_id",
    offset: str = "offset",
) -> DataFrame:
    """All rows with the sequence they belong to and their place in it."""
    spark = pieces.sparkSession
    kept = others(pieces, sequence, offset)
    file, at, rank, count, slot = own(pieces, "file", "at", "rank", "count", "slot")
    rows = written(pieces.select(*kept), "pieces").select(
        "*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at)
    )
    counted = rows.groupBy(F.col(file).alias("file"), F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    # As many rows as there are lengths, so at most `width`.
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()
    slots, _ = plan({row["length"]: row["n"] for row in totals}, width)
    kind = ", ".join(f"{name} bigint" for name in Slots._fields)
    planned = spark.createDataFrame(slots, kind).select(F.struct("*").alias(slot))
    earlier = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    before = before.select(F.struct("*").alias(count))
    in_file = F.row_number().over(Window.partitionBy(file, length).orderBy(at)) - 1
    ranked = (
        rows.withColumn(rank, in_file)
        .join(before, (F.col(file) == F.col(f"{count}.file")) & (F.col(length) == F.col(f"{count}.length")))
        .withColumn(rank, F.col(f"{count}.n") + F.col(rank))
    )
    nth, each = F.col(rank) - F.col(f"{slot}.first"), F.col(f"{slot}.each")
    found = (F.col(length) == F.col(f"{slot}.length")) & (nth >= 0) & (nth < each * F.col(f"{slot}.sequences"))
    return ranked.join(F.broadcast(planned), found).select(
        *kept,
        (F.col(f"{slot}.sequence") + F.floor(nth / each)).alias(sequence),
        (F.col(f"{slot}.offset") + nth % each * F.col(length)).alias(offset),
    )
