"""Byte-level BPE: texts to token ids and back, by the ranks of a given vocabulary.

A text is parted by the tokenizer's pattern, and each part is merged on its own.
Within a part the next merge comes from a rank queue: a bucket per merge rank holds
the places of the pairs that have it, and a bitmap in two levels over the ranks finds
the lowest filled bucket by two find-first-set steps. Places form a linked list; an
entry whose pair has changed since it was queued is stale and skipped. Parts not seen
lately share one queue, a few texts at a time. A part of n bytes takes about n log n
steps, so one of a megabyte is no trouble.

A null text counts as empty and has no ids. Rows are worked on one by one: repeated
rows give repeated results, an empty table an empty one, and other columns stay as
they are; a column named like the output is replaced.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.llm.batches import bound_batches
from pagewarden.llm.names import others, own
from pagewarden.llm.remember import REMEMBERED, Remembered

# Longer texts are parted as they are read, and not into a list at once.
LIST_CHARS = 1 << 22
# Parts of several texts are looked up and merged together, about so many at a time.
AT_ONCE = 50_000
_WORD = 8
_LAST = (1 << _WORD) - 1
_BIT = [1 << i for i in range(1 << _WORD)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one part: the lowest rank merges first, of equal ranks the leftmost."""
    return np.frombuffer(merge_all([piece], ranks)[0], np.int32).tolist()


def _queued(pair: np.ndarray) -> tuple[dict[int, list[int]], dict[int, int], int]:
    """Buckets of places by rank, and the two levels of the bitmap that says which are filled."""
    order = np.argsort(pair, kind="stable")
    order = order[np.searchsorted(pair[order], 0) :]
    filled, first = np.unique(pair[order], return_index=True)
    places, ends = order.tolist(), [*first.tolist()[1:], len(order)]
    buckets, words, top = {}, {}, 0
    for r, lo, hi in zip(filled.tolist(), first.tolist(), ends):
        buckets[r] = places[lo:hi]
        w = r >> _WORD
        words[w] = words.get(w, 0) | _BIT[r & _LAST]
        top |= 1 << w
    return buckets, words, top


def merge_all(pieces: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Ids of every part, as 32-bit numbers. All lie in one buffer under one rank queue; none pairs with the next."""
    buf, rank_of = b"".join(pieces), ranks.get
    n = len(buf)
    if n == 0:
        return [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    data = np.frombuffer(buf, np.uint8).astype(np.int64)
    # Ranks of the pairs of neighbours; the last byte of a part has no neighbour.
    codes, which = np.unique(data[:-1] << 8 | data[1:], return_inverse=True)
    known = np.fromiter((rank_of(bytes(divmod(c, 256)), -1) for c in codes.tolist()), np.int64, len(codes))
    first_pairs = np.append(known[which], -1)
    first_pairs[ends[lengths > 0] - 1] = -1
    buckets, words, top = _queued(first_pairs)
    pair = first_pairs.tolist()
    token = np.fromiter((rank_of(bytes([c]), -1) for c in range(256)), np.int64, 256)[data].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    opens, closes, gone = bytearray(n), bytearray(n), bytearray(n)
    for start, end in zip((ends - lengths).tolist(), ends.tolist()):
        if start < end:
            opens[start] = closes[end - 1] = 1
    while top:
        w = (top & -top).bit_length() - 1
        bits = words[w]
        r = (w << _WORD) | ((bits & -bits).bit_length() - 1)
        places = buckets.pop(r)
        words[w] = bits = bits & (bits - 1)
        if not bits:
            top &= top - 1
        places.sort()
        for at, i in enumerate(places, 1):
            # An entry whose pair has changed since is stale.
            if pair[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            token[i], gone[j], pair[j] = r, 1, -1
            lowest = r
            if closes[j]:
                closes[i], pair[i] = 1, -1
            else:
                before[k] = i
                pair[i] = new = rank_of(buf[i : after[k]], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        w = new >> _WORD
                        words[w] = words.get(w, 0) | _BIT[new & _LAST]
                        top |= 1 << w
                    if new < lowest:
                        lowest = new
            if not opens[i]:
                p = before[i]
                pair[p] = new = rank_of(buf[p:k], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(p)
                    else:
                        buckets[new] = [p]
                        w = new >> _WORD
                        words[w] = words.get(w, 0) | _BIT[new & _LAST]
                        top |= 1 << w
                    if new < lowest:
                        lowest = new
            if lowest < r and at < len(places):
                # A lower rank has come up and goes first; the rest of the bucket waits.
                buckets[r] = places[at:]
                w = r >> _WORD
                words[w] = words.get(w, 0) | _BIT[r & _LAST]
                top |= 1 << w
                break
    stays = np.frombuffer(gone, np.uint8) == 0
    ids = np.array(token, np.int32)[stays].tobytes()
    upto = (4 * np.append(0, np.cumsum(stays))[np.append(0, ends)]).tolist()
    return [ids[lo:hi] for lo, hi in zip(upto, upto[1:])]


def _known(ranks: dict[bytes, int]) -> Remembered:
    """Ids by part, as 32-bit numbers."""

    def work(parts: list[str]) -> list[bytes]:
        coded = [part.encode() for part in parts]
        # A part that is one token needs no merges.
        whole = [ranks.get(piece) for piece in coded]
        merged = iter(merge_all([piece for piece, rank in zip(coded, whole) if rank is None], ranks))
        return [next(merged) if rank is None else rank.to_bytes(4, sys.byteorder) for rank in whole]

    return Remembered(work, REMEMBERED)


def _pieces(pattern: regex.Pattern, texts: pa.Array) -> Iterator[tuple[list[str], bool]]:
    """Parts of the texts in turn, and whether a text ends with them; a long one comes in several lists."""
    for text in texts:
        text = text.as_py() or ""
        if len(text) <= LIST_CHARS:
            yield pattern.findall(text), True
            continue
        found = (match[0] for match in pattern.finditer(text))
        while some := list(islice(found, AT_ONCE)):
            yield some, False
        yield [], True


def _coded(texts: pa.Array, known: Remembered, split: regex.Pattern) -> pa.ListArray:
    """Ids of every text."""
    ids, ends, held, size = bytearray(), [0], [], 0

    def settle() -> None:
        ids_of = known.learn(set(chain.from_iterable(parts for parts, _ in held)))
        for parts, ended in held:
            ids.extend(b"".join(map(ids_of, parts)))
            if ended:
                ends.append(len(ids) // 4)
        held.clear()

    for parts, ended in _pieces(split, texts):
        held.append((parts, ended))
        size += len(parts)
        if size >= AT_ONCE:
            settle()
            size = 0
    settle()
    values = pa.array(np.frombuffer(ids, np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _bytes_of(ids: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    """Bytes of every list of ids; null lists have none."""
    values, token = ids.flatten().to_numpy(zero_copy_only=False), tokens.__getitem__
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    starts = np.concatenate(([0], ends[:-1]))
    return pa.array(
        [b"".join(map(token, values[lo:hi].tolist())) for lo, hi in zip(starts, ends)], pa.binary()
    )


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _applied(docs: DataFrame, column: str, work, kind, state) -> Column:
    """A column of `work(state of this Python worker, batch)`; `state` is made from what is sent."""
    bound_batches(docs.sparkSession)
    make, given = state
    # One value for each Python worker, so that its tasks share what is remembered.
    sent = docs.sparkSession.sparkContext.broadcast((given, []))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        value, kept = sent.value
        if not kept:
            kept.append(make(value))
        for batch in batches:
            yield work(kept[0], batch)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(F.col(column))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids"
) -> DataFrame:
    """The rows with the token ids of their whole text."""
    split = regex.compile(pattern)
    ids = _applied(
        docs, text, lambda parts, batch: _coded(batch, parts, split), T.ArrayType(T.IntegerType()), (_known, ranks)
    )
    return docs.withColumn(out, ids)


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids; null ids give no bytes."""
    found = _applied(docs, ids, lambda tokens, batch: _bytes_of(batch, tokens), T.BinaryType(), (_tokens, ranks))
    return docs.withColumn(out, found)


def round_trip(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
) -> DataFrame:
    """`decode` after `encode`, in one Python worker: ids are decoded before they leave it."""
    split = regex.compile(pattern)

    def both(state, batch: pa.Array) -> pa.Array:
        parts, tokens = state
        coded = _coded(batch, parts, split)
        return pa.StructArray.from_arrays([coded, _bytes_of(coded, tokens)], ["ids", "decoded"])

    found = _applied(
        docs, text, both, "struct<ids:array<int>,decoded:binary>", (lambda r: (_known(r), _tokens(r)), ranks)
    )
    (name,) = own(docs, "coded")
    return docs.withColumn(name, found).select(
        *others(docs, ids, decoded), F.col(f"{name}.ids").alias(ids), F.col(f"{name}.decoded").alias(decoded)
    )


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas, in lowercase hex."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
