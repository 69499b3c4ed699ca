"""Texts as byte buffers and word hashes, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space that parts words: blank and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACES]] = True
# Bytes that one step of the word hashing holds at a time.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(int(base), -1, 1 << 64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts and ends; nulls are empty."""
    plain = pc.fill_null(texts, "") if texts.null_count else texts
    plain = plain.cast(pa.large_binary())
    n = len(plain)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + n + 1]
    data = plain.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Where to cut the buffer into pieces so that no word is cut."""
    cuts, n = [0], len(buf)
    while n - cuts[-1] > PIECE:
        at = cuts[-1] + PIECE
        row = int(offsets[min(np.searchsorted(offsets, at), len(offsets) - 1)])
        end = at
        while end < row:
            found = np.flatnonzero(_SPACE[buf[end : min(end + 4096, row)]])
            if len(found):
                row = end + int(found[0])
                break
            end += 4096
        cuts.append(row)
    if n > cuts[-1]:
        cuts.append(n)
    return cuts


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and how many words each row has."""
    hashes, starts_of = [], []
    cuts = _cuts(buf, offsets)
    table = powers(int(_BASE), 4096)
    for lo, hi in zip(cuts, cuts[1:]):
        part = buf[lo:hi]
        word = ~_SPACE[part]
        edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        before = np.concatenate(([False], word[:-1]))
        before[edges] = False
        starts = np.flatnonzero(word & ~before)
        if len(starts) == 0:
            continue
        where = np.flatnonzero(word)
        # Every word byte belongs to the last start at or before it.
        ordinal = np.cumsum((word & ~before)[where]) - 1
        depth = where - starts[ordinal]
        longest = int(depth.max()) + 1
        if longest > len(table):
            table = powers(int(_BASE), longest)
        values = (part[where].astype(np.uint64) + np.uint64(1)) * table[depth]
        firsts = np.flatnonzero(depth == 0)
        hashes.append(np.add.reduceat(values, firsts))
        starts_of.append(starts + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts = np.concatenate(starts_of)
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(np.concatenate(hashes)), counts


def runs(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of `width` words within a row, and the word it starts at.

    Rows with fewer words have no run.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)
    at = np.flatnonzero(left >= width)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = mix(out * _BASE + hashes[at + j])
    return out, at


def row_groups(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about `most` items each; a larger row stands alone."""
    ends, out, lo = np.cumsum(counts), [], 0
    while lo < len(counts):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the byte flags of every row."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(flags, offsets[full], dtype=np.int64)
    return out


def of_bytes(marked: bytes) -> np.ndarray:
    """Lookup table of the bytes that are marked."""
    table = np.zeros(256, np.uint8)
    table[list(marked)] = 1
    return table


def not_space() -> np.ndarray:
    return ~_SPACE
