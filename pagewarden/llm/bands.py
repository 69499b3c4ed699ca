"""Quality by compression: texts that zstandard shrinks too well or hardly at all go.

A whole text and its chunks of fixed size are compressed. What a ratio may be depends on
the length: the shorter a text, the less there is to repeat, and the more the frame and
the first literals weigh. The bands hold ordinary prose of every length with room on both
sides; below lies text that repeats itself, above text without the regularities of
language, such as encoded or random characters. A text is rejected if its own ratio is
outside the band of its length, or if more than half of its bytes lie in chunks outside
theirs.

Beside the verdict stand plain counts over words, lines and windows of three words, and
the base rule on them. A null or empty text has no words and fails the base rule. Each
row is judged alone: repeated rows get equal results, an empty table gives none, and
other columns stay; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.arrays import (
    SPACES,
    mix,
    not_space,
    of_bytes,
    per_row,
    row_groups,
    runs,
    text_bytes,
    word_hashes,
)
from pagewarden.llm.batches import bound_batches
from pagewarden.llm.names import others, own

LEVEL = 3
CHUNK = 4096
# (bytes from which it holds, least ratio, largest ratio).
BANDS = [
    (0, 0.0, float("inf")),
    (128, 0.35, 1.15),
    (256, 0.33, 0.92),
    (512, 0.32, 0.82),
    (1024, 0.30, 0.74),
    (4096, 0.27, 0.70),
    (16384, 0.25, 0.68),
]
LEAST_WORDS = 50
GROUP_WORDS = 1 << 19
SYMBOLS = b"#*$%&|<>"

RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,ratio:double,odd_chunks:double>"
)


def limits(n_bytes: int, bands: list = BANDS) -> tuple[float, float]:
    """The band of a length."""
    low, high = bands[0][1:]
    for least, *band in bands:
        if n_bytes >= least:
            low, high = band
    return low, high


def ratios(data: bytes, squeeze, chunk: int = CHUNK, bands: list = BANDS) -> tuple[float, float]:
    """Compressed size over size, and the share of bytes in chunks outside their band."""
    if not data:
        return 1.0, 0.0
    whole = len(squeeze(data)) / len(data)
    if len(data) <= chunk:
        low, high = limits(len(data), bands)
        return whole, float(not low <= whole <= high)
    odd = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        low, high = limits(len(part), bands)
        if not low <= len(squeeze(part)) / len(part) <= high:
            odd += len(part)
    return whole, odd / len(data)


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row, how many words lie in a window of three that the row has again."""
    out = np.zeros(len(counts), np.int64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    for lo, hi in row_groups(counts, GROUP_WORDS):
        words, sizes = hashes[ends[lo] : ends[hi]], counts[lo:hi]
        windows, at = runs(words, sizes, 3)
        if len(windows) == 0:
            continue
        row = np.repeat(np.arange(hi - lo), sizes)
        keys = mix(windows ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[at[again] + j] = True
        out[lo:hi] = np.bincount(row[covered], minlength=hi - lo)
    return out


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def _measure(chunk: int, bands: list):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        letters = not_space()
        firsts = of_bytes(bytes(b for b in range(256) if b & 0xC0 != 0x80))
        inside = (firsts.astype(bool) & letters).astype(np.uint8)
        symbols = of_bytes(SYMBOLS)
        for batch in batches:
            buf, offsets = text_bytes(batch)
            hashes, counts = word_hashes(buf, offsets)
            found = [
                ratios(buf[lo:hi].tobytes(), squeeze, chunk, bands)
                for lo, hi in zip(offsets, offsets[1:])
            ]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(counts, pa.int64()),
                    pa.array(per_row(inside[buf], offsets)),
                    pa.array(per_row(symbols[buf], offsets)),
                    pa.array([_repeated_lines(t.as_py() or "") for t in batch], pa.int64()),
                    pa.array(repeated_words(hashes, counts)),
                    pa.array([r for r, _ in found], pa.float64()),
                    pa.array([o for _, o in found], pa.float64()),
                ],
                "n_words word_chars n_symbols n_dup_lines n_repeat_words ratio odd_chunks".split(),
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT)


def judge(docs: DataFrame, text: str = "text", chunk: int = CHUNK, bands: list = BANDS) -> DataFrame:
    """All rows and columns with counts, ratio, odd_chunks, base_failed and kept."""
    bound_batches(docs.sparkSession)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words ratio odd_chunks".split()
    (found,) = own(docs, "found")
    rest = others(docs, *names, "base_failed", "kept")
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    low, high = F.lit(bands[0][1]), F.lit(bands[0][2])
    for least, below, above in bands[1:]:
        low = F.when(size >= least, below).otherwise(low)
        high = F.when(size >= least, above).otherwise(high)
    failed = (F.col(f"{found}.n_words") < LEAST_WORDS) | (
        100 * F.col(f"{found}.n_repeat_words") > 50 * F.col(f"{found}.n_words")
    )
    within = F.col(f"{found}.ratio").between(low, high) & (F.col(f"{found}.odd_chunks") <= 0.5)
    return docs.withColumn(found, _measure(chunk, bands)(F.col(text))).select(
        *rest,
        *[F.col(f"{found}.{name}").alias(name) for name in names],
        failed.alias("base_failed"),
        (~failed & within).alias("kept"),
    )
