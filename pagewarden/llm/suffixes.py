"""Removing passages that occur again, by suffix arrays in levels.

Every byte goes that lies in a string of WIDTH bytes which also starts somewhere else,
in another document or the same. Strings are judged on the input.

Of the start of every such string only those need comparing that could be equal. A
string's seed is its 50 bytes with the least hash, so equal strings have equal seeds at
equal places. Neighbouring starts share their seed and make one stretch of text; about
one byte in 75 is a seed. Seeds and stretches travel as hashes: seeds that occur once
drop out by a count that is added up before the shuffle, and stretches that are equal as
a whole are settled by their hash.

What is left, stretches that share a seed and differ somewhere, goes with its bytes to
the index: each batch of stretches gets a suffix array of its starts, compared as far
as WIDTH; the array is merge-scanned against the levels that stand, where equal
neighbours are matches; and levels of equal size merge into one twice as large. Batches
end where a seed ends, and the levels of a seed go with it. The starts of a crowded seed
are parted by a hash of their strings into as many sets of levels as keep each to about
`HELD` stretches; a stretch goes to those sets that some of its starts belong to.

Null and empty texts have no bytes. A document shorter than WIDTH keeps all. Rows with
equal id and text are two places, so they lose all that is long enough. Rows without an
id take part like others. Other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.arrays import inverse, mix, powers, row_groups, text_bytes
from pagewarden.llm.batches import bound_batches, by_groups
from pagewarden.llm.links import written
from pagewarden.llm.names import others, own

WIDTH = 200
SEED = 50
# Bytes hashed in one go; places within them take 20 bits.
GROUP_BYTES = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
# Stretches that get one suffix array.
BATCH = 2000
# Differing stretches of one seed that one set of levels holds, about.
HELD = 20_000
# A place keeps the number of starts in its lowest bits.
_STARTS = 256


class _Hashes:
    """Polynomial hashes of all substrings of a buffer, modulo 2 ** 64."""

    def __init__(self, size: int):
        self.up = powers(_BASE, size + 1)
        self.down = powers(inverse(_BASE), size + 1)

    def load(self, buf: np.ndarray) -> None:
        n = len(buf)
        if n >= len(self.up):
            self.__init__(2 * n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of this width."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:-width]) * self.down[:n]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` neighbours."""
    n = len(keys)
    full = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    table = full.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], ahead[span - 1 : n])


def stretches(
    buf: np.ndarray, edges: np.ndarray, hashes: _Hashes, width: int, seed: int
) -> tuple[np.ndarray, ...]:
    """(seed hash, stretch hash, first start, starts) of a buffer of rows with these edges."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    if len(buf) < width:
        return none
    hashes.load(buf)
    seeds = mix(hashes.every(seed))
    places = np.arange(len(seeds), dtype=np.uint64)
    # The leftmost of equal seeds counts.
    least = _least((seeds & ~_PLACE) | places, width - seed + 1)
    start = np.arange(len(least))
    # Starts whose string stays within its row.
    row_end = np.repeat(edges[1:], np.diff(edges))[: len(least)]
    start = start[start + width <= row_end]
    if len(start) == 0:
        return none
    at = (least[start] & _PLACE).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(start)])))
    lo = start[first]
    return seeds[at[first]], hashes.of(lo, lo + count - 1 + width), lo, count


def _cutter(width: int, seed: int):
    """Stretches of every text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes(GROUP_BYTES + width)
        for batch in batches:
            buf, offsets = text_bytes(batch)
            sizes = np.diff(offsets)
            found, rows = [], []
            for lo, hi in row_groups(sizes, GROUP_BYTES):
                a, b = offsets[lo], offsets[hi]
                # A text larger than a group is read in overlapping parts.
                step = GROUP_BYTES if hi - lo == 1 else max(1, b - a)
                for at in range(a, b, step):
                    end = min(b, at + step + width - 1)
                    edges = offsets[lo : hi + 1] - at if hi - lo > 1 else np.array([0, end - at])
                    s, c, first, n = stretches(buf[at:end], edges, hashes, width, seed)
                    row = lo + np.searchsorted(edges, first, side="right") - 1
                    found.append((s, c, first + at - offsets[row], n))
                    rows.append(row)
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.uint64)] * 4
            ends = np.searchsorted(rows, np.arange(len(sizes) + 1))
            values = pa.StructArray.from_arrays(
                [
                    pa.array(parts[0].view(np.int64)),
                    pa.array(parts[1].view(np.int64)),
                    pa.array(parts[2].astype(np.int64) * 256 + parts[3].astype(np.int64)),
                ],
                ["seed", "stretch", "place"],
            )
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<seed:bigint,stretch:bigint,place:bigint>>")


def _copier(width: int):
    """Bytes of the stretches that a text is asked for."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, asked in batches:
            out, ends = [], [0]
            for text, places in zip(texts, asked):
                data = (text.as_py() or "").encode()
                for place in places.as_py() or ():
                    lo, n = place["place"] // 256, place["place"] % 256
                    out.append(data[lo : lo + n - 1 + width])
                ends.append(len(out))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.binary()))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<binary>")


class Levels:
    """Suffix arrays in levels. A level is the sorted starts of its batches' strings."""

    def __init__(self, width: int):
        self.width = width
        self.text: list[bytes] = []
        self.again: list[bytearray] = []
        # (number of batches, starts in order); a start is (stretch, offset).
        self.levels: list[tuple[int, list[tuple[int, int]]]] = []

    def _string(self, start: tuple[int, int]) -> bytes:
        return self.text[start[0]][start[1] : start[1] + self.width]

    def add(self, batch: list[bytes], own: list[bytes] | None = None) -> None:
        """Index the starts of these stretches, or only those that `own` names for each."""
        base, width = len(self.text), self.width
        self.text += batch
        self.again += [bytearray(len(t) - width + 1) for t in batch]
        starts = [
            (base + i, j) for i, t in enumerate(batch) for j in (own[i] if own else range(len(t) - width + 1))
        ]
        fresh = self._scan(starts)
        size = 1
        # Every level is scanned; those of equal size become one on the way.
        kept = []
        for count, level in reversed(self.levels):
            both = self._scan(fresh + level)
            if count == size:
                fresh, size = both, 2 * size
            else:
                kept.append((count, level))
        self.levels = [*reversed(kept), (size, fresh)]

    def _scan(self, starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The starts in order of their strings, those of equal strings marked.

        Sorted runs one behind the other are merged and not sorted anew.
        """
        strings = list(map(self._string, starts))
        order = sorted(range(len(starts)), key=strings.__getitem__)
        out, again = [], self.again
        last = None
        for i in order:
            string, start = strings[i], starts[i]
            if string == last:
                stretch, offset = out[-1]
                again[stretch][offset] = 1
                again[start[0]][start[1]] = 1
                # One start stands for all that are equal.
                continue
            out.append(start)
            last = string
        return out


def _indexed(width: int):
    """Runs of starts with a match, from stretches sorted by seed."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("place", pa.int64())])

    def matches(table: pa.Table) -> pa.RecordBatch:
        seeds, parts = table["seed"].to_numpy(), table["part"].to_numpy()
        texts, own = table["bytes"].to_pylist(), table["own"].to_pylist()
        out_row, out_place = [], []
        new = (seeds[1:] != seeds[:-1]) | (parts[1:] != parts[:-1])
        ends = np.concatenate((np.flatnonzero(new) + 1, [len(seeds)]))
        lo = 0
        while lo < len(seeds):
            # Whole seeds up to a batch; a larger seed goes through the levels by itself.
            hi = int(ends[max(np.searchsorted(ends, lo + BATCH, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
            levels = Levels(width)
            for at in range(lo, hi, BATCH):
                upto = min(hi, at + BATCH)
                levels.add(texts[at:upto], own[at:upto])
            for row, again in enumerate(levels.again, lo):
                flags = np.frombuffer(bytes(again), np.uint8)
                step = np.diff(np.concatenate(([0], flags, [0])).astype(np.int8))
                for a, b in zip(np.flatnonzero(step > 0), np.flatnonzero(step < 0)):
                    out_row.append(row)
                    out_place.append((a, b - a))
            lo = hi
        places = table["place"].to_numpy()[out_row] // 256 if out_row else np.zeros(0, np.int64)
        spans = np.array(out_place, np.int64).reshape(-1, 2)
        picked = table.take(pa.array(out_row, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                picked["doc_id"].combine_chunks(),
                picked["row"].combine_chunks(),
                pa.array((places + spans[:, 0]) * 256 + spans[:, 1]),
            ],
            schema=schema,
        )

    return by_groups(matches, ("seed", "part"))


def _parted(width: int):
    """For each part of its seed that has starts of a stretch, the part and these starts."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = _Hashes(4096)
        kind = pa.list_(pa.struct([("part", pa.int64()), ("own", pa.binary())]))
        for stretches, sets in batches:
            out = []
            for item, many in zip(stretches, sets.to_pylist()):
                data = np.frombuffer(item.as_py(), np.uint8)
                if many == 1:
                    part = np.zeros(len(data) - width + 1, np.int64)
                else:
                    hashes.load(data)
                    part = (mix(hashes.every(width)) % np.uint64(many)).astype(np.int64)
                out.append([{"part": p, "own": bytes(np.flatnonzero(part == p).tolist())} for p in np.unique(part).tolist()])
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<part:bigint,own:binary>>")


def _remover(width: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            kept, removed, spans, sizes = [], [], [], []
            for text, found in zip(texts, places):
                data = (text.as_py() or "").encode()
                sizes.append(len(data))
                at = np.sort(np.array(found.as_py() or (), np.int64))
                if len(at) == 0:
                    kept.append(data)
                    removed.append(0)
                    spans.append(0)
                    continue
                lo = at // 256
                hi = np.maximum.accumulate(lo + at % 256 - 1 + width)
                # A run ends where the next start lies beyond all ends so far.
                breaks = np.flatnonzero(lo[1:] > hi[:-1]) + 1
                first = lo[np.concatenate(([0], breaks))]
                last = hi[np.concatenate((breaks - 1, [len(hi) - 1]))]
                pieces = zip(np.concatenate(([0], last)), np.concatenate((first, [len(data)])))
                kept.append(b"".join(data[a:b] for a, b in pieces))
                removed.append(int((last - first).sum()))
                spans.append(len(first))
            yield pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (sizes, removed, spans)] + [pa.array(kept, pa.binary())],
                ["n_bytes", "n_removed", "n_spans", "kept"],
            )

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")


def repeated_places(source: DataFrame, width: int = WIDTH, seed: int = SEED, held: int = HELD) -> DataFrame:
    """(doc_id, row, place) of all starts whose string occurs again.

    `source` is (doc_id, row, text). A place is 256 times the first start plus how many
    starts follow one another.
    """
    if not 0 < seed <= width < seed + _STARTS - 1:
        raise ValueError(f"strings of {width} bytes need a seed of {width - _STARTS + 2} to {width} bytes")
    bound_batches(source.sparkSession)
    cut = _cutter(width, seed)(F.col("text"))
    found = source.select("doc_id", "row", F.explode(cut).alias("s")).select("doc_id", "row", "s.*")
    found = written(found, "stretches")
    seeds = (
        found.groupBy("seed")
        .agg(F.count("place").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
        .where("n > 1")
        .select("seed", (F.col("low") == F.col("high")).alias("uniform"))
    )
    # Written, so that the join with it may split a seed that much of the data shares.
    seeds = written(seeds, "seeds")
    shared = written(found.join(seeds, "seed"), "shared")
    # Equal as a whole: nothing needs comparing.
    alike = shared.where("uniform").select("doc_id", "row", "place")
    mixed = shared.where("NOT uniform")
    kinds = mixed.groupBy("seed", "stretch").agg(
        F.count("place").alias("n"), F.min(F.struct("doc_id", "row", "place")).alias("at")
    )
    kinds = written(kinds, "kinds")
    # Merged, so that a stretch which much of the data shares may be split.
    twice = kinds.where("n > 1").select("seed", "stretch").hint("merge")
    copied = mixed.join(twice, ["seed", "stretch"], "left_semi")
    sets = kinds.groupBy("seed").agg(F.ceil(F.count("stretch") / held).alias("sets"))
    asked = (
        kinds.join(sets, "seed")
        .select("at.*", F.struct("at.place", "seed", "sets").alias("ask"))
        .groupBy("doc_id", "row")
        .agg(F.collect_list("ask").alias("asks"))
    )
    fetched = (
        source.join(
            asked.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "asks"),
            F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")),
        )
        .withColumn("copies", _copier(width)(F.col("text"), F.col("asks")))
        .select("doc_id", "row", F.explode(F.arrays_zip("asks", "copies")).alias("a"))
        .select("doc_id", "row", "a.asks.*", F.col("a.copies").alias("bytes"))
        .withColumn("parts", _parted(width)(F.col("bytes"), F.col("sets")))
        .select("doc_id", "row", "place", "seed", "bytes", F.inline("parts"))
    )
    matched = (
        written(fetched, "differing")
        .repartition("seed", "part")
        .sortWithinPartitions("seed", "part")
        .mapInArrow(_indexed(width), "doc_id bigint, row bigint, place bigint")
    )
    return alike.unionByName(copied.select("doc_id", "row", "place")).unionByName(matched)


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    seed: int = SEED,
    held: int = HELD,
) -> DataFrame:
    """All rows and columns with n_bytes, n_removed, n_spans and kept, the bytes that stay.

    `kept` is binary, for a cut may part a character.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("row"), whole.alias("text"))
    places = repeated_places(source, width, seed, held)
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    row, of, of_row, spans, found = own(docs, "row", "of", "of_row", "spans", "found")
    per_row = places.groupBy(F.col("doc_id").alias(of), F.col("row").alias(of_row)).agg(
        F.collect_set("place").alias(spans)
    )
    return (
        docs.withColumn(row, F.xxhash64(whole))
        .join(per_row, F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(row) == F.col(of_row)), "left")
        .withColumn(found, _remover(width)(F.col(text), F.col(spans)))
        .select(*others(docs, *names), *[F.col(f"{found}.{name}").alias(name) for name in names])
    )
