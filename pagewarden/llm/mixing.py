"""Interleaving sources by target weights, as fair as blocks allow.

Each source is cut into blocks of about equal length. Block i of a source with weight w
(its share of all blocks) may be placed from slot floor(i / w) on and is due by slot
ceil((i + 1) / w); the released block with the earliest deadline gets the slot. At any
slot every source then is less than one block from its share, as long as it lasts.

Weights are exact fractions, for any number of sources. The driver walks through the
blocks that there are, one step for each `block_chars` of text, and stretches of slots that
ended sources leave empty are leapt over; rows get their slots by a join with the blocks.
A source that ends leaves its slots empty; the others go on in their own ratio. No row is
dropped or repeated.

With a `period` weights are whole parts of it instead, and its order repeats: block i of a
source with a parts takes the place of block i mod a in period i div a. Shares then are
exact to a part only.

Null sources are a source of their own. Empty and null texts have length zero and stand
in the block where they fall. Repeated rows all stay. Sources without a weight come after
those with one, in equal shares; in a period they get one part. An empty table stays empty.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewarden.llm.names import others, own

PERIOD = 1000
BLOCK_CHARS = 1 << 16
# Ranges of the shuffled order in which lengths are added up; a source of any size
# becomes so many pieces.
RANGES = 1024
# Blocks of all sources together, at most about.
MOST_BLOCKS = 1 << 19
# Characters that a range of a source holds, about.
RANGE_CHARS = 1 << 26


def parts_of(weights: dict, period: int = PERIOD) -> dict:
    """Whole parts of the period for each source, one at least, by largest remainder."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots, not {period}")
    total = sum(weights.values())
    if not weights or total <= 0:
        return {name: 1 for name in weights}
    whole = sum(map(Fraction, weights.values()))
    exact = {name: Fraction(weight) / whole * period for name, weight in weights.items()}
    parts = {name: max(1, int(share)) for name, share in exact.items()}
    left = period - sum(parts.values())
    by_rest = sorted(exact, key=lambda name: (parts[name] - exact[name], str(name)))
    for name in by_rest[: max(left, 0)]:
        parts[name] += 1
    # Parts that the least sources have beyond their share come from the largest.
    for _ in range(-left):
        most = max((n for n in parts if parts[n] > 1), key=lambda n: (parts[n] - exact[n], str(n)))
        parts[most] -= 1
    return parts


def period_order(parts: dict) -> list:
    """The source of every slot of one period: of the released blocks the earliest due."""
    period = sum(parts.values())
    names = sorted(parts, key=lambda name: (name is not None, str(name)))

    def block(name_at: int, i: int) -> tuple[int, int]:
        a = parts[names[name_at]]
        return i * period // a, -(-(i + 1) * period // a)

    waiting = [(0, at, 0) for at in range(len(names))]
    heapq.heapify(waiting)
    due: list[tuple[int, int, int]] = []
    order = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, at, i = heapq.heappop(waiting)
            heapq.heappush(due, (block(at, i)[1], at, i))
        _, at, i = heapq.heappop(due)
        order.append(names[at])
        if i + 1 < parts[names[at]]:
            heapq.heappush(waiting, (block(at, i + 1)[0], at, i + 1))
    return order


def repeated_slots(blocks: dict, weights: dict, period: int) -> dict:
    """The slots of every source's blocks, the order of one period repeated."""
    parts = parts_of(weights, period)
    places: dict = {name: [] for name in parts}
    for slot, name in enumerate(period_order(parts)):
        places[name].append(slot)
    return {
        name: [i // parts[name] * period + places[name][i % parts[name]] for i in range(count)]
        for name, count in blocks.items()
    }


def exact_slots(blocks: dict, weights: dict) -> dict:
    """The slots of every source's blocks by the weights themselves."""
    slots: dict = {name: [] for name in blocks}
    ordered = sorted(blocks, key=lambda name: (name is not None, str(name)))
    heavy = [name for name in ordered if weights[name] > 0]
    first = 0
    for names in (heavy, [name for name in ordered if weights[name] <= 0]):
        exact = [Fraction(weights[name]) if names is heavy else Fraction(1) for name in names]
        scale = lcm(*(w.denominator for w in exact))
        shares = [int(w * scale) for w in exact]
        total = sum(shares)
        waiting = [(0, at, 0) for at in range(len(names))]
        due: list[tuple[int, int, int]] = []
        slot = 0
        while waiting or due:
            if not due:
                slot = max(slot, waiting[0][0])
            while waiting and waiting[0][0] <= slot:
                _, at, i = heapq.heappop(waiting)
                heapq.heappush(due, (-(-(i + 1) * total // shares[at]), at, i))
            _, at, i = heapq.heappop(due)
            slots[names[at]].append(first + slot)
            slot += 1
            if i + 1 < blocks[names[at]]:
                heapq.heappush(waiting, ((i + 1) * total // shares[at], at, i + 1))
        first += slot
    return slots


def granularity(sizes: dict, block_chars: int = BLOCK_CHARS, ranges: int = RANGES) -> tuple[int, int]:
    """How long blocks are, and how many ranges a source has, for sources of these lengths.

    Blocks grow with the corpus, so that their order, which is made on the driver and sent
    to all tasks, has at most `MOST_BLOCKS` rows besides one for each source. Ranges grow
    in number, so that each holds about `RANGE_CHARS` of the largest source at most.
    """
    most = max(sizes.values(), default=0)
    return max(block_chars, -(-sum(sizes.values()) // MOST_BLOCKS)), max(ranges, -(-most // RANGE_CHARS))


def source_sizes(docs: DataFrame, source: str, length: Column) -> dict:
    """Length of every source."""
    rows = (
        docs.groupBy(F.col(source).cast("string").alias("name"))
        .agg(F.sum(length).alias("size"))
        .collect()
    )
    return {row["name"]: row["size"] or 0 for row in rows}


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    *,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    period: int | None = None,
    block_chars: int = BLOCK_CHARS,
    ranges: int = RANGES,
    seed: int = 17,
) -> DataFrame:
    """All rows and columns, with (block, slot, place).

    `slot` orders the blocks of all sources, `place` the rows of a block. Within a
    source the order is a shuffle by a hash of id and text. Without weights a source
    weighs the square root of its length, so that small sources are not drowned.
    Columns named like the three are replaced.
    """
    length = F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    sizes = source_sizes(docs, source, length)
    if len(sizes) > MOST_BLOCKS:
        raise ValueError(f"{len(sizes)} sources are more than {MOST_BLOCKS}: their order cannot be planned")
    block_chars, ranges = granularity(sizes, block_chars, ranges)
    if weights is None:
        weights = {name: max(1.0, float(size) ** 0.5) for name, size in sizes.items()}
    weights = {name: weights.get(name, 0) for name in sizes}
    blocks = {name: size // block_chars + 1 for name, size in sizes.items()}
    slots = repeated_slots(blocks, weights, period) if period else exact_slots(blocks, weights)

    rest = others(docs, "block", "slot", "place")
    key, size, shuffled, piece, name, nth_block, slot, of, within, start, before, nth, block = own(
        docs, *"key size shuffled piece name nth_block slot of within start before nth block".split()
    )
    # One row for each block of the whole table.
    names = pa.array(list(slots), pa.string())
    counts = [len(own_slots) for own_slots in slots.values()]
    template = docs.sparkSession.createDataFrame(
        pa.table(
            {
                name: names.take(pa.array([n for n, c in enumerate(counts) for _ in range(c)], pa.int32())),
                nth_block: pa.array([i for c in counts for i in range(c)], pa.int64()),
                slot: pa.array([at for own_slots in slots.values() for at in own_slots], pa.int64()),
            }
        )
    )

    keyed = docs.select(
        *rest,
        F.col(source).cast("string").alias(key),
        length.alias(size),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias(shuffled),
    ).withColumn(piece, F.pmod(F.shiftright(shuffled, 40), F.lit(ranges)))
    earlier = W.partitionBy(of).orderBy(within).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(F.col(key).alias(of), F.col(piece).alias(within))
        .agg(F.sum(size).alias(start))
        .withColumn(start, F.coalesce(F.sum(start).over(earlier), F.lit(0)).cast("bigint"))
    )
    rows = W.partitionBy(key, piece).orderBy(shuffled, doc_id)
    placed = (
        keyed.withColumn(
            before, F.coalesce(F.sum(size).over(rows.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        )
        .withColumn(nth, F.row_number().over(rows))
        .join(starts, F.col(key).eqNullSafe(F.col(of)) & (F.col(piece) == F.col(within)))
        .withColumn(block, F.expr(f"({start} + {before}) div {block_chars}"))
        .join(
            F.broadcast(template),
            F.col(key).eqNullSafe(F.col(name)) & (F.col(block) == F.col(nth_block)),
        )
    )
    return placed.select(
        *rest,
        F.col(block).alias("block"),
        F.col(slot).alias("slot"),
        (F.col(piece) * F.lit(1 << 32) + F.col(nth)).alias("place"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix, partition by partition and row by row."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
