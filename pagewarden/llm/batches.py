"""Arrow batches: how large they grow, and streams of sorted ones, cut where a group ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pagewarden.session import BATCH_BYTES, bound_batches  # noqa: F401


def by_groups(work: Callable[[pa.Table], pa.RecordBatch], keys: tuple[str, ...]):
    """A function for `mapInArrow` that gives `work` whole groups of equal keys, many at a time."""

    def last_start(table: pa.Table) -> int:
        changed = np.zeros(table.num_rows - 1, bool)
        for name in keys:
            values = table[name].to_numpy()
            changed |= values[1:] != values[:-1]
        last = np.flatnonzero(changed)
        return int(last[-1]) + 1 if len(last) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([*held, batch])
            # The last group may go on in the next batch.
            cut = last_start(table)
            if cut:
                yield work(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run
