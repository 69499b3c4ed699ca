"""Near copies among vectors by cross-polytope hashing.

A rotation is three rounds of random signs and a fast Hadamard transform; the hash of a
vector is the axis, with its sign, that the rotated vector is nearest to. A table's key
joins a few such axes. A vector lives in its home bucket of every table and also visits
the buckets that it misses most narrowly, where another rotation axis comes second best.
Whoever meets in a bucket is compared by cosine in double precision.

Equal vectors of a label are one row with a count first, so copies cost nothing. Buckets
above a fixed size are split into blocks that meet pair by pair, each pair of blocks a
task's worth. Pairs never become rows: a task hands on, for each vector, the sum of its
links and one link to the least vector it is connected with there. A pair that meets in
several buckets counts in the first of them, which the keys that travel along tell.

Vectors are compared only if labels are equal and not null. A vector that is null, zero
or holds null or non-finite numbers, and one without an id, links with nothing and is its
own component. Vectors of different lengths never link. Repeated rows are vectors of
their own that link with each other. Other columns play no part; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.batches import by_groups
from pagewarden.llm.links import components, written

TABLES = 8
AXES = 2
VISITS = 2
LEAST_COSINE = 0.93
# Vectors that meet in one go; larger buckets become blocks.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
        x = x.reshape(n, size)
    return x


def _signs(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).choice([-1.0, 1.0], (3, size))


def keys_of(
    units: np.ndarray, tables: int = TABLES, axes: int = AXES, visits: int = VISITS, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Home keys (rows, tables) and visited keys (rows, tables, visits)."""
    n, dim = units.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = units
    homes = np.zeros((n, tables), np.int64)
    visited = np.zeros((n, tables, visits), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, others, gaps = [], [], []
        for k in range(axes):
            x = padded
            for signs in _signs(size, seed + t * axes + k):
                x = hadamard(x * signs) / np.sqrt(size)
            weight = np.abs(x)
            top = np.argpartition(weight, -min(size, visits + 1), axis=1)[:, -min(size, visits + 1) :]
            order = np.argsort(-np.take_along_axis(weight, top, 1), axis=1, kind="stable")
            top = np.take_along_axis(top, order, 1)
            axis = 2 * top + (np.take_along_axis(x, top, 1) < 0)
            height = np.take_along_axis(weight, top, 1)
            best.append(axis[:, 0])
            others.append(axis[:, 1:])
            gaps.append((height[:, :1] - height[:, 1:]) ** 2)
        base = 2 * size
        for k in range(axes):
            homes[:, t] = homes[:, t] * base + best[k]
        # Swapping one axis for a lesser one; the narrowest misses first.
        gap = np.concatenate(gaps, axis=1)
        order = np.argsort(gap, axis=1, kind="stable")[:, :visits]
        per_axis = others[0].shape[1]
        for j in range(min(visits, order.shape[1])):
            which, nth = order[:, j] // per_axis, order[:, j] % per_axis
            key = np.zeros(n, np.int64)
            for k in range(axes):
                own = np.where(which == k, others[k][rows, nth], best[k])
                key = key * base + own
            visited[:, t, j] = key
    return homes, visited


def _unit_rows(vectors: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Which rows hold a usable vector, and for each length its row numbers."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = sizes > 0
    ends = np.cumsum(sizes)
    finite = np.isfinite(flat)
    nonzero = np.concatenate(([0], np.cumsum(finite & (flat != 0))))
    bad = np.concatenate(([0], np.cumsum(~finite)))
    good &= (bad[ends] - bad[ends - sizes] == 0) & (nonzero[ends] - nonzero[ends - sizes] > 0)
    by_size = {}
    for size in np.unique(sizes[good]):
        which = np.flatnonzero(good & (sizes == size))
        at = (ends - sizes)[which][:, None] + np.arange(size)
        rows = flat[at]
        # Scaled first, so that no square overflows or vanishes.
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)
        by_size[int(size)] = (which, rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None])
    return good, by_size


def _hasher(tables: int, axes: int, visits: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            homes: list = [None] * len(batch)
            visited: list = [None] * len(batch)
            for which, units in _unit_rows(batch)[1].values():
                home, visit = keys_of(units, tables, axes, visits)
                for row, h, v in zip(which, home, visit.reshape(len(which), -1)):
                    homes[row], visited[row] = h, v
            kind = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays(
                [pa.array(homes, kind), pa.array(visited, kind)], ["homes", "visited"]
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<homes:array<bigint>,visited:array<bigint>>")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n points one that all it is connected with share."""
    root = np.arange(n)
    while True:
        one, two = root[i], root[j]
        apart = one != two
        if not apart.any():
            return root
        # Roots are hooked on lower ones, then all points on the root they lead to.
        one, two = one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]


def _meet(least: float, visits: int):
    """Links within buckets, from rows sorted by bucket."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        ids = rows["vec_id"].to_numpy()
        copies = rows["copies"].to_numpy()
        table = rows["t"].to_numpy()
        home = rows["home"].to_numpy(zero_copy_only=False)
        n = len(ids)
        by_size = _unit_rows(rows["vector"].combine_chunks())[1]
        units = np.zeros((n, max(by_size)))
        for size, (which, some) in by_size.items():
            units[which, :size] = some
        homes = rows["homes"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        visited = rows["visited"].combine_chunks().flatten().to_numpy().reshape(n, homes.shape[1], visits)
        bucket = rows["bucket"].to_numpy()
        block = rows["block"].to_numpy()
        part_a, part_b = rows["part_a"].to_numpy(), rows["part_b"].to_numpy()
        total = np.zeros(n, np.int64)
        pairs = []
        at, shift = np.arange(n), 1
        while len(at):
            at = at[at < n - shift]
            other = at + shift
            same = (bucket[at] == bucket[other]) & (part_a[at] == part_a[other]) & (part_b[at] == part_b[other])
            at = at[same]
            one, two = at, at + shift
            # One of the two lives here, and of two blocks each gives one.
            fit = (home[one] | home[two]) & (ids[one] != ids[two])
            fit &= (part_a[one] == part_b[one]) | (block[one] != block[two])
            one, two = one[fit], two[fit]
            for lo in range(0, len(one), 1 << 16):
                i, j = one[lo : lo + (1 << 16)], two[lo : lo + (1 << 16)]
                near = np.einsum("ij,ij->i", units[i], units[j]) >= least
                pairs.append((i[near], j[near]))
            shift += 1
        if not pairs:
            return _no_links
        i, j = (np.concatenate(side) for side in zip(*pairs))
        lower = ids[i] < ids[j]
        i, j = np.where(lower, i, j), np.where(lower, j, i)
        # Met before: in an earlier table, or in this one by an earlier way.
        met = np.zeros(len(i), bool)
        for s in range(homes.shape[1]):
            together = homes[i, s] == homes[j, s]
            second = (visited[j, s] == homes[i, s][:, None]).any(axis=1)
            third = (visited[i, s] == homes[j, s][:, None]).any(axis=1)
            met |= (together | second | third) & (s < table[i])
            # Of two visits in one table the one to the lower id's home counts.
            met |= (s == table[i]) & ~together & second & home[j] & ~home[i]
        # Two that visit a third bucket together never count there.
        i, j = i[~met], j[~met]
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        root = _roots(n, i, j)
        linked = np.flatnonzero(total)
        least_id = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least_id, root[linked], ids[linked])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[linked]), pa.array(total[linked]), pa.array(least_id[root[linked]])],
            schema=_links_schema,
        )

    return by_groups(links, ("bucket", "part_a", "part_b"))


_links_schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])
_no_links = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, schema=_links_schema)


def link(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = LEAST_COSINE,
    tables: int = TABLES,
    axes: int = AXES,
    visits: int = VISITS,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row given."""
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    sum_of = F.aggregate("vector", F.lit(0.0), lambda total, x: total + F.abs(x))
    usable = usable & (sum_of > 0) & ~F.isnan(sum_of)
    usable = usable & F.forall("vector", lambda x: F.abs(x) < float("inf"))
    marked = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    same = [F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")]
    marked = marked.select("vec_id", "usable", "label", "vector", same[0].alias("d1"), same[1].alias("d2"))

    firsts = written(
        marked.where("usable")
        .groupBy("label", "d1", "d2")
        .agg(F.min("vec_id").alias("first"), F.count("vec_id").alias("copies"), F.first("vector").alias("vector")),
        "vectors",
    )
    # Keys are worked out once, after copies have become one row.
    keyed = written(
        firsts.withColumn("keys", _hasher(tables, axes, visits)(F.col("vector"))).select(
            F.col("first").alias("vec_id"), "label", "copies", "vector", "keys.homes", "keys.visited"
        ),
        "keys",
    )
    home = F.transform("homes", lambda key, t: F.struct(t.alias("t"), key.alias("key"), F.lit(True).alias("home")))
    visit = F.transform(
        "visited",
        lambda key, at: F.struct(
            (at / visits).cast("int").alias("t"), key.alias("key"), F.lit(False).alias("home")
        ),
    )
    spots = keyed.select("vec_id", "label", F.size("vector").alias("dim"), F.explode(F.concat(home, visit)).alias("spot"))
    spots = spots.select("vec_id", "spot.t", "spot.home", F.xxhash64("label", "dim", "spot.t", "spot.key").alias("bucket"))
    sizes = (
        spots.groupBy("bucket")
        .agg(F.count("vec_id").alias("size"), F.max("home").alias("lived_in"))
        .where("size > 1 AND lived_in")
        .select("bucket", F.ceil(F.col("size") / block).alias("parts"))
    )
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    placed = spots.join(sizes, "bucket").withColumn("block", part)
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    meeting = placed.select(
        "vec_id", "t", "home", "bucket", "block",
        F.least("block", "with").alias("part_a"), F.greatest("block", "with").alias("part_b"),
    )
    met = (
        meeting.join(keyed.drop("label"), "vec_id")
        .repartition("bucket", "part_a", "part_b")
        .sortWithinPartitions("bucket", "part_a", "part_b", "vec_id")
        .mapInArrow(_meet(least, visits), "vec_id bigint, links bigint, least bigint")
    )
    found = written(met, "met")
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "first")
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    per_first = (
        firsts.drop("vector")
        .join(sums, "first", "left")
        .join(roots.withColumnRenamed("id", "first"), "first", "left")
        .select(
            F.col("label").alias("of_label"),
            F.col("d1").alias("of_d1"),
            F.col("d2").alias("of_d2"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "first").alias("component_id"),
        )
    )
    everyone = marked.drop("vector").join(
        per_first,
        F.col("usable") & (F.col("label") == F.col("of_label"))
        & (F.col("d1") == F.col("of_d1")) & (F.col("d2") == F.col("of_d2")),
        "left",
    )
    component = F.coalesce("component_id", "vec_id")
    return everyone.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
