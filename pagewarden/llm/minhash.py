"""Near copies among texts by weighted signatures of hashed darts.

A document is its runs of five words, each with a weight. Every run throws darts that
depend on nothing but the run: over weight and time they fall evenly at random, and a
document owns the darts below its weight for the run. A dart also has a coordinate; of
each coordinate's darts the earliest is the document's entry there. Two documents agree
in an entry as often as their weighted Jaccard similarity says. Time runs just far
enough that about k ln k darts fall for a document of any length, so the cost is one
look at each run and a fixed number of darts, and not the product of both. A document
with an empty coordinate lets time run on.

Entries in bands make buckets. Texts with equal runs are one row first. In each bucket
all meet its least id, and each meeting is verified by exact similarity. What is linked by
then is one component; only buckets that still hold several go on, and there those
outside the component most members share meet all of other components. So no bucket
puts out the square of its size, unless its members truly are that many strangers.

A text with fewer than five words is one run of all of them. A text without words, null
or empty, is like no other and its own class; so is a row without an id (class null).
Rows that share an id are one document and share a class. Other columns play no part;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.arrays import mix, row_groups, runs, text_bytes, word_hashes
from pagewarden.llm.batches import bound_batches, by_groups
from pagewarden.llm.links import components, written

WIDTH = 5
LEAST = 0.8
# A pair at similarity 0.8 meets in at least one band but for 2 in 100,000.
BANDS = 36
ROWS = 6
# Most words worked on at a time; a word and what parts it are two bytes at least.
GROUP_WORDS = 1 << 21
# Members of a bucket that meet in one go; larger buckets become blocks.
BLOCK = 1024
# Before two strangers' runs are compared, their entries must not lie further below the
# least similarity than chance takes them once in 100,000 times.
SLACK = 4.5
SIGNATURE = "struct<d1:bigint,d2:bigint,size:bigint,entries:binary>"


def elements(hashes: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(row, run, times): the distinct runs of every row, and how often it has each."""
    row_of = np.repeat(np.arange(len(counts)), counts)
    found, at = runs(hashes, counts, width)
    rows = [row_of[at]]
    values = [found]
    for short in range(1, width):
        # Rows of exactly so many words.
        keep = counts == short
        if keep.any():
            found, at = runs(hashes[keep[row_of]], counts[keep], short)
            values.append(mix(found + np.uint64(short)))
            rows.append(np.flatnonzero(keep))
    row, value = np.concatenate(rows), np.concatenate(values)
    key = mix(value ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    times = np.diff(np.concatenate((first, [len(key)])))
    return row[order[first]], value[order[first]], times


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(row, element, weight, until, k, best, entry) -> None:
    """Darts of all rows up to a time for each row; the earliest of a coordinate stays."""
    level = 0
    live = np.arange(len(element))
    broken = bool((weight < 1).any())
    while len(live):
        # Weights from low to high are one stretch, twice as dense as the one below.
        low, dense = float(2**level - 1), float(2**level)
        live = live[weight[live] > low]
        at, time = live, np.zeros(len(live))
        seed = mix(element[at] + np.uint64(level * 0xD1B54A32D192ED03 % 2**64))
        while len(at):
            seed = mix(seed)
            time = time - np.log(_uniform(seed)) / dense
            early = time < until[row[at]]
            at, time, seed = at[early], time[early], seed[early]
            where = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            owned = slice(None)
            if level or broken:
                owned = low + dense * _uniform(mix(where)) < weight[at]
            slot = row[at][owned] * k + (where[owned] % np.uint64(k)).astype(np.int64)
            when, name = time[owned], seed[owned]
            np.minimum.at(best, slot, when)
            won = when == best[slot]
            entry[slot[won]] = name[won]
        level += 1


def signatures(
    row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int
) -> np.ndarray:
    """Entries (rows, k) of weighted sets; all of a row without elements are 0."""
    total = np.bincount(row, weights=weight, minlength=n)
    until = np.zeros(n)
    full = total > 0
    until[full] = k * (np.log(k) + 2) / total[full]
    entry = np.zeros(n * k, np.uint64)
    todo = full
    while todo.any():
        best = np.full(n * k, np.inf)
        chosen = todo[row]
        _throw(row[chosen], element[chosen], weight[chosen], until, k, best, entry)
        empty = np.isinf(best.reshape(n, k)).any(axis=1)
        todo = todo & empty
        until[todo] *= 2
    return entry.reshape(n, k)


def _worded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and counts of the rows, some rows at a time."""
    buf, offsets = text_bytes(texts)
    for lo, hi in row_groups(np.diff(offsets), 2 * GROUP_WORDS):
        yield word_hashes(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _signer(width: int, bands: int, rows: int, counted: bool):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            d1, d2, size, keys = [], [], [], []
            for hashes, counts in _worded(batch):
                n = len(counts)
                row, value, times = elements(hashes, counts, width)
                weight = times.astype(np.float64) if counted else np.ones(len(row))
                marks = mix(value + times.astype(np.uint64)) if counted else value
                for out, salt in ((d1, 3), (d2, 7)):
                    sums = np.zeros(n, np.uint64)
                    np.add.at(sums, row, mix(marks ^ np.uint64(salt)))
                    out.append(sums)
                size.append(np.bincount(row, minlength=n))
                entries = signatures(row, value, weight, n, bands * rows)
                keys += [e.tobytes() for e in entries.astype(np.uint16)]
            sizes = np.concatenate(size) if size else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(d1).view(np.int64) if d1 else [], pa.int64()),
                    pa.array(np.concatenate(d2).view(np.int64) if d2 else [], pa.int64()),
                    pa.array(sizes),
                    pa.array(keys, pa.binary()),
                ],
                ["d1", "d2", "size", "entries"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SIGNATURE)


def _alike(one: bytes, two: bytes) -> float:
    """Jaccard similarity of two sorted lists of distinct runs."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _similarity():
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([_alike(a.as_py(), b.as_py()) for a, b in zip(left, right)], pa.float64())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def _runs_of(width: int, counted: bool):
    """Distinct runs of texts, sorted; if counted, each with the number of its occurrence."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists = []
            for hashes, counts in _worded(batch):
                row, value, times = elements(hashes, counts, width)
                if counted:
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, value = np.repeat(row, times), mix(np.repeat(value, times) + nth.astype(np.uint64))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                cuts = np.searchsorted(row, np.arange(len(counts) + 1))
                lists += [value[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.array(lists, pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")


def _strangers(least: float, bands: int, rows: int):
    """Pairs of a bucket that are of different components and alike by their runs."""
    k = bands * rows
    floor = least - SLACK * np.sqrt(least * (1 - least) / k)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(table: pa.Table) -> pa.RecordBatch:
        ids, component = table["doc_id"].to_numpy(), table["component"].to_numpy()
        main, band, block = (table[n].to_numpy() for n in ("major", "band", "block"))
        entries = np.frombuffer(b"".join(table["entries"].to_pylist()), np.uint16).reshape(-1, k)
        sets = table["runs"].to_pylist()
        keys = [table[n].to_numpy() for n in ("bucket", "part_a", "part_b")]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
        found = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            apart = keys[1][lo] != keys[2][lo]
            everyone = np.arange(lo, hi)
            for x in np.flatnonzero(component[lo:hi] != main[lo]) + lo:
                fit = component[everyone] != component[x]
                fit &= (component[everyone] == main[lo]) | (ids[everyone] < ids[x])
                if apart:
                    fit &= block[everyone] != block[x]
                others = everyone[fit]
                for part in range(0, len(others), 4096):
                    y = others[part : part + 4096]
                    equal = entries[y] == entries[x]
                    close = equal.sum(axis=1) >= floor * k
                    y, equal = y[close], equal[close]
                    # A pair that meets in several bands counts in the first.
                    first = equal.reshape(len(y), bands, rows).all(axis=2).argmax(axis=1)
                    for other in y[first == band[x]]:
                        if _alike(sets[x], sets[other]) >= least:
                            found.append((min(ids[x], ids[other]), max(ids[x], ids[other])))
        left, right = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    return by_groups(pairs, ("bucket", "part_a", "part_b"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: float = LEAST,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    counted: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, class_id, kept): a class is named after its least id, which is kept.

    With `counted` a run weighs as often as the text has it; else each weighs 1 and the
    similarity is plain Jaccard.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = written(
        source.withColumn("s", _signer(width, bands, rows, counted)(F.col("text"))).select(
            "doc_id", "s.d1", "s.d2", "s.size", "s.entries"
        ),
        "signatures",
    )
    same = ["d1", "d2", "size"]
    worded = signed.where("size > 0 AND doc_id IS NOT NULL")
    # Equal runs have equal entries: only the first of them goes on.
    firsts = worded.groupBy(*same).agg(F.min("doc_id").alias("first"), F.first("entries").alias("entries"))
    leads = written(firsts, "leads")
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda band: F.xxhash64(
            band, F.call_function("substring", F.col("entries"), band * (2 * rows) + 1, F.lit(2 * rows))
        ),
    )
    spots = leads.select(F.col("first").alias("doc_id"), F.posexplode(keys).alias("band", "bucket"))
    centres = spots.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"))
    placed = written(spots.join(centres.where("centre < last").drop("last"), "bucket"), "buckets")

    # Whoever meets another, with the runs to compare: the only time texts are moved.
    involved = placed.select("doc_id").distinct()
    carried = written(
        source.join(involved, "doc_id").select("doc_id", _runs_of(width, counted)(F.col("text")).alias("runs")),
        "runs",
    )
    stars = placed.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    links = written(
        stars.distinct()
        .join(carried.select(F.col("doc_id").alias("a"), F.col("runs").alias("a_runs")), "a")
        .join(carried.select(F.col("doc_id").alias("b"), F.col("runs").alias("b_runs")), "b")
        .select("a", "b", _similarity()(F.col("a_runs"), F.col("b_runs")).alias("alike"))
        .where(F.col("alike") >= least)
        .select("a", "b"),
        "links",
    )

    # Buckets that are not one component yet: whoever is outside the one that most
    # members share meets all others.
    joined = components(links)
    named = placed.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    major = (
        named.groupBy("bucket", "component")
        .agg(F.count("doc_id").alias("members"))
        .groupBy("bucket")
        .agg(
            F.count("component").alias("several"),
            F.max_by("component", F.struct("members", "component")).alias("major"),
            F.ceil(F.sum("members") / block).alias("parts"),
        )
        .where("several > 1")
        .drop("several")
    )
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    meeting = (
        named.join(major, "bucket")
        .withColumn("block", part)
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .withColumn("part_a", F.least("block", "with"))
        .withColumn("part_b", F.greatest("block", "with"))
        .drop("with", "parts")
    )
    entries = leads.select(F.col("first").alias("doc_id"), "entries")
    alike = (
        meeting.join(carried.join(entries, "doc_id"), "doc_id")
        .repartition("bucket", "part_a", "part_b")
        .sortWithinPartitions("bucket", "part_a", "part_b")
        .mapInArrow(_strangers(least, bands, rows), "a bigint, b bigint")
    )
    links = links.unionByName(written(alike.distinct(), "more-links"))
    # Different texts of one id are one document all the same.
    repeated = worded.groupBy("doc_id").agg(F.count("size").alias("n")).where("n > 1").drop("n")
    one = worded.join(repeated, "doc_id", "left_semi").join(leads.drop("entries"), same)
    joined = components(links.unionByName(one.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))))
    class_id = F.when(F.col("size") > 0, F.coalesce("component", "first")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", *same)
        .join(leads.drop("entries"), same, "left")
        .join(joined.select(F.col("id").alias("first"), "component"), "first", "left")
        .select("doc_id", F.when(F.col("doc_id").isNotNull(), class_id).alias("class_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    )
