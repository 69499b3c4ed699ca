"""Variants of spelling: words that one inserted, deleted or replaced letter parts.

A word is a point: how often it has each letter. One inserted or deleted letter moves a
point by one step along one letter, one replaced letter by a step down and a step up (an
L1 distance of two). So the words near another one lie in a small box walk around it: for
words of the same length one step up and one down, for words one letter longer one step
up. K-d trees over the points, one for each length, find these. The upper part of a tree
is made on the driver from a bounded sample and parts all words into cells; a word visits
the cells its steps may reach. A cell's words, in blocks of bounded size, get the lower
part of the tree in the task they land in, and visitors walk down it, pruned by the boxes.
What remains is compared letter by letter, so only true neighbours come out.

Letters are code points of `[A-Za-z\\u00C0-\\u00FF]`. A null text has no words; a null id
counts as empty text before the colon. Repeated rows count again, other columns play no
part, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.batches import bound_batches
from pagewarden.llm.links import stored, written
from pagewarden.session import drop_path

# Runs after `bytes.lower`, which changes A to Z alone.
LETTERS = "[a-z\u00C0-\u00FF]"
# Words with their counts that a task holds before it hands them on.
HELD_WORDS = 1 << 18
# The runs of longer texts are counted some at a time.
LIST_CHARS = 1 << 22
LEAST_CHARS = 5
LEAST_TIMES = 3
TYPO_RATE = 97
# The cells of all lengths are made from about this many words at most.
SAMPLE_WORDS = 1 << 16
# Code points of the words that a block of a cell holds, about.
BLOCK_CHARS = 1 << 17
# Words in a leaf of the lower trees.
LEAF = 96
# Multiplications in one product of visitors and a leaf.
PRODUCT = 1 << 18
# Letters as columns: a to z, then the letters from U+00C0.
N_LETTERS = 26 + 64
_COLUMN = np.full(256, -1)
_COLUMN[ord("a") : ord("z") + 1] = np.arange(26)
_COLUMN[0xC0:] = np.arange(26, N_LETTERS)
# By how many letters the visited words are longer, and so how many steps up and down they lie away.
STEPS = ((0, 1, 1), (1, 1, 0))


def _counter(least_chars: int, typo_rate: int):
    """Words and their counts, added up within tasks, from ids and texts."""
    # A shorter run makes no word, with or without a typing error.
    pattern = re.compile(f"{LETTERS}{{{least_chars},}}")

    def runs_of(text: str) -> Iterator[list[str]]:
        lower = text.encode().lower().decode()
        if len(lower) <= LIST_CHARS:
            yield pattern.findall(lower)
            return
        found = (match[0] for match in pattern.finditer(lower))
        while runs := list(islice(found, LIST_CHARS // least_chars)):
            yield runs

    def out(counts: Counter) -> pa.RecordBatch:
        kept = {word: n for word, n in counts.items() if n and len(word) >= least_chars}
        return pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                begin = crc32(f"{doc_id.as_py()}:".encode())
                for runs in runs_of(text.as_py() or ""):
                    counts.update(runs)
                    # The same run of the same document always loses the same letter.
                    typos = {r for r in set(runs) if not crc32(r.encode(), begin) % typo_rate}
                    for word, times in Counter(filter(typos.__contains__, runs) if typos else ()).items():
                        at = crc32(word.encode(), begin) % len(word)
                        counts[word] -= times
                        counts[word[:at] + word[at + 1 :]] += times
                if len(counts) >= HELD_WORDS:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return run


def counted_words(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_times: int = LEAST_TIMES,
    typo_rate: int = TYPO_RATE,
) -> DataFrame:
    """(word, n) of the words that occur often enough, with the letters that typing errors drop."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counter(least_chars, typo_rate), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


class Matrix(NamedTuple):
    """Words of one length: their code points, and how often each has each letter."""

    codes: np.ndarray
    counts: np.ndarray


def matrix(words: list[str], length: int) -> Matrix:
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
    cells = np.arange(len(words))[:, None] * N_LETTERS + _COLUMN[codes]
    counts = np.bincount(cells.ravel(), minlength=len(words) * N_LETTERS)
    return Matrix(codes, counts.reshape(len(words), N_LETTERS).astype(np.int32))


class Split(NamedTuple):
    """A node of a tree: points with at most `most` of a letter go left. A leaf has no letter."""

    letter: int
    most: int
    left: int
    right: int
    # The points of a leaf, from and to, in the order of the tree.
    lo: int
    hi: int


def grow(counts: np.ndarray, leaf: int) -> tuple[list[Split], np.ndarray]:
    """Nodes, the root first, and the order of the points in which every leaf is a range."""
    nodes: list[Split | None] = [None]
    order = np.arange(len(counts))
    waiting = [(0, 0, len(counts))]
    while waiting:
        at, lo, hi = waiting.pop()
        some = counts[order[lo:hi]]
        spread = np.abs(some - some.mean(axis=0)).sum(axis=0) if hi - lo > leaf else np.zeros(1)
        letter = int(spread.argmax())
        if spread[letter] == 0:
            nodes[at] = Split(-1, 0, -1, -1, lo, hi)
            continue
        column = some[:, letter]
        # As near to the median as parts the points at all.
        most = min(int(np.median(column)), int(column.max()) - 1)
        right = column > most
        order[lo:hi] = order[lo:hi][np.argsort(right, kind="stable")]
        middle = hi - int(right.sum())
        nodes[at] = Split(letter, most, len(nodes), len(nodes) + 1, lo, hi)
        nodes += [None, None]
        waiting += [(nodes[at].left, lo, middle), (nodes[at].right, middle, hi)]
    return nodes, order


def visit(nodes: list[Split], counts: np.ndarray, up: int, down: int) -> Iterator[tuple[Split, int, np.ndarray]]:
    """Leaves, their numbers, and which points reach their boxes by so many steps up and down."""
    columns = np.ascontiguousarray(counts.T)
    # How far a point lies outside of a box, by letter, changes only where the box is cut.
    free = np.iinfo(np.int32).max
    waiting = [(0, np.arange(len(counts)), np.zeros((2, len(counts)), np.int32), {})]
    while waiting:
        at, points, away, box = waiting.pop()
        if not len(points):
            continue
        node = nodes[at]
        if node.letter < 0:
            yield node, at, points
            continue
        low, high = box.get(node.letter, (0, free))
        have = columns[node.letter][points]
        for child, bounds in ((node.left, (low, node.most)), (node.right, (node.most + 1, high))):
            further = away.copy()
            further[0] += np.maximum(bounds[0] - have, 0) - np.maximum(low - have, 0)
            further[1] += np.maximum(have - bounds[1], 0) - np.maximum(have - high, 0)
            near = (further[0] <= up) & (further[1] <= down)
            waiting.append((child, points[near], further[:, near], box | {node.letter: bounds}))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row by row b is a with one code point replaced, or one more."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    # As many equal ones from the front and from the back as the shorter word has.
    front = np.logical_and.accumulate(a == b[:, :length], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= length


class Cells:
    """The upper trees, by length of the words."""

    def __init__(self, words: list[str], rate: float, block_chars: int = BLOCK_CHARS):
        self.trees: dict[int, list[Split]] = {}
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for length, some in by_length.items():
            # As many of the sample as a block would hold of all.
            leaf = max(2, int(block_chars / length * rate))
            self.trees[length] = grow(matrix(some, length).counts, leaf)[0]

    def homes(self, words: list[str], length: int) -> np.ndarray:
        """The cell of each word, all of one length."""
        out = np.zeros(len(words), np.int64)
        tree = self.trees.get(length)
        if tree:
            for _, at, points in visit(tree, matrix(words, length).counts, 0, 0):
                out[points] = at
        return out

    def visits(self, words: list[str], length: int, homes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(word, longer by, cell) of the cells whose words may be near each word.

        Of two cells of one length the words of the lesser visit the greater.
        """
        counts = matrix(words, length).counts
        found = []
        for more, up, down in STEPS:
            tree = self.trees.get(length + more)
            reached = visit(tree, counts, up, down) if tree else [(None, 0, np.arange(len(words)))]
            for _, at, points in reached:
                if not more:
                    points = points[homes[points] <= at]
                found.append((points, np.full(len(points), more), np.full(len(points), at)))
        return tuple(np.concatenate(column) for column in zip(*found))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        # Bounded by code points, for a word may be very long.
        step = max(1, BLOCK_CHARS // length)
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            yield length, some, [words[i] for i in some.tolist()]


def _placed(cells: Cells):
    """The home of every word, and (longer by, cell) of its visits."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words = batch.to_pylist()
            home = np.zeros(len(words), np.int64)
            found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
            for length, at, some in _by_length(words):
                home[at] = cells.homes(some, length)
                points, more, cell = cells.visits(some, length, home[at])
                found.append((at[points], more, cell))
            row, more, cell = (np.concatenate(column) for column in zip(*found))
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(words) + 1))
            visits = pa.StructArray.from_arrays(
                [pa.array(more[order], pa.int32()), pa.array(cell[order], pa.int64())], ["longer", "cell"]
            )
            visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), visits)
            yield pa.StructArray.from_arrays([pa.array(home), visits], ["home", "visits"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<home:bigint,visits:array<struct<longer:int,cell:bigint>>>")


class Block:
    """Words of one cell, all of one length, under a tree of their own."""

    def __init__(self, words: list[str], times: np.ndarray, length: int):
        points = matrix(words, length)
        self.tree, order = grow(points.counts, LEAF)
        self.words = [words[i] for i in order.tolist()]
        self.times, self.length = times[order], length
        self.codes = points.codes[order]
        # Letters that no word of the block has add nothing to a product.
        self.used = np.flatnonzero(points.counts.any(axis=0))
        counts = points.counts[order][:, self.used].astype(np.float32)
        self.counts, self.half = counts, np.einsum("ij,ij->i", counts, counts) / 2

    def near(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of visitors and words of the block that one edit parts."""
        own = matrix(words, length)
        up, down = next((u, d) for more, u, d in STEPS if length + more == self.length)
        half = np.einsum("ij,ij->i", own.counts, own.counts).astype(np.float32) / 2 - (up + down) / 2
        counts = own.counts[:, self.used].astype(np.float32)
        pairs = []
        for leaf, _, points in visit(self.tree, own.counts, up, down):
            mine, half_mine = self.counts[leaf.lo : leaf.hi].T, self.half[leaf.lo : leaf.hi]
            # Products this small are left to one thread.
            step = max(1, PRODUCT // mine.size)
            for lo in range(0, len(points), step):
                some = points[lo : lo + step]
                # Lengths tell how many more steps go up than down, so the squared distance tells both.
                product = counts[some] @ mine
                product -= half_mine
                one, two = np.nonzero(product == half[some][:, None])
                if len(one):
                    one, two = some[one], two + leaf.lo
                    fit = one_edit(own.codes[one], self.codes[two])
                    pairs.append((one[fit], two[fit]))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(side) for side in zip(*pairs))


_links = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by block, a block's own words before its visitors."""
    key, own_words, own_times, block = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch[name].to_pylist() for name in ("length", "cell", "block"))))
        visiting, stranger = (batch[name].to_numpy(zero_copy_only=False) for name in ("visitor", "stranger"))
        words, times = batch["word"].to_pylist(), batch["n"].to_numpy()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if keys[lo] != key:
                key, own_words, own_times, block = keys[lo], [], [], None
            middle = lo + int((~visiting[lo:hi]).sum())
            own_words += words[lo:middle]
            own_times.append(times[lo:middle])
            if middle == hi or not own_words:
                continue
            if block is None:
                block = Block(own_words, np.concatenate(own_times), key[0])
            for length, at, some in _by_length(words[middle:hi]):
                one, two = block.near(some, length)
                theirs = times[middle:hi][at]
                # Words of one cell meet from both sides, others from one only.
                back = stranger[middle:hi][at][one]
                out = [
                    [some[i] for i in one.tolist()] + [block.words[i] for i in two[back].tolist()],
                    [block.words[i] for i in two.tolist()] + [some[i] for i in one[back].tolist()],
                    np.concatenate((block.times[two], theirs[one[back]])),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _links.types)], schema=_links)


def neighbours(words: DataFrame, sample: int = SAMPLE_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, near, near_n): every pair of near words from both sides, once."""
    spark = words.sparkSession
    bound_batches(spark)
    total = words.count()
    rate = min(1.0, sample / total) if total else 1.0
    bound = (1 << 32) * rate
    # By a hash, so a bounded number on average and the same in every run.
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < bound).select("word")
    cells = Cells([r["word"] for r in picked.collect()], rate, block_chars)
    placed = written(
        words.select("word", "n", F.length("word").alias("length"), _placed(cells)(F.col("word")).alias("at")),
        "placed-words",
    )
    sizes = placed.groupBy("length", F.col("at.home").alias("cell")).agg(
        F.ceil(F.count(F.lit(1)) * F.col("length") / block_chars).alias("blocks")
    )
    no, yes = F.lit(False), F.lit(True)
    own = placed.select("length", F.col("at.home").alias("cell"), no.alias("visitor"), no.alias("stranger"), "word", "n")
    visits = placed.select("length", "word", "n", "at.home", F.explode("at.visits").alias("to")).select(
        (F.col("length") + F.col("to.longer")).alias("length"),
        "to.cell",
        yes.alias("visitor"),
        ((F.col("to.longer") > 0) | (F.col("to.cell") != F.col("home"))).alias("stranger"),
        "word",
        "n",
    )
    # A word lives in one block of its cell; a visitor looks into all of them.
    number = F.pmod(F.xxhash64("word"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    meeting = (
        own.unionByName(visits)
        .join(sizes, ["length", "cell"])
        .withColumn("block", F.explode(F.when(F.col("visitor"), every).otherwise(F.array(number))))
        .select("length", "cell", "block", "visitor", "stranger", "word", "n")
    )
    return (
        meeting.repartition("length", "cell", "block")
        .sortWithinPartitions("length", "cell", "block", "visitor", "word")
        .mapInArrow(_meet, "word string, near string, near_n bigint")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in steps that double."""
    links, path = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, then = stored(
            links.join(further, "root").select("word", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")),
            "forms",
        )
        drop_path(links.sparkSession, path)
        links, path = after.drop("moved"), then
        if after.where("moved").isEmpty():
            return links


def variants(words: DataFrame, times: int = 2, **how: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every counted word, by its near words.

    The form is the near word of largest n (of equal ones the least) that has at least
    `times` the word's own n. So n grows along forms, and they end.
    """
    words = written(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = neighbours(words, **how).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    strong = -F.col("best.less") >= times * F.col("n")
    joined = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "variants",
    )
    return joined.join(roots(joined), "word")
