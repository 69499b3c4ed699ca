"""Best records of a block of questions by sparse counts, without pairs as rows.

A question has few words, so its products with many records are a few rows of counts
added up, whatever the number of places. The counts lie place by place, several in one
64-bit number: the product of two vectors is no more than that of their lengths, so
where this fits no sum runs into the next. Records of like length stand together, and
one whole number then tells which products can matter at all; only these get a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Records whose counts lie side by side.
SIDE_BY_SIDE = 8192
STRETCH = 256
# Questions that go through a block at once.
AT_ONCE = 4096
# Words of a question that are added up one by one; longer ones are better multiplied.
MOST_WORDS = 384
# Products that may matter, held before they are ranked.
HELD = 2_000_000
WIDTHS = [np.dtype(name) for name in ("u1", "u2", "u4", "u8")]


class Counts:
    """Sparse vectors as rows of places and counts.

    `whole` tells which hold whole numbers from zero up; a missing vector is all zeros.
    """

    def __init__(self, vectors: pa.Array | pa.ChunkedArray, dim: int):
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        self.dim, n = dim, len(vectors)
        indices, values = vectors.field("indices"), vectors.field("values")
        missing = np.asarray(vectors.is_null().to_numpy(zero_copy_only=False))
        sizes = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        same = np.array_equal(sizes, values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        places, counts = indices.flatten(), values.flatten()
        self.places = places.fill_null(-1).to_numpy(zero_copy_only=False)
        self.counts = counts.fill_null(-1).to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        kinds = pa.types.is_integer(places.type) and pa.types.is_integer(counts.type)
        if not (same and kinds) or sizes[missing].any():
            self.whole, self.lengths = np.zeros(n, bool), np.zeros(n)
            return
        odd = (self.counts < 0) | (self.places < 0) | (self.places >= dim)
        self.whole = self._sums(odd, np.int64) == 0
        self.lengths = np.sqrt(self._sums(np.square(self.counts, dtype=np.float64), np.float64))

    def __len__(self) -> int:
        return len(self.lengths)

    def _sums(self, values: np.ndarray, kind: type) -> np.ndarray:
        """Values of the places added up for each row."""
        sums = np.zeros(len(self.starts) - 1, kind)
        filled = np.diff(self.starts) > 0
        if filled.any():
            sums[filled] = np.add.reduceat(values, self.starts[:-1][filled], dtype=kind)
        return sums

    def short(self) -> np.ndarray:
        """Which rows are whole, have few words and name each place once."""
        rows = np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.starts))
        found = self.whole & (self._sums(self.counts, np.int64) <= MOST_WORDS)
        # A place that is there twice holds its last count; added up, it would hold both.
        rows, places = rows[found[rows]], self.places[found[rows]]
        order = np.lexsort((places, rows))
        rows, places = rows[order], places[order]
        del order
        found[rows[1:][(rows[1:] == rows[:-1]) & (places[1:] == places[:-1])]] = False
        return found

    def of(self, which: np.ndarray) -> Counts:
        """Some of the rows, by number or as told by a mask."""
        rows = np.flatnonzero(which) if which.dtype == bool else which
        some = Counts.__new__(Counts)
        sizes = self.starts[rows + 1] - self.starts[rows]
        some.starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[rows] - some.starts[:-1], sizes)
        at += np.arange(some.starts[-1])
        some.dim, some.places, some.counts = self.dim, self.places[at], self.counts[at]
        some.whole, some.lengths = self.whole[rows], self.lengths[rows]
        return some

    def vectors(self) -> pa.Array:
        """The rows as sparse vectors."""
        lists = [pa.ListArray.from_arrays(self.starts.astype(np.int32), pa.array(x)) for x in (self.places, self.counts)]
        return pa.StructArray.from_arrays(lists, ["indices", "values"])

    def by_place(self, width: np.dtype, room: int) -> np.ndarray:
        """Counts of the rows side by side for every place, packed in 64-bit numbers."""
        table = np.zeros((self.dim, room), width)
        table[self.places, np.repeat(np.arange(len(self)), np.diff(self.starts))] = self.counts
        return table.view(np.uint64)


class _Ranking:
    """Best k records of every question so far, ties by the record's place in the order of ids."""

    def __init__(self, k: int, n_questions: int):
        self.k = k
        self.scores = np.full((n_questions, k), -np.inf)
        self.ranks = np.zeros((n_questions, k), np.int64)

    def floor(self, questions: np.ndarray) -> np.ndarray:
        """What a record must score to be among the best; 0 while there are fewer than k."""
        return np.maximum(self.scores[questions, -1], 0.0)

    def add(self, question: np.ndarray, rank: np.ndarray, scores: np.ndarray) -> None:
        """Only the questions that get something are ranked anew, whatever the others hold."""
        kept = scores >= self.floor(question)
        touched = np.unique(question[kept])
        held = np.isfinite(self.scores[touched])
        question = np.concatenate([np.repeat(touched, held.sum(axis=1)), question[kept]])
        rank = np.concatenate([self.ranks[touched][held], rank[kept]])
        scores = np.concatenate([self.scores[touched][held], scores[kept]])
        order = np.lexsort((rank, -scores, question))
        question = question[order]
        nth = np.arange(len(question)) - np.searchsorted(question, question)
        best = nth < self.k
        place = question[best], nth[best]
        self.ranks[place], self.scores[place] = rank[order][best], scores[order][best]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of questions, ranks and scores, from the best to the least of each question."""
        held = np.isfinite(self.scores)
        return np.nonzero(held)[0], self.ranks[held], self.scores[held]


def best_by_counts(
    records: Counts, questions: Counts, k: int, by_id: np.ndarray, cosine: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k records of every question: numbers of questions and records, and scores.

    A score is similarity + 1 to six places, ties go by `by_id`, the records in order of
    their ids. Questions must have few words (`Counts.short`).
    """
    rank_of = np.empty(len(records), np.int64)
    rank_of[by_id] = np.arange(len(records))
    search = CountSearch(questions, k, cosine)
    search.offer(records, rank_of)
    question, rank, scores = search.best()
    return question, by_id[rank], scores


class CountSearch:
    """Best k records of every question among those offered, some at a time.

    What is held is that of the questions, whatever the number of records. Questions must
    have few words (`Counts.short`).
    """

    def __init__(self, questions: Counts, k: int, cosine: bool):
        self.questions, self.k, self.cosine = questions, k, cosine
        self.ranking = _Ranking(k, len(questions))
        self.divisors = self._divisors(questions)
        self.words = np.repeat(questions.places.astype(np.intp), questions.counts)
        upto = np.concatenate([[0], np.cumsum(questions.counts, dtype=np.int64)])
        self.starts = upto[questions.starts]

    def _divisors(self, vectors: Counts) -> np.ndarray:
        return np.where(vectors.lengths > 0, vectors.lengths, 1.0) if self.cosine else np.ones(len(vectors))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of questions, ranks of records and scores."""
        return self.ranking.best()

    def offer(self, records: Counts, ranks: np.ndarray) -> None:
        """Rank more records; `ranks` tells the place of each in the order of all ids."""
        if len(records) == 0 or len(self.questions) == 0:
            return
        self._offer_strangers(records, ranks)
        by_length = np.argsort(records.lengths, kind="stable")
        blocks = np.array_split(by_length, -(-len(records) // SIDE_BY_SIDE))
        # Records of middle length are the nearest to most questions and set the bar for the others.
        blocks.sort(key=lambda rows: abs(records.lengths[rows[0]] - np.median(records.lengths)))
        for rows in blocks:
            self._rank_block(records.of(rows), ranks[rows], self._divisors(records)[rows])

    def _offer_strangers(self, records: Counts, ranks: np.ndarray) -> None:
        """Records that share no word with a question: of these the first k by id are enough.

        No score is below 1, so one that is further back has k others before it.
        """
        first = np.argsort(ranks, kind="stable")[: self.k]
        vectors = records.of(first)
        has = np.zeros((vectors.dim, len(first)), bool)
        there = vectors.counts > 0
        has[vectors.places[there], np.repeat(np.arange(len(first)), np.diff(vectors.starts))[there]] = True
        everyone = np.arange(len(self.questions))
        low = everyone[self.ranking.floor(everyone) <= 1.0]
        for at in range(0, len(low), AT_ONCE):
            some = low[at : at + AT_ONCE]
            asked = self.questions.of(some)
            rows = np.repeat(np.arange(len(some)), np.diff(asked.starts))
            shared = np.zeros((len(some), len(first)), bool)
            for i in range(len(first)):
                shared[rows[has[asked.places, i] & (asked.counts > 0)], i] = True
            question, record = np.nonzero(~shared)
            self.ranking.add(some[question], ranks[first[record]], np.ones(len(question)))

    def _rank_block(self, block: Counts, ranks: np.ndarray, by_record: np.ndarray) -> None:
        """Rank the records of a block that share a word with a question."""
        # Stretches of like length, each with its own least product.
        room = -(-len(block) // STRETCH) * STRETCH
        shortest = np.minimum.reduceat(by_record, np.arange(0, len(block), STRETCH))
        most = self._most(block)
        for width, questions in _by_width(most):
            table = block.by_place(width, room)
            held = np.empty((MOST_WORDS, table.shape[1]), np.uint64)
            for at in range(0, len(questions), AT_ONCE):
                some = questions[at : at + AT_ONCE]
                # A score that lacks half a millionth is still rounded up to the floor.
                bars = (self.ranking.floor(some) - 1.0 - 1e-6) * self.divisors[some] * (1 - 1e-9)
                bars = np.maximum(np.ceil(np.outer(bars, shortest)), 1)
                can = bars.min(axis=1) <= most[some]
                some, bars = some[can], bars[can]
                bars = np.minimum(bars, float(2**63) if width.itemsize == 8 else np.iinfo(width).max)
                self._rank_some(some, bars.astype(width), table, held, ranks, by_record)

    def _rank_some(self, some, bars, table, held, ranks, by_record) -> None:
        words, width, stretches = self.words, bars.dtype, bars.shape[1]
        found: list = []
        waiting = 0
        spans = zip(some.tolist(), self.starts[some].tolist(), self.starts[some + 1].tolist(), bars[:, :, None])
        for q, lo, hi, bar in spans:
            counts = table.take(words[lo:hi], 0, held[: hi - lo], "clip")
            products = np.add.reduce(counts, 0).view(width)
            near = (products.reshape(stretches, STRETCH) >= bar).ravel().nonzero()[0]
            if len(near) == 0:
                continue
            products = products[near]
            if len(near) > 4 * self.k:
                best = self._narrowed(q, products, by_record[near], ranks[near])
                near, products = near[best], products[best]
            found.append((q, near, products))
            waiting += len(near)
            if waiting > HELD:
                self._settle(found, ranks, by_record)
                waiting = 0
        self._settle(found, ranks, by_record)

    def _settle(self, found: list, ranks: np.ndarray, by_record: np.ndarray) -> None:
        if found:
            numbers, near, products = zip(*found)
            question = np.repeat(numbers, [len(some) for some in near])
            near = np.concatenate(near)
            scores = _rounded(np.concatenate(products) / (self.divisors[question] * by_record[near]))
            self.ranking.add(question, ranks[near], scores)
            found.clear()

    def _narrowed(self, q: int, products: np.ndarray, by_record: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Which of them are the best k; equal ones at the end by id."""
        scores = _rounded(products / (self.divisors[q] * by_record))
        over = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
        return over[np.lexsort((ranks[over], -scores[over]))[: self.k]]

    def _most(self, block: Counts) -> np.ndarray:
        """No product of a question with a record of the block is above this.

        That is the product of the lengths, or the question's words where each is met as
        often as any record has it.
        """
        often = np.zeros(block.dim, np.int64)
        np.maximum.at(often, block.places, block.counts)
        by_length = self.questions.lengths * block.lengths.max(initial=0.0) + 1
        most = np.zeros(len(self.questions))
        for at in range(0, len(most), AT_ONCE):
            starts = self.starts[at : at + AT_ONCE + 1]
            upto = np.concatenate([[0], np.cumsum(often[self.words[starts[0] : starts[-1]]])])
            most[at : at + AT_ONCE] = np.diff(upto[starts - starts[0]])
        return np.minimum(most, by_length)


def _by_width(most: np.ndarray):
    """Questions that meet a word at all, by the least width that holds their products with a block."""
    least = 1.0
    for width in WIDTHS:
        over = np.inf if width.itemsize == 8 else float(np.iinfo(width).max)
        questions = np.flatnonzero((most >= least) & (most < over))
        if len(questions):
            yield width, questions
        least = over


def _rounded(similarity: np.ndarray) -> np.ndarray:
    return np.floor((similarity + 1.0) * 1e6 + 0.5) / 1e6
