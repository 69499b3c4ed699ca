"""Language of a text by a recurrent network over its bytes.

Two gated recurrent layers of a few cells read the bytes, one forwards, one backwards;
from both states every position gets a probability for each language, and a document's
probability is the mean over all its positions. Texts are cut into stretches of fixed
length that are read side by side, each with some bytes of its surroundings to warm up
on, so a text of any length is read whole at even cost. Gates and states use piecewise
linear curves. Weights are learnt in numpy by backpropagation through time.

Only the bytes of a text go into its prediction. A text that is null or has no letter is
`und` with score 0; so is every text if nothing could be learnt because no row has a
language. Rows are judged one by one: repeated rows get equal results, an empty table
none, other columns stay, and columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.arrays import row_groups, text_bytes
from pagewarden.llm.batches import bound_batches
from pagewarden.llm.names import others, own

# Cells of each direction for up to this many languages; every further two add one and a half.
CELLS = 5
FEW = 4
# A stretch owns this many bytes and reads so many more on both sides.
STRETCH = 192
WARM_UP = 8
# Bytes that are read side by side.
GROUP_BYTES = 1 << 19
UNKNOWN = "und"
# Stands for bytes before and behind a text.
OUTSIDE = 256
# The classifier learns from at most this many documents, and so many bytes of each.
SAMPLE_DOCUMENTS = 2400
SAMPLE_BYTES = 384
EPOCHS = 4
_LETTER = regex.compile(r"\p{L}")


class Layer:
    """One direction: states from bytes. Arrays are cells by stretches."""

    def __init__(self, rng: np.random.Generator, cells: int):
        h = cells
        self.cells = h
        # Rows: update gate, reset gate, candidate.
        self.embed = rng.normal(0, 0.3, (257, 3 * h)).astype(np.float32)
        self.embed[:, : 2 * h] *= 0.5
        # Outside a text the update gate is shut and the state stays as it is.
        self.embed[OUTSIDE, :h] = -1e4
        self.gate = rng.normal(0, 0.5 / np.sqrt(h), (2 * h, h)).astype(np.float32)
        self.cand = rng.normal(0, 1 / np.sqrt(h), (h, h)).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.gate, self.cand]

    def run(self, data: np.ndarray, keep: bool = False):
        """States (steps, cells, stretches) of bytes (steps, stretches)."""
        steps, n = data.shape
        h, size = np.zeros((self.cells, n), np.float32), self.cells
        states = np.empty((steps, size, n), np.float32)
        kept = []
        # Gates are clip(x / 4 + 1 / 2, 0, 1); quarter and half go into the weights.
        embed, gate = self.embed.copy(), self.gate * np.float32(0.25)
        embed[:, : 2 * size] *= 0.25
        embed[:, : 2 * size] += 0.5
        gates, cand = np.empty((2 * size, n), np.float32), np.empty((size, n), np.float32)
        for t in range(steps):
            inputs = np.take(embed, data[t], axis=0).T
            np.matmul(gate, h, out=gates)
            gates += inputs[: 2 * size]
            np.clip(gates, 0, 1, out=gates)
            damped = gates[size:] * h
            np.matmul(self.cand, damped, out=cand)
            cand += inputs[2 * size :]
            np.clip(cand, -1, 1, out=cand)
            if keep:
                kept.append((h, gates.copy(), damped, cand.copy()))
            change = cand - h
            change *= gates[:size]
            h = np.add(h, change, out=states[t])
        return states, kept

    def back(self, data: np.ndarray, kept: list, above: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights from those of the states."""
        size = self.cells
        grads = [np.zeros_like(w) for w in self.weights()]
        carry = np.zeros_like(above[0])
        inputs = np.empty((data.shape[1], 3 * size), np.float32)
        for t in range(len(data) - 1, -1, -1):
            h, gates, damped, cand = kept[t]
            z, r = gates[:size], gates[size:]
            total = above[t] + carry
            d_cand = total * z * (np.abs(cand) < 1)
            d_z = total * (cand - h) * 0.25 * ((z > 0) & (z < 1))
            d_damped = self.cand.T @ d_cand
            d_r = d_damped * h * 0.25 * ((r > 0) & (r < 1))
            d_gates = np.concatenate((d_z, d_r))
            carry = total * (1 - z) + d_damped * r + self.gate.T @ d_gates
            grads[1] += d_gates @ h.T
            grads[2] += d_cand @ damped.T
            inputs[:, : 2 * size], inputs[:, 2 * size :] = d_gates.T, d_cand.T
            np.add.at(grads[0], data[t], inputs)
        return grads


class Network:
    """Both directions and the labels of positions."""

    def __init__(self, languages: list[str], cells: int = CELLS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.hence = Layer(rng, cells), Layer(rng, cells)
        self.out = rng.normal(0, 0.3, (len(languages), 2 * cells)).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.forth.weights(), *self.hence.weights(), self.out, self.bias]

    def pooled(self, data: np.ndarray, owned: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of the owned positions: (languages, stretches)."""
        forth = self.forth.run(data)[0]
        hence = self.hence.run(data[::-1])[0][::-1]
        p = self._odds(forth, hence)
        p *= (owned / p.sum(axis=1))[:, None]
        return p.sum(axis=0, dtype=np.float64)

    def _odds(self, forth: np.ndarray, hence: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, stretches) but for the division by their sum."""
        size = self.forth.cells
        p = np.matmul(self.out[:, :size], forth)
        p += np.matmul(self.out[:, size:], hence)
        p += self.bias
        # States are at most 1, so the exponents are bounded by the weights.
        return np.exp(p, out=p)

    def learn(self, data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over all positions within texts."""
        n = data.shape[1]
        forth, kept_f = self.forth.run(data, keep=True)
        hence, kept_h = self.hence.run(data[::-1], keep=True)
        hence = hence[::-1]
        p = self._odds(forth, hence)
        p /= p.sum(axis=1, keepdims=True)
        p[:, label, np.arange(n)] -= 1
        owned = data != OUTSIDE
        p *= (owned / np.float32(owned.sum()))[:, None]
        both = np.concatenate((forth, hence), axis=1)
        d_out = np.einsum("tln,tcn->lc", p, both, optimize=True)
        d_both = np.matmul(self.out.T, p)
        size = self.forth.cells
        g_f = self.forth.back(data, kept_f, d_both[:, :size])
        g_h = self.hence.back(data[::-1], kept_h, d_both[::-1, size:])
        return [*g_f, *g_h, d_out, p.sum(axis=(0, 2))[:, None]]


def train(
    texts: list[str], languages: list[str], epochs: int = EPOCHS, cells: int | None = None, seed: int = 0
) -> Network | None:
    """A network for the languages that occur; none if there are no texts."""
    names = sorted(set(languages))
    if not names:
        return None
    network = Network(names, cells or CELLS + max(0, len(names) - FEW) * 3 // 4, seed)
    steps = 64
    rows, labels = [], []
    for text, language in zip(texts, languages):
        data = np.frombuffer(text.encode(), np.uint8)
        for at in range(0, len(data), steps):
            # Short texts and tails are filled up; the filling has no part in the loss.
            row = np.full(steps, OUTSIDE, np.intp)
            row[: len(data) - at] = data[at : at + steps]
            rows.append(row)
            labels.append(names.index(language))
    if not rows:
        return None
    data, label = np.array(rows).T, np.array(labels)
    weights = network.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rng, step, size = np.random.default_rng(seed + 1), 0, 128
    # Languages weigh alike, however many texts they have.
    share = np.maximum(np.bincount(label, minlength=len(names)), 1)
    odds = (1 / share)[label]
    odds /= odds.sum()
    rounds = max(60, epochs * len(label) // size)
    for at in range(rounds):
        picked = rng.choice(len(label), size, p=odds)
        rate = 0.02 * (1 - at / rounds) + 0.001
        step += 1
        for w, g, m, v in zip(weights, network.learn(data[:, picked], label[picked]), first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return network


def _predict_rows(network: Network, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities of every row; rows without bytes are zero."""
    sizes = np.diff(offsets)
    sums = np.zeros((len(sizes), len(network.languages)))
    # Stretches of all rows, in order.
    count = -(-sizes // STRETCH)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lo = offsets[:-1][row] + nth * STRETCH
    hi = np.minimum(lo + STRETCH, offsets[1:][row])
    # Stretches of like length stand side by side.
    order = np.argsort(hi - lo, kind="stable")
    for a, b in row_groups(np.full(len(order), STRETCH), GROUP_BYTES):
        which = order[a:b]
        longest = int((hi[which] - lo[which]).max())
        steps = np.arange(-WARM_UP, longest + WARM_UP)
        at = lo[which][None, :] + steps[:, None]
        inside = (at >= offsets[:-1][row[which]]) & (at < offsets[1:][row[which]])
        data = buf[np.clip(at, 0, len(buf) - 1)].astype(np.intp)
        data[~inside] = OUTSIDE
        owned = ((steps[:, None] >= 0) & (at < hi[which])).astype(np.float32)
        for k, total in enumerate(network.pooled(data, owned)):
            sums[:, k] += np.bincount(row[which], weights=total, minlength=len(sizes))
    return sums / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """All rows and columns with lang_pred and score, the probability of that language."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learnt = sent.value
        for batch in batches:
            has_letter = np.array([bool(_LETTER.search(t.as_py() or "")) for t in batch], bool)
            names = np.full(len(batch), UNKNOWN, object)
            score = np.zeros(len(batch))
            if learnt is not None and len(batch):
                means = _predict_rows(learnt, *text_bytes(batch))
                best = means.argmax(axis=1)
                names[has_letter] = np.array(learnt.languages, object)[best[has_letter]]
                score[has_letter] = means.max(axis=1)[has_letter]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["lang_pred", "score"]
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, "struct<lang_pred:string,score:double>")
    (name,) = own(docs, "found")
    return docs.withColumn(name, found(F.col(text))).select(
        *others(docs, "lang_pred", "score"), f"{name}.lang_pred", f"{name}.score"
    )


def held_out(doc_id: str):
    """Whether a document is kept from learning, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def sample(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    documents: int = SAMPLE_DOCUMENTS,
    most_bytes: int = SAMPLE_BYTES,
) -> list[tuple[str, str]]:
    """(text, language) of a bounded number of documents, alike many of each language.

    Which ones is decided by a hash of the id, so a rerun learns from the same.
    """
    labelled = docs.where(
        F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & F.col(doc_id).isNotNull() & ~held_out(doc_id)
    ).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return []
    each = max(1, documents // len(sizes))
    rates = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 1.2 * each / n))])
    chance = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # A stretch from within the text, so that a shared first line teaches nothing twice.
    size = F.length("text")
    start = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.greatest(size - most_bytes, F.lit(1))) + 1
    rows = (
        labelled.where(chance < rates[F.col("lang")])
        .select("lang", F.substring("text", start.cast("int"), F.lit(most_bytes)).alias("text"), "doc_id")
        .collect()
    )
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"]))]


def learn(docs: DataFrame, **how) -> Network | None:
    """A network from the documents that are not held out."""
    rows = sample(docs, **how)
    return train([t for t, _ in rows], [name for _, name in rows])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows and columns with held_out, lang_pred and score."""
    network = learn(docs, doc_id=doc_id, text=text, lang=lang)
    return predict(docs.withColumn("held_out", held_out(doc_id)), network, text)
