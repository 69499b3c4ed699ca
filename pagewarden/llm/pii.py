"""Personal data by exact patterns and a recurrent tagger with a CRF on top.

The patterns find e-mail and IP addresses, card and phone numbers as they are normally
written; what they find always stands. A character-level LSTM in both directions scores
every character for the tags of the same kinds, and a CRF has learnt which tag follows
which; it finds other ways of writing the same things, such as `name (at) host.org` or a
number without its country. All is trained in numpy on labelled spans: those the patterns
find in a bounded sample, and written-out examples and look-alikes set into its passages.

All four kinds hold a digit, an `@`, a bracketed `at` or the word `dot`, so the tagger
reads a window's width around each of these in the whole text, however many there are.
Surroundings that touch are one stretch. A stretch is read in overlapping windows; where
windows overlap their scores are averaged, each weighted by the distance to its window's
edge, and one best path is decoded through it. Stretches longer than `LONG` go in parts
that each read on beyond their borders and own the spans that start in them. A found span
is added if it is likely, well formed and touches no span of the patterns or before it.

A null or empty text has no spans. Rows are judged one by one: repeated rows get equal
results, an empty table none, other columns stay, and columns named like a result are
replaced. Without a sample the tagger learns from written-out examples alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.batches import bound_batches
from pagewarden.llm.names import others, own

KINDS = ["email", "ip", "card", "phone"]
# Outside, and first and further characters of each kind.
TAGS = 1 + 2 * len(KINDS)
CELLS = 16
WINDOW = 128
STRIDE = 64
AROUND = WINDOW // 2
LIKELY = 0.6
GROUP = 1024
# Characters of a stretch that are decoded in one go, a multiple of the stride, and of all that are scored side by side.
LONG = 8192
GROUP_CHARS = 1 << 17
# The tagger learns from at most this many passages of texts, each of so many characters.
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 600
STEPS = 260
# Texts looked at for the sample, on average, for each that is taken.
LOOKED_AT = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[\[({]\s*at\s*[\])}]|\bdot\b", re.I)
# Other ways of writing: what parts the name from the host, and the parts of a host or of an address.
_AT = r"\s*(?:@|[\[({]\s*at\s*[\])}]|\bat\b)\s*"
_DOT = r"\s*(?:\.|[\[({]\s*(?:\.|dot)\s*[\])}]|\bdot\b)\s*"
_OTHER_EMAIL = re.compile(rf"[a-z0-9][a-z0-9._%+-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}", re.I)
_OTHER_IP = re.compile(rf"([0-9]+){_DOT}([0-9]+){_DOT}([0-9]+){_DOT}([0-9]+)", re.I)
_OTHER_CARD = re.compile(r"[0-9](?:[\x20._/-]?[0-9])+")
_OTHER_PHONE = re.compile(r"\+?\(?[0-9][0-9 ()./-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """What a match must hold besides its pattern."""
    digits = _digits(text)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in order; time in proportion to the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for found in pattern.finditer(text):
            if valid(KINDS[kind], found[0]):
                out.append((found.start(), kind, found.end()))
    return sorted(out)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _codes(text: str) -> np.ndarray:
    """ASCII as it is; other letters 128, all else 129."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.minimum(points, 129).astype(np.intp)
    for at in np.flatnonzero(points > 127):
        out[at] = 128 if chr(points[at]).isalpha() else 129
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class _Lstm:
    """One direction. Arrays are (steps, windows, cells)."""

    def __init__(self, rng: np.random.Generator, cells: int):
        self.cells = cells
        self.embed = rng.normal(0, 0.3, (130, 4 * cells))
        # Open gates for what is remembered, to begin with.
        self.embed[:, cells : 2 * cells] += 1
        self.again = rng.normal(0, 1 / np.sqrt(cells), (cells, 4 * cells))

    def run(self, codes: np.ndarray):
        size, (steps, n) = self.cells, codes.shape
        h, c = np.zeros((n, size)), np.zeros((n, size))
        states, kept = np.empty((steps, n, size)), []
        for t in range(steps):
            x = self.embed[codes[t]] + h @ self.again
            gates = _sigmoid(x[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(x[:, 3 * size :])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            kept.append((h, before, i, f, o, g, squashed))
            h = o * squashed
            states[t] = h
        return states, kept

    def back(self, codes: np.ndarray, kept: list, above: np.ndarray) -> list[np.ndarray]:
        size = self.cells
        d_embed, d_again = np.zeros_like(self.embed), np.zeros_like(self.again)
        d_h, d_c = np.zeros_like(above[0]), np.zeros_like(above[0])
        inputs = np.empty((*codes.shape, 4 * size))
        for t in range(len(codes) - 1, -1, -1):
            h, before, i, f, o, g, squashed = kept[t]
            d_h = d_h + above[t]
            d_c = d_c + d_h * o * (1 - squashed**2)
            d_x = np.concatenate(
                (
                    d_c * g * i * (1 - i),
                    d_c * before * f * (1 - f),
                    d_h * squashed * o * (1 - o),
                    d_c * i * (1 - g**2),
                ),
                axis=1,
            )
            d_c = d_c * f
            d_again += h.T @ d_x
            inputs[t] = d_x
            d_h = d_x @ self.again.T
        # Sums by character: sorted once, added up in runs.
        order = np.argsort(codes, axis=None, kind="stable")
        which, first = np.unique(codes.ravel()[order], return_index=True)
        d_embed[which] = np.add.reduceat(inputs.reshape(-1, 4 * size)[order], first, axis=0)
        return [d_embed, d_again]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Scores of tags from both directions, and of one tag after another."""

    def __init__(self, cells: int = CELLS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.forth, self.hence = _Lstm(rng, cells), _Lstm(rng, cells)
        self.out = rng.normal(0, 0.3, (2 * cells, TAGS))
        self.bias = np.zeros(TAGS)
        self.follow = np.zeros((TAGS, TAGS))
        self.first = np.zeros(TAGS)

    def weights(self) -> list[np.ndarray]:
        return [
            self.forth.embed, self.forth.again, self.hence.embed, self.hence.again,
            self.out, self.bias, self.follow, self.first,
        ]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """(steps, windows, tags) of codes (steps, windows)."""
        both = np.concatenate((self.forth.run(codes)[0], self.hence.run(codes[::-1])[0][::-1]), axis=2)
        return both @ self.out + self.bias

    def learn(self, codes: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean negative log likelihood of the windows' tag paths."""
        steps, n = codes.shape
        forth, kept_f = self.forth.run(codes)
        hence, kept_h = self.hence.run(codes[::-1])
        both = np.concatenate((forth, hence[::-1]), axis=2)
        scores = both @ self.out + self.bias
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + self.first
        for t in range(1, steps):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + self.follow, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = _log_sum(self.follow + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        d_scores = np.exp(ahead + behind - total[:, None])
        d_first = d_scores[0].copy()
        d_follow = np.zeros_like(self.follow)
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + self.follow + (scores[t] + behind[t])[:, None, :]
            d_follow += np.exp(pair - total[:, None, None]).sum(axis=0)
        columns = np.arange(n)
        np.add.at(d_follow, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        d_first[columns, tags[0]] -= 1
        d_scores[np.arange(steps)[:, None], columns, tags] -= 1
        d_scores /= n
        d_both = d_scores @ self.out.T
        size = self.forth.cells
        d_out = np.einsum("tnc,tnk->ck", both, d_scores, optimize=True)
        d_f = self.forth.back(codes, kept_f, d_both[:, :, :size])
        d_h = self.hence.back(codes[::-1], kept_h, d_both[::-1, :, size:])
        return [*d_f, *d_h, d_out, d_scores.sum(axis=(0, 1)), d_follow / n, d_first.sum(axis=0) / n]

    def likely(self, scores: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Probability of each tag of a path, given the whole stretch."""
        n = len(scores)
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + self.first
        for t in range(1, n):
            ahead[t] = _log_sum(ahead[t - 1][:, None] + self.follow, 0) + scores[t]
        for t in range(n - 2, -1, -1):
            behind[t] = _log_sum(self.follow + scores[t + 1] + behind[t + 1], 1)
        total = _log_sum(ahead[-1], 0)
        return np.exp((ahead + behind)[np.arange(n), path] - total)

    def best_paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of stretches of any lengths."""
        order = sorted(range(len(scores)), key=lambda s: len(scores[s]))
        out: list = [None] * len(scores)
        lo = 0
        while lo < len(order):
            # As many of like length as fit; a longer one goes alone.
            hi = lo + 1
            while hi < min(len(order), lo + GROUP) and (hi + 1 - lo) * len(scores[order[hi]]) <= GROUP_CHARS:
                hi += 1
            group = order[lo:hi]
            lo, longest, n = hi, len(scores[group[-1]]), len(group)
            padded = np.full((longest, n, TAGS), -1e6)
            padded[:, :, 0] = 0
            for column, s in enumerate(group):
                padded[: len(scores[s]), column] = scores[s]
            value = padded[0] + self.first
            came = np.zeros((longest, n, TAGS), np.uint8)
            for t in range(1, longest):
                ways = value[:, :, None] + self.follow
                came[t] = ways.argmax(axis=1)
                value = ways.max(axis=1) + padded[t]
            path = np.zeros((longest, n), np.intp)
            path[-1] = value.argmax(axis=1)
            for t in range(longest - 1, 0, -1):
                path[t - 1] = came[t][np.arange(n), path[t]]
            for column, s in enumerate(group):
                out[s] = path[: len(scores[s]), column]
        return out


def _examples(rng: random.Random) -> tuple[str, int | None]:
    """Something written out, and its kind, or none if it only looks like one."""
    word = lambda lo=3, hi=9: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(lo, hi)))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    host = f"{word()}{rng.choice(['', digits(1), '-' + word()])}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de'])}"
    name = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{digits(2)}", f"{word()}_{digits(2)}"])
    pick = rng.randrange(20)
    if pick < 3:
        return f"{name}@{host}", 0
    if pick < 7:
        at = rng.choice([" (at) ", " [at] ", "(at)", "[at]", " {at} ", " @ ", " (AT) ", " (At) ", " ( at ) ", " at "])
        dot = " dot " if at == " at " else rng.choice([".", " (dot) ", " [dot] ", "[dot]", " dot ", "."])
        return name + at + host.replace(".", dot), 0
    if pick < 9:
        return rng.choice([".", ".", " . ", "[.]", " dot "]).join(str(rng.randrange(256)) for _ in range(4)), 1
    if pick < 11:
        body = rng.choice("3456") + digits(14)
        body += next(c for c in "0123456789" if _luhn(body + c))
        gap = rng.choice(["", " ", "-", ".", "/", "_"])
        return gap.join(body[i : i + 4] for i in range(0, 16, 4)), 2
    if pick < 15:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}",
                           f"+{rng.randrange(1, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}/{b}-{c}"]), 3
    hexes = "".join(rng.choices("0123456789abcdef", k=rng.randrange(12, 41)))
    return rng.choice(
        [
            f"password={hexes}", f'token = "{hexes}"', f"AKIA{hexes.upper()}", hexes, digits(rng.randrange(1, 7)),
            f"{rng.randrange(1900, 2100)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"@{word()}",
            f"{digits(2)}:{digits(2)}", f"{digits(3)}.{digits(2)}", f"#{digits(5)}", f"{digits(1)}, {digits(2)} and {digits(3)}",
            f"{digits(2)}.{digits(2)}.{rng.randrange(1900, 2100)}", f"({word()}) {digits(3)}", f"{word()} @ {digits(3)}",
            f"the dot {word()}", f"{word()} dot {word()}", f"{digits(1)} dot {digits(1)}", f"{digits(2)}/{digits(2)}/{digits(4)}",
        ]
    ), None


def _paths(passages: list[str], rng: random.Random, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags, (windows, steps)."""
    codes, tags = [], []

    def take(text: str, spans: list[tuple[int, int, int]], centre: int) -> None:
        lo = max(0, min(centre - rng.randrange(20, 100), len(text) - WINDOW))
        labels = np.zeros(len(text), np.intp)
        for start, kind, end in spans:
            labels[start] = 1 + 2 * kind
            labels[start + 1 : end] = 2 + 2 * kind
        piece, path = _codes(text)[lo : lo + WINDOW], labels[lo : lo + WINDOW]
        blank = WINDOW - len(piece)
        codes.append(np.concatenate((piece, np.full(blank, 32, np.intp))))
        tags.append(np.concatenate((path, np.zeros(blank, np.intp))))

    for text in passages:
        spans = base_spans(text)
        hints = [m.start() for m in _HINT.finditer(text)]
        if hints:
            take(text, spans, rng.choice(hints))
    passages = [p for p in passages if p.strip()] or ["some words, and more of them: nothing else to see here. "]
    while len(codes) < most:
        words = rng.choice(passages).split()
        at = rng.randrange(len(words) + 1)
        before, after = " ".join(words[max(0, at - 14) : at]), " ".join(words[at : at + 14])
        if _HINT.search(before) or _HINT.search(after):
            continue
        text, spans = before, []
        for _ in range(rng.randrange(1, 3)):
            example, kind = _examples(rng)
            text += rng.choice([" ", " ", "\n", ": ", " ("])
            if kind is not None:
                spans.append((len(text), kind, len(text) + len(example)))
            text += example + rng.choice(["", "", ".", ",", ")", ";"]) + " "
        text += after
        take(text, spans, len(before))
    return np.array(codes), np.array(tags)


def train(passages: list[str], steps: int = STEPS, cells: int = CELLS, seed: int = 0) -> Tagger:
    rng = random.Random(seed)
    tagger = Tagger(cells, seed)
    codes, tags = _paths(passages, rng, len(passages) + 2400)
    weights = tagger.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    pick, size = np.random.default_rng(seed), 64
    for step in range(1, steps + 1):
        rows = pick.choice(len(codes), size)
        rate = 0.03 * (1 - step / (steps + 1)) + 0.001
        grads = tagger.learn(codes[rows].T, tags[rows].T)
        norm = max(1.0, np.sqrt(sum(float((g * g).sum()) for g in grads)) / 5)
        for w, g, m, v in zip(weights, grads, first, second):
            g = g / norm
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


def stretches(text: str) -> list[tuple[int, int]]:
    """Surroundings of whatever may belong to personal data, joined where they touch."""
    out: list[list[int]] = []
    for found in _HINT.finditer(text):
        lo, hi = max(0, found.start() - AROUND), min(len(text), found.end() + AROUND)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _stretch_scores(tagger: Tagger, codes: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of every character, averaged over the windows that hold it."""
    windows = [
        (s, at)
        for s, c in enumerate(codes)
        for at in range(0, max(1, len(c) - WINDOW + STRIDE), STRIDE)
    ]
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
    sums = [np.zeros((len(c), TAGS)) for c in codes]
    shares = [np.zeros(len(c)) for c in codes]
    for lo in range(0, len(windows), GROUP):
        group = windows[lo : lo + GROUP]
        block = np.full((WINDOW, len(group)), 32, np.intp)
        for column, (s, at) in enumerate(group):
            piece = codes[s][at : at + WINDOW]
            block[: len(piece), column] = piece
        scores = tagger.scores(block)
        for column, (s, at) in enumerate(group):
            n = min(WINDOW, len(codes[s]) - at)
            sums[s][at : at + n] += scores[:n, column] * weight[:n, None]
            shares[s][at : at + n] += weight[:n]
    return [x / w[:, None] for x, w in zip(sums, shares)]


def _well_formed(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        return _OTHER_EMAIL.fullmatch(text) is not None
    if kind == 1:
        parts = _OTHER_IP.fullmatch(text)
        return parts is not None and valid("ip", ".".join(parts.groups()))
    if kind == 2:
        return _OTHER_CARD.fullmatch(text) is not None and valid("card", text)
    return 10 <= len(digits) <= 15 and _OTHER_PHONE.fullmatch(text) is not None


def _places(row: int, text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, from, to, first, last): what is read for the spans that start from first to last."""
    for lo, hi in stretches(text):
        for first in range(lo, hi, LONG):
            last = min(hi, first + LONG)
            yield row, max(lo, first - WINDOW), min(hi, last + 2 * WINDOW), first, last


def _groups(texts: list[str]) -> Iterator[list[tuple[int, int, int, int, int]]]:
    held, size = [], 0
    for row, text in enumerate(texts):
        for place in _places(row, text):
            held.append(place)
            size += place[2] - place[1]
            if size >= GROUP_CHARS:
                yield held
                held, size = [], 0
    yield held


def added_spans(tagger: Tagger, texts: list[str], known: list[list]) -> list[list[tuple[int, int, int]]]:
    """For each text what the tagger finds besides the known spans."""
    out: list[list] = [[] for _ in texts]
    for group in _groups(texts):
        scores = _stretch_scores(tagger, [_codes(texts[row][lo:hi]) for row, lo, hi, _, _ in group])
        for (row, lo, _, first, last), score, path in zip(group, scores, tagger.best_paths(scores)):
            sure = None
            for start in np.flatnonzero(path % 2 == 1).tolist():
                if not first <= lo + start < last:
                    continue
                kind, end = int(path[start]) // 2, start + 1
                while end < len(path) and path[end] == 2 + 2 * kind:
                    end += 1
                a, b = lo + start, lo + end
                if out[row] and a < out[row][-1][2] or any(a < e and s < b for s, _, e in known[row]):
                    continue
                if not _well_formed(kind, texts[row][a:b]):
                    continue
                sure = tagger.likely(score, path) if sure is None else sure
                if sure[start:end].min() >= LIKELY:
                    out[row].append((a, kind, b))
    return out


RESULT = (
    "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,"
    "n_added:bigint,spans:string>"
)


def find(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """All rows and columns with counts and digest of the patterns' spans, and all spans."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learnt = sent.value
        for batch in batches:
            rows = []
            for lo in range(0, len(batch), 2048):
                texts = [t.as_py() or "" for t in batch.slice(lo, 2048)]
                hinted = [_HINT.search(t) is not None for t in texts]
                known = [base_spans(t) if h else [] for t, h in zip(texts, hinted)]
                some = [i for i, h in enumerate(hinted) if h]
                added = dict(zip(some, added_spans(learnt, [texts[i] for i in some], [known[i] for i in some])))
                for i, base in enumerate(known):
                    kinds = [kind for _, kind, _ in base]
                    more = added.get(i, [])
                    digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
                    rows.append([*(kinds.count(k) for k in range(4)), digest, len(more), written_spans(base + more)])
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string()]
            names = "n_email n_ip n_card n_phone base_sha256 n_added spans".split()
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    (name,) = own(docs, "found")
    names = "n_email n_ip n_card n_phone base_sha256 n_added spans".split()
    return docs.withColumn(name, F.arrow_udf(run, RESULT)(F.col(text))).select(
        *others(docs, *names), *[F.col(f"{name}.{n}").alias(n) for n in names]
    )


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE_TEXTS) -> list[str]:
    """Passages around a digit or `@` of a bounded number of texts, the same in every run.

    A hash of the id first leaves `LOOKED_AT` texts on average for each that is taken, so
    what comes to the driver does not grow with the table.
    """
    total = docs.count()
    chance = F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) / float(1 << 30)
    around = F.regexp_extract(text, rf"(?s).{{0,{SAMPLE_CHARS // 2}}}[0-9@].{{0,{SAMPLE_CHARS // 2}}}", 0)
    picked = (
        docs.where(chance < min(1.0, LOOKED_AT * most / max(total, 1)))
        .where(F.col(text).rlike("[0-9@]"))
        .select(F.xxhash64(doc_id).alias("order"), around.alias("passage"))
    )
    rows = sorted((row["order"], row["passage"]) for row in picked.collect())
    return [passage for _, passage in rows[:most]]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Tagger:
    return train(sample(docs, doc_id, text))
