"""Main text of web pages by boosted trees over the nodes of the page.

A page becomes a tree of elements. Each element is described by its tag, the words in
its class, id and role, what its ancestors say, depth, place among and likeness to its
siblings, and the length, density, links and punctuation of the text below it. What an
attribute word speaks for is learnt beforehand: its log odds among the elements that carry
it, which elements and their descendants have as features. Boosted regression trees, grown in numpy on gradients of the log loss, give each element the
log odds of being main text. Decoding then goes through the tree from the leaves: an
element is kept, or dropped with all that is below it, whichever adds up to more, so a
dropped ancestor never has a kept descendant.

The trees learn from a bounded sample of pages, on two kinds of labels: elements in and
outside an `article` or `main`, and pages laid out anew around passages of the sample,
with and without such tags, where the role of every part is known.

A null or empty page has no text. Markup may be broken: unclosed and stray tags, and
comments and scripts without an end, are taken as browsers take them. Character references
are decoded; white space, also the no-break space, becomes one space; so do the borders of
blocks and line breaks. Pages are read one by one: repeated rows give repeated results, an
empty table none; other columns stay, and columns named like a result are replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.batches import bound_batches
from pagewarden.llm.names import others, own

# Pages that are learnt from, and characters of each.
SAMPLE_PAGES = 60
SAMPLE_CHARS = 20_000
LAYOUTS = 1200
# What marks the main text of pages laid out anew; no tree sees it.
MARK = "keepme"
MOST_ODDS = 4.0
TREES = 40
DEPTH = 4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>"
    r"|<[!?/][^<>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Names of HTML elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe noembed xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
LEAVES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "body": {"head"},
}
SCOPES = set("table ul ol dl select article section div body html main aside nav".split())
# Names that page layouts give to main text and to other parts. Pages laid
# out anew draw theirs from here; what they speak for is learnt.
FOR = set(
    "article body content entry main post story text hentry markdown prose page single blog news chapter"
    " headline paragraph".split()
)
AGAINST = set(
    "ad ads advert advertisement adsense banner breadcrumb breadcrumbs byline comment comments consent cookie"
    " cookies copyright disclaimer disqus dropdown footer footnote form gdpr header hidden legal login masthead"
    " menu meta modal nav navbar navigation newsletter notice pagination pager popup privacy promo promoted"
    " related reply replies respond review reviews search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe tag tags teaser toc toolbar topbar tracking widget widgets alert aside feedback"
    " discussion responses user recommended outbrain taboola".split()
)
KINDS = [
    {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"p", "blockquote", "pre", "figcaption", "dd", "dt", "td", "th"},
    {"li"},
    {"ul", "ol", "dl", "table", "tr", "tbody"},
    {"div", "section", "body", "html", "center"},
    {"article", "main"},
    {"nav", "menu"},
    {"aside"},
    {"footer"},
    {"header"},
    {"form", "fieldset", "label", "button", "select", "option", "legend", "input", "dialog"},
    {"head"},
    {"a"},
    INLINE - {"a"},
]
_KIND = {tag: at for at, tags in enumerate(KINDS) for tag in tags}


class Page:
    """Elements of a page in order, and its text as (element, text); element -1 parts blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words = ["#page"], [-1], [()]
        self.text: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, above: int) -> int:
        self.tag.append(tag)
        self.parent.append(above)
        words: tuple = ()
        if "=" in attributes:
            values = ["".join(v) for v in _ATTRIBUTE.findall(attributes)]
            words = tuple(w.lower() for value in values for w in _WORD.findall(value))
        self.words.append(words)
        return len(self.tag) - 1

    def _say(self, element: int, text: str) -> None:
        if text:
            self.text.append((element, html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        stack, at, tags = [0], 0, self.tag
        part = (-1, " ")
        while True:
            found = _TAG.search(source, at)
            if found is None:
                self._say(stack[-1], source[at:])
                return
            self._say(stack[-1], source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                if name not in INLINE:
                    self.text.append(part)
                # A stray end closes nothing.
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == name:
                        del stack[depth:]
                        break
                    if name in INLINE and tags[stack[depth]] not in INLINE:
                        break
                continue
            if name == "br" or name not in INLINE:
                self.text.append(part)
            if name in VOID:
                continue
            attributes = found[3] or found[6] or ""
            closed = CLOSES.get(name) or ({"p"} if name in LEAVES_P else None)
            if closed:
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = tags[stack[depth]]
                    if open_tag in closed:
                        del stack[depth:]
                        if closed == {"p"} or open_tag not in ("td", "th"):
                            break
                    elif open_tag in SCOPES:
                        break
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if attributes.endswith("/") and name not in LEAVES_P and name not in INLINE:
                continue
            stack.append(self._open(name, attributes, stack[-1]))

    def features(self, learnt: Mapping[str, float] | None = None) -> np.ndarray:
        """A row for every element; `learnt` has the log odds of attribute words."""
        learnt = learnt or {}
        # Lists, for single numbers of arrays are slow to read.
        n, tag, parent = len(self.tag), self.tag, self.parent
        chars, words, linked, stops = ([0] * n for _ in range(4))
        for element, text in self.text:
            if element < 0:
                continue
            size = len(text.strip())
            if size:
                chars[element] += size
                words[element] += text.count(" ") + 1
                stops[element] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        own_chars = chars[:]
        kind = [_KIND.get(t, len(KINDS)) for t in tag]
        good, bad = [0.0] * n, [0.0] * n
        for i, ws in enumerate(self.words):
            for word in ws:
                odds = learnt.get(word, 0.0)
                if odds > 0:
                    good[i] += odds
                else:
                    bad[i] -= odds
        above_bad, above_good = [0.0] * n, [0.0] * n
        depth, in_main, in_aside, in_form, in_link = ([0] * n for _ in range(5))
        siblings, nth = [0] * n, [0] * n
        same_tag: dict = {}
        for i in range(1, n):
            p = parent[i]
            k = kind[p]
            depth[i] = depth[p] + 1
            above_bad[i] = above_bad[p] if above_bad[p] > bad[p] else bad[p]
            above_good[i] = above_good[p] if above_good[p] > good[p] else good[p]
            in_main[i] = 1 if k == 5 else in_main[p]
            in_aside[i] = 1 if 6 <= k <= 9 else in_aside[p]
            in_form[i] = 1 if 10 <= k <= 11 else in_form[p]
            in_link[i] = 1 if k == 12 else in_link[p]
            if k == 12 or kind[i] == 12 or in_link[i]:
                linked[i] = own_chars[i]
            nth[i] = siblings[p]
            siblings[p] += 1
            key = (p, tag[i])
            same_tag[key] = same_tag.get(key, 0) + 1
        inner = [1] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            words[p] += words[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            inner[p] += inner[i]
        alike = [1] + [same_tag[parent[i], tag[i]] for i in range(1, n)]
        columns = np.array(
            [
                good, bad, above_good, above_bad, in_main, in_aside, in_form, in_link, depth, nth, alike,
                chars, own_chars, words, inner, linked, stops, siblings,
            ],
            np.float32,
        )
        above = np.maximum(parent, 0)
        nth, alike, chars, own_chars, words, inner, linked, stops, siblings = columns[9:]
        among = np.maximum(siblings[above], 1)
        around, total = chars[above], max(1.0, chars[0])
        some = np.maximum(chars, 1)
        out = np.zeros((n, len(KINDS) + 1 + 9 + 13), np.float32)
        out[np.arange(n), kind] = 1
        rest = out[:, len(KINDS) + 1 :].T
        rest[:9] = columns[:9]
        rest[9:] = [
            nth / among, np.minimum(among, 50), alike / among, np.log1p(chars), np.log1p(own_chars),
            np.log1p(words), np.log1p(chars / inner), linked / some, stops / np.maximum(words, 1),
            chars / total, chars / np.maximum(around, 1), np.log1p(inner), np.log1p(around / among),
        ]
        return out

    def main_text(self, odds: np.ndarray) -> str:
        """The text of the elements that decoding keeps."""
        n = len(self.tag)
        dropped, best = (-odds).tolist(), odds.tolist()
        drop = [False] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            drop[i] = dropped[i] > best[i]
            dropped[p] += dropped[i]
            best[p] += max(best[i], dropped[i])
        for i in range(1, n):
            drop[i] = drop[i] or drop[self.parent[i]]
        return " ".join("".join(text for i, text in self.text if i < 0 or not drop[i]).split())


class Trees:
    """Boosted trees over binned features; a node is (feature, bin) in level order."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.words: dict[str, float] = {}

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1
        ).astype(np.uint8)

    def _leaves(self, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            right = bins[rows, feature[node]] > cut[node]
            node = 2 * node + 1 + right
        return node - (2**DEPTH - 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float = 0.3) -> Trees:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) > 32:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)))
            self.edges.append((values[1:] + values[:-1]) / 2 if len(values) > 1 else values[:0])
        bins, width = self._bins(x), 34
        n, m = bins.shape
        share = float(np.clip((y * weight).sum() / weight.sum(), 0.01, 0.99))
        self.start = float(np.log(share / (1 - share)))
        odds = np.full(n, self.start)
        flat = bins + np.arange(m) * width
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            slope, bend = (y - p) * weight, p * (1 - p) * weight + 1e-9
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, 255)
            node = np.zeros(n, np.int64)
            for at in range(2**DEPTH - 1):
                rows = np.flatnonzero(node == at)
                if len(rows) >= 8:
                    where = flat[rows].ravel()
                    g, h = (
                        np.bincount(where, np.repeat(v[rows], m), m * width).reshape(m, width).cumsum(axis=1)
                        for v in (slope, bend)
                    )
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                    gain[(h < 0.5) | (all_h - h < 0.5)] = 0
                    top = int(gain.argmax())
                    if gain.ravel()[top] > 1e-6:
                        feature[at], cut[at] = top // width, top % width
                node[rows] = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
            leaf = node - (2**DEPTH - 1)
            value = rate * np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, bend, 2**DEPTH) + 1)
            self.trees.append((feature, cut, value))
            odds += value[leaf]
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            out += value[self._leaves(bins, feature, cut)]
        return out


def _labelled(page: Page) -> np.ndarray | None:
    """Whether elements belong to the article, if the page marks one."""
    inside = np.zeros(len(page.tag), bool)
    for i in range(1, len(page.tag)):
        p, kind = page.parent[i], _KIND.get(page.tag[i])
        inside[i] = inside[p] or kind == 5
        if kind in (6, 7, 8, 10):
            inside[i] = False
    if not any(t in ("article", "main") for t in page.tag):
        return None
    # What encloses the article goes with it.
    for i in range(len(page.tag) - 1, 0, -1):
        if inside[i] and page.tag[page.parent[i]] not in ("article", "main"):
            inside[page.parent[i]] = True
    return inside


def _layout(rng: random.Random, passages: list[str]) -> str:
    """A page around some passages; elements of the main text carry the word `keepme`."""
    short = lambda most=5: " ".join(rng.choice(passages).split()[: rng.randrange(1, most + 1)]) or "More"
    text = lambda: rng.choice(passages)
    others, mains = sorted(AGAINST), sorted(FOR)
    # Half of the parts go by any of the names there are, alone or with a second word.
    any_name = lambda names: rng.choice(names) + rng.choice(["", "", f"-{rng.choice(names)}", " box", "-wrap", "_1"])

    def named(words):
        name = rng.choice(words) if rng.random() < 0.5 else any_name(others)
        return f' class="{name}"' if rng.random() < 0.9 else f' id="{name}"'

    link = lambda: f'<a href="/x">{short()}</a>'

    def menu(tag, words):
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(3, 12)))
        return f"<{tag}{named(words)}><ul>{items}</ul></{tag}>" if rng.random() < 0.8 else f"<{tag}><ul>{items}</ul></{tag}>"

    def aside(tag, words, most=2):
        inside = "".join(f"<p>{text() if rng.random() < 0.5 else short(12)}</p>" for _ in range(rng.randrange(1, most + 1)))
        head = f"<h3>{short()}</h3>" if rng.random() < 0.5 else ""
        if rng.random() < 0.3:
            inside = short(14) if rng.random() < 0.5 else text()
        return f"<{tag}{named(words)}>{head}{inside}</{tag}>"

    extras = [
        lambda: menu("nav", ["menu", "nav", "main-nav", "breadcrumb"]),
        lambda: menu("div", ["menu", "navbar", "navigation", "tags", "pagination", "toc", "social share"]),
        lambda: aside("div", ["ad", "advert", "banner-ad", "sponsored", "promo", "adsense"]),
        lambda: aside("aside", ["sidebar", "widget", "related", "teaser"], 3),
        lambda: aside("div", ["sidebar", "widget-area", "related-posts", "newsletter", "subscribe"], 3),
        lambda: aside("div", ["cookie-notice", "cookie-banner", "consent", "gdpr", "alert notice", "popup"]),
        lambda: aside("section", ["comments", "comment-list", "discussion", "reviews"], 6),
        lambda: "".join(aside("div", ["comment", "comment-body", "reply", "user-comment"]) for _ in range(3)),
        lambda: f'<form action="/s"><label>{short()}</label><input><button>{short(2)}</button><p>{short(10)}</p></form>',
        lambda: f"<header{named(['header', 'masthead', 'site-header'])}><h1>{short()}</h1><p>{short(9)}</p></header>",
        lambda: f"<header><a href='/'>{short(3)}</a> {menu('nav', ['nav'])}</header>",
    ]

    def block():
        pick = rng.random()
        if pick < 0.7:
            body = text() if rng.random() < 0.8 else short(4)
            if rng.random() < 0.3:
                body = f"{body} {link()} <b>{short(3)}</b>"
            return f'<p class="keepme">{body}' + rng.choice(["</p>", "</p>", ""])
        if pick < 0.8:
            return f'<h2 class="keepme">{short(6)}</h2>'
        if pick < 0.9:
            items = "".join(f'<li class="keepme">{short(15)}</li>' for _ in range(rng.randrange(2, 6)))
            return f'<ul class="keepme">{items}</ul>'
        return f'<blockquote class="keepme"><p class="keepme">{text()}</p></blockquote>'

    body = [f'<h1 class="keepme">{short(9)}</h1>'] if rng.random() < 0.8 else []
    body += [block() for _ in range(rng.randrange(1, 14))]
    if rng.random() < 0.3:
        body.insert(rng.randrange(len(body) + 1), rng.choice(extras[2:6])())
    tag, words = rng.choice(
        [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry"), ("div", ""),
         ("section", "story"), ("div", "article-text"), ("div", "main"), ("article", "post")]
    )
    words = words if rng.random() < 0.5 else any_name(mains)
    main = f'<{tag} class="{words} keepme">{"".join(body)}</{tag}>'
    for _ in range(rng.randrange(0, 3)):
        main = f'<div class="{rng.choice(["wrap", "container", "row", "page", "", "col", "inner"])} keepme">{main}</div>'
    before = [rng.choice(extras)() for _ in range(rng.randrange(0, 4))]
    after = [rng.choice(extras)() for _ in range(rng.randrange(0, 4))]
    words = rng.choice(["footer", "site-footer", "legal copyright"])
    foot = [f"<footer>&copy; {short()} {text() if rng.random() < 0.3 else short(12)}</footer>"] if rng.random() < 0.5 else []
    foot += [f'<div class="{words}">{short(12)} {link()}</div>'] if rng.random() < 0.4 else []
    return "<html><head><title>x</title></head><body>" + "".join([*before, main, *after, *foot]) + "</body></html>"


def train(pages: list[str], seed: int = 0) -> Trees:
    """Trees from pages; without any, from layouts of made-up words alone."""
    rng = random.Random(seed)
    passages = [
        " ".join(html.unescape(p).split())
        for page in pages
        for p in re.findall(r"<p[^>]*>([^<]{20,})", page)
    ] or [" ".join("word" * rng.randrange(1, 3) for _ in range(rng.randrange(8, 60))) + "." for _ in range(50)]
    read, labels = [], []
    for source in pages:
        page = Page(source)
        inside = _labelled(page)
        if inside is not None:
            read.append(page)
            labels.append(inside)
    for _ in range(LAYOUTS):
        page = Page(_layout(rng, passages))
        keep = np.array([MARK in ws for ws in page.words])
        for i in range(len(keep) - 1, 0, -1):
            if keep[i] and page.tag[i] not in INLINE:
                keep[page.parent[i]] = True
        for i in range(1, len(keep)):
            if page.tag[i] in INLINE:
                keep[i] = keep[page.parent[i]]
        page.words = [tuple(w for w in ws if w != MARK) for ws in page.words]
        read.append(page)
        labels.append(keep)
    words = word_odds(read, labels)
    rows, truth = np.concatenate([page.features(words) for page in read]), np.concatenate(labels).astype(float)
    trees = Trees().fit(rows, truth, np.ones(len(truth)))
    trees.words = words
    return trees


def word_odds(pages: list[Page], labels: list[np.ndarray]) -> dict[str, float]:
    """Log odds of being main text, against all elements, of the attribute words seen twice or more."""
    inside, outside = Counter(), Counter()
    for page, keep in zip(pages, labels):
        for ws, kept in zip(page.words, keep):
            (inside if kept else outside).update(set(ws))
    share = (sum(int(k.sum()) for k in labels) + 1) / (sum(map(len, labels)) + 2)
    return {
        word: float(np.clip(np.log((inside[word] + 0.5) / (outside[word] + 0.5)) - np.log(share / (1 - share)), -MOST_ODDS, MOST_ODDS))
        for word in inside | outside
        if inside[word] + outside[word] > 1
    }


def sample(pages: DataFrame, page_id: str = "page_id", source: str = "html", most: int = SAMPLE_PAGES) -> list[str]:
    """A bounded number of pages, each up to a bounded size, the same ones in every run.

    A hash of the id first leaves about twice as many, so what comes to the driver does
    not grow with the table.
    """
    known = pages.where(F.col(source).isNotNull() & F.col(page_id).isNotNull())
    chance = F.pmod(F.xxhash64(page_id), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(chance < min(1.0, 2 * most / max(known.count(), 1))).select(
        F.xxhash64(page_id).alias("order"), F.substring(source, 1, SAMPLE_CHARS).alias("html")
    )
    rows = sorted((row["order"], row["html"]) for row in picked.collect())
    return [source for _, source in rows[:most]]


def extract(pages: DataFrame, trees: Trees, source: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns with the main text, empty if there is none."""
    bound_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learnt = sent.value
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 64):
                read = [Page(t.as_py() or "") for t in batch.slice(lo, 64)]
                rows = [page.features(learnt.words) for page in read]
                odds = learnt.odds(np.concatenate(rows))
                ends = np.cumsum([len(r) for r in rows])
                out += [page.main_text(o) for page, o in zip(read, np.split(odds, ends[:-1]))]
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    (name,) = own(pages, "extracted")
    return pages.withColumn(name, F.arrow_udf(run, "string")(F.col(source))).select(
        *others(pages, out), F.col(name).alias(out)
    )
