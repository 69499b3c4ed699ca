import random

import numpy as np
import pytest
from common import clashing
from pyspark.sql import types as T

from pagewarden.llm import html
from pagewarden.llm.queries import op7_main_text, table

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


@pytest.fixture(scope="module")
def trees(spark):
    return html.train(html.sample(table(spark, "/root/testdata/sf0.001", "pages")))


def text_of(source):
    page = html.Page(source)
    return page.main_text(np.ones(len(page.tag)))


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a <b>b</b>c</p><p>d", "a bc d"),
        ("<p>one<br>two&amp;three&nbsp;four\n\n five</p>", "one two&three four five"),
        ("<script>var t='</p>';</script>x<style>p{}</style><!-- no --> y", "x y"),
        ("<p>a<p>b<ul><li>c<li>d</ul>e", "a b c d e"),
        ("plain &lt;b&gt; text", "plain <b> text"),
        ("a < b and c > d <p title='x>y'>z</p>", "a < b and c > d z"),
        ("<div><p>open <i>tags", "open tags"),
        ("</p></div>stray<!-- no end", "stray"),
        ("<script>no end", ""),
        ("<p title=\"no end>text</p> more", "text more"),
        ("", ""),
    ],
)
def test_markup(source, want):
    assert text_of(source) == want


def test_long_broken_markup_takes_linear_time():
    text_of("<p title=\"" * 20_000)
    text_of("<div>" * 3_000 + "x" + "</span>" * 3_000)
    text_of("<" * 100_000)


def test_decoding_never_keeps_below_a_drop():
    rng = np.random.default_rng(0)
    page = html.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
    for _ in range(50):
        odds = rng.normal(size=len(page.tag))
        odds[0] = 9
        kept = page.main_text(odds).split()
        best = max(
            (
                sum(o if k else -o for o, k in zip(odds, choice)),
                " ".join(t.strip() for i, t in page.text if i >= 0 and choice[i]),
            )
            for bits in range(2 ** (len(odds) - 1))
            for choice in [[True, *(bool(bits >> j & 1) for j in range(len(odds) - 1))]]
            if all(choice[page.parent[i]] or not choice[i] for i in range(1, len(odds)))
        )
        assert kept == best[1].split()


def test_laid_out_pages(trees):
    rng = random.Random(5)
    passages = [" ".join(rng.choices("alpha beta gamma delta epsilon, zeta. eta theta".split(), k=30)) for _ in range(40)]
    exact = 0
    for _ in range(60):
        source = html._layout(rng, passages)
        page = html.Page(source)
        keep = np.array(["keepme" in words for words in page.words])
        for i in range(len(keep) - 1, 0, -1):
            if keep[i] and page.tag[i] not in html.INLINE:
                keep[page.parent[i]] = True
        for i in range(1, len(keep)):
            if page.tag[i] in html.INLINE:
                keep[i] = keep[page.parent[i]]
        bare = html.Page(source.replace("keepme", ""))
        exact += bare.main_text(trees.odds(bare.features(trees.words))) == page.main_text(np.where(keep, 9.0, -9.0))
    assert exact >= 54


def test_parts_that_are_not_the_article(trees):
    source = (
        "<body><header class=site-header><h1>My site</h1></header><div class=cookie-banner><p>We use cookies here.</p></div>"
        "<div class='post-content'><h2>The title of it</h2><p>A first paragraph, long enough to be read as such.</p>"
        "<p>And a second one, with a <a href=x>link</a> in it, that goes on for a while.</p></div>"
        "<section id=comments><div class=comment><p>I liked it a lot, thank you!</p></div></section>"
        "<form><label>Your name</label><button>Send</button></form><footer>All rights reserved.</footer></body>"
    )
    page = html.Page(source)
    text = page.main_text(trees.odds(page.features(trees.words)))
    assert text.startswith("The title of it A first") and text.endswith("for a while.")


def test_odd_rows(spark, trees):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, None, "<p>x"), (3, "u", "<p>long " + "word " * 50_000)]
    frame = clashing(spark.createDataFrame(rows, PAGES), "extracted", "text")
    out = html.extract(frame, trees).collect()
    assert len(out) == 5 and all(r["text"] is not None for r in out)
    assert [r["text"] for r in out if r["page_id"] == 2] == ["", ""]
    assert html.extract(frame.limit(0), trees).count() == 0
    assert html.train([]).odds(html.Page("<p>x").features()).shape == (2,)


def test_query_against_the_article_element(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in table(spark, folder, "pages").collect()}
    for row in op7_main_text(spark, folder).collect():
        source = pages[row["page_id"]]
        article = source[source.index("<article>") : source.index("</article>")]
        assert row["text"] == text_of(article) and row["n_chars"] == len(row["text"])
