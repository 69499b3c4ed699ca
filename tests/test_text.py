import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewarden.constants import PLACEHOLDER_CONTENT
from pagewarden.functions.text import (
    or_placeholder,
    or_zero_vector,
    shares_token,
    vector_entries,
    with_hashed_vector,
    with_markup_text,
)
from pagewarden.sources.pages import read_files, split_pages
from pagewarden.sources.requests import manifest_requests, upload_requests, with_progress


@pytest.mark.parametrize("lines", [0, 1, 9, 10, 11, 20, 25])
def test_pages_put_together_again_are_the_text(spark, lines):
    text = "\n".join(f"line {i}" for i in range(lines))
    df = spark.createDataFrame([("f", text)], "file_path string, text string")
    rows = split_pages(df).orderBy("page_no").collect()
    assert "\n".join(r["text"] for r in rows) == text
    assert [r["page_number"] for r in rows] == [f"page_{i + 1}" for i in range(len(rows))]
    assert len(rows) == max(1, -(-lines // 10))


def test_placeholder_takes_empty_but_not_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("x",)], "c string")
    got = [r[0] for r in df.select(or_placeholder(F.col("c"))).collect()]
    assert got == [PLACEHOLDER_CONTENT, PLACEHOLDER_CONTENT, " ", "x"]


def test_markup(spark):
    html = "<html><STYLE>p{}</STYLE><nav>a</nav><p>One\n two &amp;</p><script>x('<p>')</script></html>"
    rows = [html, "a < b <p>c</p> < d", "<script>x", "<nav>x</nav><nav>y<b>z", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, html string")
    got = [r["text"] for r in with_markup_text(df, "html").orderBy("id").collect()]
    assert got == ["One two &amp;", "a c < d", "x", "y z", "", None]


def test_open_markup_takes_no_long_time(spark):
    rows = ["<" * 200_000, "<script>" * 20_000, "a < " * 50_000 + "</nav>" + "<nav>" * 20_000]
    df = spark.createDataFrame([(r,) for r in rows], "html string")
    started = time.time()
    with_markup_text(df, "html").collect()
    assert time.time() - started < 30


def test_hashed_vector_counts_tokens(spark):
    texts = ["", None, "!!", "a b a", "The the THE cat", "é x1 x1é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for row in vector_entries(with_hashed_vector(df, "text"), ["id"]).collect():
        got.setdefault(row["id"], {})[row["bucket"]] = row["w"]

    def bucket(token):
        return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 1536

    assert got.get(0) is None and got.get(1) is None and got.get(2) is None
    assert got[3] == Counter(map(bucket, ["a", "b", "a"]))
    assert got[4] == Counter(map(bucket, ["the", "the", "the", "cat"]))
    assert got[5] == Counter(map(bucket, ["x1", "x1"]))


def test_zero_vector(spark):
    df = spark.createDataFrame([(None,), ([],), ([1.0, 2.0],)], "v array<float>")
    got = [r[0] for r in df.select(or_zero_vector(F.col("v"), 2)).collect()]
    assert got == [[0.0, 0.0], [0.0, 0.0], [1.0, 2.0]]


def test_paths_share_a_token(spark):
    df = spark.createDataFrame([("a/one.pdf",), ("b/two.txt",)], "p string")
    got = [r[0] for r in df.select(shares_token(F.col("p"), "Three.PDF")).collect()]
    assert got == [True, False]


def test_files_with_a_bad_one(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"one|two")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    (tmp_path / "other.txt").write_bytes(b"x")
    pages, failed = read_files(spark, str(tmp_path), lambda raw: raw.decode("utf-8").split("|"))
    assert [(r["page_number"], r["text"]) for r in pages.orderBy("page_no").collect()] == [
        ("page_1", "one"),
        ("page_2", "two"),
    ]
    only = failed.collect()
    assert len(only) == 1 and only[0]["file_path"].endswith("bad.pdf")
    assert only[0]["error"].startswith("UnicodeDecodeError")


def test_manifest(spark, tmp_path):
    (tmp_path / "tenant.json").write_text('[{"name": "a.pdf"},\n {"name": "b.pdf", "size": 3}]')
    rows = manifest_requests(spark, str(tmp_path)).orderBy("file_path").collect()
    assert [tuple(r) for r in rows] == [("tenant.json", "a.pdf"), ("tenant.json", "b.pdf")]


def test_upload_key(spark):
    files = spark.createDataFrame([("u", "/x/a.pdf", "a.pdf")], "unique_id string, file_path string, name string")
    row = upload_requests(files, "m").first()
    assert row["file_key"] == "u_a.pdf" and row["use_local_storage"] and row["model_id"] == "m"


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_progress_by_blocks(spark, block):
    rows = [("big", i * 7 - 40) for i in range(20)] + [("small", 5)]
    df = spark.createDataFrame(rows, "batch string, n long")
    got = with_progress(df, "batch", "n", block).orderBy("batch", "n").collect()
    assert [r["position"] for r in got] == [*range(1, 21), 1]
    assert got[9]["progress"] == 0.5 and got[20]["progress"] == 1.0
