import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewarden.constants import SAFE_MESSAGE
from pagewarden.functions import pii
from pagewarden.functions.phrases import PhraseList
from pagewarden.operators.detectors import detect_with
from pagewarden.operators.screening import (
    accepted_pages,
    bad_pages,
    bulk_stats,
    clean_pages,
    file_stats,
    find_phrases,
    gate_messages,
    gate_pages,
    ingest_report,
    message_verdicts,
    screen_documents,
)
from pagewarden.sources.pages import split_pages

TEXTS = {
    "safe": "Which harbours does the northern ferry call at?",
    "business": "The orchard had a better harvest than in the two years before",
    "both": "Reach Ada at ada.l@mill.example or dial 555-8642",
    "phones": "The office has (555) 867-5310 and 555-867-5311",
    "mail": "Questions go to desk@library.example until Friday",
    "ssn": "It is 123-45-6789.",
    "secret": "key " + "0a" * 20,
    "date": "due 2024-01-31",
    "null": None,
    "empty": "",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "name string, text string")


# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def found(texts, threshold=0.8):
    rows = texts.select("name", pii.listed(pii.entities(F.col("text")), threshold).alias("f"))
    return {r["name"]: [(e["word"], e["entity_group"]) for e in r["f"]] for r in rows.collect()}


def test_findings(texts):
    hits = found(texts)
    assert hits["both"] == [
        ("ada.l@mill.example", "EMAIL_ADDRESS"),
        ("555-8642", "PHONE_NUMBER"),
    ]
    assert hits["phones"] == [("(555) 867-5310", "PHONE_NUMBER"), ("555-867-5311", "PHONE_NUMBER")]
    assert hits["ssn"] == [("123-45-6789", "SSN")]
    for name in ("safe", "business", "secret", "date", "null", "empty"):
        assert hits[name] == [], name


def test_long_runs_take_no_long_time(spark):
    runs = ["x@ " + "aB9" * 70_000, "x@ " + "a+b." * 50_000, "x@" + "a." * 50_000 + "a", "-. @" + "1" * 200_000,
            "@-" + "1.1" * 70_000, "-" + "555-" * 50_000]
    df = spark.createDataFrame([(t,) for t in runs], "text string")
    started = time.time()
    assert df.select(F.sum(F.size(pii.entities(F.col("text"))))).first()[0] > 0
    assert time.time() - started < 60


def test_raising_the_threshold_adds_nothing(texts):
    low, middle, high = (found(texts, t) for t in (0.6, 0.8, 0.9))
    assert low["date"] == [("2024-01-31", "DATE_TIME")]
    for name in TEXTS:
        assert set(high[name]) <= set(middle[name]) <= set(low[name])


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9, 0.96])
def test_yes_or_no_agrees_with_findings(texts, threshold):
    rows = texts.select(
        pii.has_pii(F.col("text"), threshold).alias("short"),
        (F.size(pii.listed(pii.entities(F.col("text")), threshold)) > 0).alias("long"),
    ).collect()
    assert all(r["short"] == r["long"] for r in rows)


def test_messages(texts):
    rows = {r["name"]: r for r in message_verdicts(texts).collect()}
    assert rows["safe"]["is_safe"] and rows["safe"]["message"] == SAFE_MESSAGE
    assert not rows["mail"]["is_safe"]
    assert rows["mail"]["message"].endswith("such as: desk@library.example (EMAIL_ADDRESS, 0.99)")


def test_message_gate(texts):
    rows = {r["name"]: r for r in gate_messages(texts).collect()}
    assert rows["business"]["role"] == "user" and rows["business"]["content"] == TEXTS["business"]
    assert rows["phones"]["role"] == "pii_warning" and "555" in rows["phones"]["content"]


def pages(*texts):
    """A text of ten-line pages."""
    return "\n".join("\n".join([t] + ["x"] * 9) for t in texts)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [
        ("a", "clean", pages("one", "two", "three")),
        ("a", "one bad", pages("one", "a@b.com", "three")),
        ("b", "all bad", pages("a@b.com", "1.2.3.4")),
        # The number is cut by the page border, and each page is screened alone.
        ("b", "cut", "\n".join(["x"] * 9 + ["555"]) + "\n-1234"),
        ("b", "empty", ""),
    ]
    return spark.createDataFrame(rows, "unique_id string, file_path string, text string")


def test_gate(documents):
    screened = screen_documents(documents)
    stats = {r["file_path"]: (r["total_pages"], r["pages_with_pii"]) for r in file_stats(screened).collect()}
    assert stats == {"clean": (3, 0), "one bad": (3, 1), "all bad": (2, 2), "cut": (2, 0), "empty": (1, 0)}
    bad = {(r["file_path"], r["page_no"]): r for r in bad_pages(screened).collect()}
    assert set(bad) == {("one bad", 2), ("all bad", 1), ("all bad", 2)}
    assert bad["all bad", 2]["error"] == "PII detected on page 2: 1.2.3.4 (IP_ADDRESS)"


def test_three_ways_through_the_gate_agree(documents):
    def rows(df):
        columns = ["unique_id", "file_path", "page_no", "page_number", "text"]
        return sorted(map(tuple, df.select(*columns).collect()))

    listed = pii.listed(pii.entities(F.col("text")))
    accepted, rejected, stats = gate_pages(split_pages(documents).withColumn("found", listed))
    assert rows(accepted) == rows(clean_pages(documents)) == rows(accepted_pages(screen_documents(documents)))
    assert {r["file_path"] for r in rejected.collect()} == {"one bad", "all bad"}
    mine = sorted(map(tuple, stats.select(file_stats(screen_documents(documents)).columns).collect()))
    assert mine == sorted(map(tuple, file_stats(screen_documents(documents)).collect()))


def test_reports(documents):
    stats = file_stats(screen_documents(documents))
    report = {r["file_path"]: r["num_pages_processed"] for r in ingest_report(stats).collect()}
    assert report == {"clean": 3, "one bad": 0, "all bad": 0, "cut": 2, "empty": 1}
    assert bulk_stats(stats).first().asDict() == {
        "files_to_process": 5,
        "files_with_pii": 2,
        "total_pages": 11,
        "pages_with_pii": 3,
    }
    assert bulk_stats(stats.where("false")).first()["total_pages"] == 0


def test_gazetteer(spark):
    texts = spark.createDataFrame(
        [(1, "Ada Byron wrote it, and ADA  byron signed."), (2, "Adabyron"), (3, "Rome, Rome")],
        "id int, text string",
    )
    names = spark.createDataFrame(
        [("PERSON", "Ada Byron", 0.9), ("LOCATION", "Rome", 0.85), ("PERSON", "...", 0.9)],
        "entity_group string, phrase string, score double",
    )
    rows = sorted(map(tuple, find_phrases(texts, ["id"], names).collect()))
    assert rows == [(1, "PERSON", "Ada Byron", 0.9)] * 2 + [(3, "LOCATION", "Rome", 0.85)] * 2


def _load_detector():
    def detect(text):
        if "boom" in text:
            raise RuntimeError("no")
        return [
            {"entity_group": "PERSON", "word": word, "score": 0.95, "start": 0}
            for word in text.split()
            if word == "Ann"
        ]

    return detect


@pytest.mark.parametrize("on_error, unsafe", [("open", {"named"}), ("closed", {"named", "failing"})])
def test_plugged_detector(spark, on_error, unsafe):
    texts = spark.createDataFrame(
        [("named", "hello Ann"), ("plain", "hello"), ("failing", "boom"), ("null", None)],
        "name string, text string",
    )
    rows = {r["name"]: r for r in detect_with(texts, _load_detector, on_error=on_error).collect()}
    assert {n for n, r in rows.items() if r["found"]} == unsafe
    assert [n for n, r in rows.items() if r["detect_error"]] == ["failing"]


def test_phrases_among_the_rules(spark):
    names = spark.createDataFrame(
        [("PERSON", "Ada Byron", 0.9), ("LOCATION", "Saint-Malo", 0.85), ("LOCATION", "Rome", 0.5), ("PERSON", " .", 0.9)],
        "entity_group string, phrase string, score double",
    )
    rules = [*pii.RULES, PhraseList.read(names)]
    texts = spark.createDataFrame(
        [(1, "ADA byron, mail a@b.com, saint malo"), (2, "Rome"), (3, "ada"), (4, ""), (5, None), (6, "x ada byron")],
        "id int, text string",
    )
    rows = {r["id"]: r for r in message_verdicts(texts, rules=rules).collect()}
    found = [(e["entity_group"], e["word"]) for e in rows[1]["found"]]
    assert found == [("EMAIL_ADDRESS", "a@b.com"), ("PERSON", "ada byron"), ("LOCATION", "saint malo")]
    assert [i for i, r in rows.items() if not r["is_safe"]] == [1, 6]
    hit = texts.select("id", pii.has_pii(F.col("text"), rules=rules).alias("hit")).where("hit").collect()
    assert sorted(r["id"] for r in hit) == [1, 6]


def test_lists_beyond_the_limit_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "rome and rome again"), (2, "so it goes")], "id int, text string")
    names = spark.createDataFrame(
        [("LOCATION", "Rome", 0.9), ("PERSON", "it goes", 0.9)], "entity_group string, phrase string, score double"
    )
    whole = sorted(map(tuple, find_phrases(texts, ["id"], names).collect()))
    monkeypatch.setattr(PhraseList.read, "__defaults__", (1,))
    with pytest.raises(ValueError):
        PhraseList.read(names)
    assert sorted(map(tuple, find_phrases(texts, ["id"], names).collect())) == whole
    assert find_phrases(texts, ["id"], names.limit(0)).count() == 0
