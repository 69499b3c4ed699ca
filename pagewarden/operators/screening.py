"""Personal-data screening of pages, files and messages.

`screen_documents` takes whole files as rows and decides inside the row, so the
gate costs no shuffle. `gate_pages` takes pages as rows, as they come from file
readers and plugged-in detectors, and needs one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagewarden.constants import DEFAULT_THRESHOLD, LINES_PER_PAGE
from pagewarden.functions import pii
from pagewarden.functions.phrases import PhraseList, phrase_runs
from pagewarden.functions.text import page_texts, tokens
from pagewarden.sources.pages import page_name

FILE_KEY = ["unique_id", "file_path"]


def entity_rows(df: DataFrame, keys: list[str], text: str = "text", rules=pii.RULES) -> DataFrame:
    """One row per finding, whatever its group and score."""
    return df.select(*keys, F.inline(pii.entities(F.col(text), rules)))


def find_phrases(df: DataFrame, keys: list[str], gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """Findings of listed phrases (entity_group, phrase, score), compared word by word.

    The phrases of a list that is short enough are looked for inside the row, and only
    what is found becomes rows. For a longer list all runs of words do, in the lengths
    that phrases have. Either is joined with the list by equality.
    """
    phrases = phrase_runs(gazetteer)
    length = F.size(F.split("_run", " "))
    try:
        runs = F.explode(PhraseList.read(gazetteer).runs(F.col(text)))
        found = df.select(*keys, runs.alias("_run"))
    except ValueError:
        # A handful of whole numbers: the phrase lengths in use.
        lengths = sorted(r[0] for r in phrases.select(length).distinct().collect())
        worded = df.select(*keys, tokens(F.col(text)).alias("_words"))
        starts = worded.select(*keys, "_words", F.explode(F.array(*map(F.lit, lengths))).alias("_n"))
        # A run starts at every word; runs over the end are too short to match.
        starts = starts.where(F.size("_words") >= F.col("_n"))
        every = F.transform(
            F.sequence(F.lit(1), F.size("_words") - F.col("_n") + 1),
            lambda at: F.array_join(F.slice("_words", at, F.col("_n")), " "),
        )
        found = starts.select(*keys, F.explode(every).alias("_run"))
    return found.join(phrases, "_run").select(*keys, "entity_group", "word", "score")


def screen_documents(
    documents: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    rules: Iterable[pii.Rule] = pii.RULES,
    lines_per_page: int = LINES_PER_PAGE,
) -> DataFrame:
    """Files with their pages and the listed findings of each page.

    Adds `pages`, an array of (page_no, text, found), and drops `text`.
    """
    rules = list(rules)
    pages = F.transform(
        page_texts("_lines", lines_per_page),
        lambda text, i: F.struct(
            (i + 1).alias("page_no"),
            text.alias("text"),
            pii.listed(pii.entities(text, rules), threshold).alias("found"),
        ),
    )
    lined = documents.withColumn("_lines", F.split("text", "\n")).drop("text")
    return lined.withColumn("pages", pages).drop("_lines")


def _bad_pages(pages="pages"):
    return F.filter(pages, lambda page: F.size(page["found"]) > 0)


def file_stats(screened: DataFrame) -> DataFrame:
    """Pages, and pages with findings, of each file."""
    return screened.select(
        *FILE_KEY,
        F.size("pages").cast("bigint").alias("total_pages"),
        F.size(_bad_pages()).cast("bigint").alias("pages_with_pii"),
    )


def bad_page_rows(screened: DataFrame) -> DataFrame:
    """One row per page that rejects its file, with its findings."""
    return screened.select(*FILE_KEY, F.inline(_bad_pages()))


def bad_pages(screened: DataFrame) -> DataFrame:
    """One row per page that rejects its file, with its warnings and the error text."""
    return with_errors(bad_page_rows(screened))


def with_errors(pages: DataFrame) -> DataFrame:
    """Warnings and error text of pages with findings.

    The error names the page it is about; the reference always names the last.
    """
    warned = pages.withColumn("pii_warnings", F.array_join(pii.warnings(F.col("found")), ", "))
    return warned.select(
        *FILE_KEY,
        "page_no",
        "pii_warnings",
        F.format_string("PII detected on page %d: %s", "page_no", "pii_warnings").alias("error"),
    )


def accepted_pages(screened: DataFrame) -> DataFrame:
    """Pages of the files without any finding."""
    others = [c for c in screened.columns if c != "pages"]
    # Not a filter: it would be moved below the screening and repeat it there.
    clean = F.when(F.size(_bad_pages()) == 0, F.col("pages"))
    return screened.select(*others, F.inline(clean)).drop("found").withColumn(
        "page_number", page_name(F.col("page_no"))
    )


def clean_pages(
    documents: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    rules: Iterable[pii.Rule] = pii.RULES,
    lines_per_page: int = LINES_PER_PAGE,
    observed: Observation | None = None,
) -> DataFrame:
    """What `accepted_pages(screen_documents(…))` gives, without listing findings.

    For ingestion, which only needs yes or no. An `observed` observation gets the counts
    of `REPORT` from the same pass.
    """
    rules = list(rules)
    others = [c for c in documents.columns if c != "text"]
    lined = documents.withColumn("_lines", F.split("text", "\n")).drop("text")
    cut = lined.withColumn("_texts", page_texts("_lines", lines_per_page)).drop("_lines")
    if observed:
        bad = F.transform("_texts", lambda text: pii.has_pii(text, threshold, rules))
        cut = cut.withColumn("_bad", bad).observe(observed, *_report("_bad", lambda bad: bad))
        is_bad = F.exists("_bad", lambda bad: bad)
    else:
        is_bad = F.exists("_texts", lambda text: pii.has_pii(text, threshold, rules))
    # Not a filter: it would be moved below the cutting and repeat it there.
    clean = F.when(~is_bad, F.col("_texts"))
    pages = cut.select(*others, F.posexplode(clean).alias("_at", "text"))
    number = F.col("_at") + 1
    return pages.select(
        *others,
        number.alias("page_no"),
        page_name(number).alias("page_number"),
        "text",
    )


# What a run of the gate counts.
REPORT = ["files", "files_with_pii", "total_pages", "pages_with_pii"]


def _report(pages: str, is_bad) -> list:
    bad = F.size(F.filter(pages, is_bad))
    counts = [F.lit(1), (bad > 0).cast("int"), F.size(pages), bad]
    return [F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(n) for c, n in zip(counts, REPORT)]


def gate_report(screened: DataFrame) -> DataFrame:
    """The counts of `REPORT` over screened files, as one row."""
    return screened.agg(*_report("pages", lambda page: F.size(page["found"]) > 0))


def gate_pages(pages: DataFrame, found: str = "found") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted pages, rejected files and file statistics of page rows.

    `found` holds the listed findings of a page. Statistics are added up before
    the shuffle; rejected files are few and narrow, and the join that removes
    them is left to the planner, which broadcasts them when they are small and
    splits an oversized file when they are not.
    """
    stats = pages.groupBy(*FILE_KEY).agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.sum(F.when(F.size(found) > 0, 1).otherwise(0)).cast("bigint").alias("pages_with_pii"),
    )
    rejected = pages.where(F.size(found) > 0).select(*FILE_KEY).distinct()
    accepted = pages.join(rejected, FILE_KEY, "left_anti").drop(found)
    return accepted, rejected, stats


def bulk_stats(stats: DataFrame) -> DataFrame:
    """One row over all files of a request."""
    return stats.agg(
        F.count(F.lit(1)).alias("files_to_process"),
        F.coalesce(F.sum((F.col("pages_with_pii") > 0).cast("bigint")), F.lit(0)).alias(
            "files_with_pii"
        ),
        F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("pages_with_pii"), F.lit(0)).alias("pages_with_pii"),
    )


def ingest_report(stats: DataFrame) -> DataFrame:
    """Result of each file: pages indexed, none of a rejected file, and its statistics."""
    return stats.select(
        *FILE_KEY,
        F.when(F.col("pages_with_pii") > 0, F.lit(0))
        .otherwise(F.col("total_pages"))
        .cast("bigint")
        .alias("num_pages_processed"),
        "total_pages",
        "pages_with_pii",
    )


def message_verdicts(
    messages: DataFrame, threshold: float = DEFAULT_THRESHOLD, text: str = "text", rules=pii.RULES
) -> DataFrame:
    """Adds `found`, `is_safe` and `message`."""
    screened = messages.withColumn("found", pii.listed(pii.entities(F.col(text), rules), threshold))
    return screened.withColumn("is_safe", F.size("found") == 0).withColumn(
        "message", pii.verdict(F.col("found"))
    )


def gate_messages(
    messages: DataFrame, threshold: float = DEFAULT_THRESHOLD, text: str = "text", rules=pii.RULES
) -> DataFrame:
    """Transcript rows of incoming messages: the message itself, or a warning in its place.

    Works on a batch and on a stream alike.
    """
    judged = message_verdicts(messages, threshold, text, rules)
    others = [c for c in messages.columns if c not in (text, "role")]
    return judged.select(
        *others,
        F.when(F.col("is_safe"), F.lit("user")).otherwise(F.lit("pii_warning")).alias("role"),
        F.when(F.col("is_safe"), F.col(text)).otherwise(F.col("message")).alias("content"),
    )
