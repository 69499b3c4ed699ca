"""Slot for a language model that finds personal data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.constants import DEFAULT_THRESHOLD
from pagewarden.functions import pii

Detector = Callable[[str], list[dict]]


def detect_with(
    df: DataFrame,
    load: Callable[[], Detector],
    text: str = "text",
    threshold: float = DEFAULT_THRESHOLD,
    on_error: str = "open",
) -> DataFrame:
    """Adds `found` (listed findings) and `detect_error`.

    `load` runs once per task and returns a function from a text to a
    list of dicts with `entity_group`, `word` and `score`. A text the detector
    fails on counts as safe with `on_error="open"`, as in the reference, and as
    unsafe with `"closed"`; either way `detect_error` tells, so it can be counted.
    """
    if on_error not in ("open", "closed"):
        raise ValueError("on_error must be 'open' or 'closed'")

    @F.pandas_udf(
        "found array<struct<entity_group:string,word:string,score:double>>, error string"
    )
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = load()
        for batch in texts:
            found, errors = [], []
            for value in batch:
                try:
                    hits = detector(value or "")
                    found.append(
                        [
                            {
                                "entity_group": str(h["entity_group"]),
                                "word": str(h["word"]),
                                "score": float(h["score"]),
                            }
                            for h in hits
                        ]
                    )
                    errors.append(None)
                except Exception as problem:
                    found.append([])
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pd.DataFrame({"found": found, "error": errors})

    ran = df.withColumn("_ran", run(F.col(text)))
    found = pii.listed(F.col("_ran.found"), threshold)
    if on_error == "closed":
        failed = F.array(
            F.struct(
                F.lit("USER").alias("entity_group"),
                F.lit("detection failed").alias("word"),
                F.lit(1.0).alias("score"),
            )
        )
        found = F.when(F.col("_ran.error").isNotNull(), failed).otherwise(found)
    return (
        ran.withColumn("found", found)
        .withColumn("detect_error", F.col("_ran.error"))
        .drop("_ran")
    )
