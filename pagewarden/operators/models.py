"""Describing, embedding and answering: slots for models, and rules that stand in.

The stand-ins are fixed text rules, not language models. A plugged-in model is a
function that loads a client; it runs once per task.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.constants import (
    ENRICH_FAILED,
    NO_ANSWER,
    QUERY_FAILED,
    VECTOR_DIM,
    WARNED_AFTER,
    WARNED_BEFORE,
)
from pagewarden.functions.prompts import enrich_prompt
from pagewarden.functions.text import collapse_space, or_zero_vector

TRIES = 3
TIMEOUT_SECONDS = 30
CALLS_AT_ONCE = 8
# Calls whose time is over and that still hold a thread.
HUNG_CALLS = 64
# Replies that a task keeps for equal prompts.
REMEMBERED = 10_000

Client = Callable[[str], str]
Embedder = Callable[[list[str]], list[list[float] | None]]


def complete_with(
    df: DataFrame,
    load: Callable[[], Client],
    prompt: str,
    name: str,
    fallback: str,
    tries: int = TRIES,
    timeout: float = TIMEOUT_SECONDS,
    partitions: int | None = None,
    error: str | None = None,
) -> DataFrame:
    """Adds a model's reply to a prompt column; the fallback text where it fails.

    No row is lost to a failing call. Equal prompts are called once in a task, as long as
    `REMEMBERED` replies last. Calls are settled as they end, `CALLS_AT_ONCE` at a time, and
    one that hangs holds up none but itself: when its time is over, its place goes to the
    next. Hung calls keep their threads, so after `HUNG_CALLS` of them at once the rest of
    the batch waits for one to end and, failing that, gets the fallback. `error` names a
    column for what went wrong. `partitions` spreads the rows first, for calls so slow that
    one long file must not hold up a task.
    """

    @F.pandas_udf("reply string, error string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client, known = load(), {}
        hung: set = set()

        def attempt(text: str) -> tuple[str, str | None]:
            problem = None
            for _ in range(tries):
                try:
                    return str(client(text)), None
                except Exception as failed:
                    problem = f"{type(failed).__name__}: {failed}"
            return fallback, problem

        def begin(text: str) -> Future:
            reply: Future = Future()
            # A thread of its own: one that hangs takes no worker from the others.
            threading.Thread(target=lambda: reply.set_result(attempt(text)), daemon=True).start()
            return reply

        for batch in prompts:
            waiting = deque(text for text in dict.fromkeys(batch) if text not in known)
            found: dict = {}
            running: dict = {}
            while waiting or running:
                hung -= {reply for reply in hung if reply.done()}
                while waiting and len(running) < CALLS_AT_ONCE and len(hung) < HUNG_CALLS:
                    text = waiting.popleft()
                    running[begin(text)] = (text, time.monotonic() + timeout * tries)
                if not running:
                    # Every thread hangs.
                    if wait(hung, timeout * tries, FIRST_COMPLETED).done:
                        continue
                    found |= {text: (fallback, "no call ends any more") for text in waiting}
                    break
                next_end = min(until for _, until in running.values())
                done, _ = wait(running, max(0.0, next_end - time.monotonic()), FIRST_COMPLETED)
                for reply in done:
                    found[running.pop(reply)[0]] = reply.result()
                now = time.monotonic()
                for reply in [r for r, (_, until) in running.items() if until <= now]:
                    found[running.pop(reply)[0]] = (fallback, "TimeoutError: no reply in time")
                    hung.add(reply)
            rows = [known[text] if text in known else found[text] for text in batch]
            yield pd.DataFrame(rows, columns=["reply", "error"], index=batch.index)
            known |= {text: reply for text, reply in found.items() if reply[1] is None}
            while len(known) > REMEMBERED:
                del known[next(iter(known))]

    spread = df.repartition(partitions) if partitions else df
    replied = spread.withColumn("_replied", run(F.col(prompt))).withColumn(name, F.col("_replied.reply"))
    if error:
        replied = replied.withColumn(error, F.col("_replied.error"))
    return replied.drop("_replied")


def describe(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds `llm_generated` without a model: the whole page text on one line."""
    return pages.withColumn("llm_generated", collapse_space(F.col(text)))


def describe_with(
    pages: DataFrame,
    load: Callable[[], Client],
    metadata: list[str] = ["unique_id", "file_path"],
    text: str = "text",
    **options,
) -> DataFrame:
    """Adds `llm_generated` from a model that is shown the page and its metadata."""
    prompted = pages.withColumn(
        "_prompt", enrich_prompt(F.to_json(F.struct(*metadata)), F.col(text))
    )
    done = complete_with(prompted, load, "_prompt", "llm_generated", ENRICH_FAILED, **options)
    return done.drop("_prompt")


def refuse_warned(pages: DataFrame, warning: str = "pii_warning") -> tuple[DataFrame, DataFrame]:
    """Pages that may be described, and pages refused because they carry a warning."""
    warned = F.coalesce(F.col(warning), F.lit("")) != ""
    refused = pages.where(warned).withColumn(
        "error",
        F.concat(F.lit(WARNED_BEFORE), F.col(warning), F.lit(WARNED_AFTER)),
    )
    return pages.where(~warned), refused


def embed_with(
    df: DataFrame,
    load: Callable[[], Embedder],
    text: str,
    name: str = "text_embedding",
    dim: int = VECTOR_DIM,
) -> DataFrame:
    """Adds a model's dense vector; all zeros where the model fails or gives none."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = load()
        for batch in texts:
            try:
                vectors = list(embedder(list(batch)))
            except Exception:
                # One bad text must not cost the others their vectors.
                vectors = []
                for value in batch:
                    try:
                        vectors.append(embedder([value])[0])
                    except Exception:
                        vectors.append(None)
            yield pd.Series(vectors, index=batch.index, dtype=object)

    embedded = df.withColumn("_vector", run(F.col(text)))
    return embedded.withColumn(name, or_zero_vector(F.col("_vector"), dim)).drop("_vector")


def stored_vectors(
    df: DataFrame,
    vectors: DataFrame,
    on: str,
    vector: str = "embedding",
    name: str = "text_embedding",
    dim: int = VECTOR_DIM,
) -> DataFrame:
    """Adds vectors from a table; all zeros where it has none."""
    joined = df.join(vectors.select(on, F.col(vector).alias("_vector")), on, "left")
    return joined.withColumn(name, or_zero_vector(F.col("_vector"), dim)).drop("_vector")


def best_hit_answer(hits: str = "hits"):
    """Answer without a model: the text of the first hit, or that there is none."""
    first = F.get(hits, F.lit(0))
    return F.coalesce(first["llm_generated"], F.lit(NO_ANSWER))


def answer_with(prompts: DataFrame, load: Callable[[], Client], **options) -> DataFrame:
    """Adds `answer` from a model; a fixed apology where the call fails."""
    return complete_with(prompts, load, "prompt", "answer", QUERY_FAILED, **options)
