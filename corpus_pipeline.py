"""A training corpus from `documents`, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from pagewarden.llm import bpe, language, lines, minhash, mixing
from pagewarden.llm.names import own
from pagewarden.llm.queries import vocabulary
from pagewarden.session import drop_path, fresh_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null, empty and letterless texts go.

    A low score drops nothing: how low that of a right language may be depends on how
    many languages were learnt, and on how short or mixed the text is.
    """
    return language.identify(docs).where(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    return lines.drop_shared_lines(docs).select(docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    (gone,) = own(docs, "gone")
    copies = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with slot and place, written in the order of these.

    A file scan may read part files in another order, so the two columns hold it.
    """
    return mixing.in_order(mixing.mix(docs)).drop("block")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again.

    Sorted by slot and place, the rows are in the order of the mix.
    """
    coded = bpe.round_trip(docs, vocabulary(), public_tokenizers.PATTERN)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == whole).alias("decodes"),
        "slot",
        "place",
    )


STAGES = [
    ("language", keep_languages),
    ("line_dedup", drop_lines),
    ("near_duplicates", keep_first_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# Learnt models and rank queues have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # No stage reads what came before its predecessor.
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
