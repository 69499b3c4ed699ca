"""The given tables in the roles of files, questions, vectors and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.operators.index import PageIndex
from pagewarden.plans.ingest import ingest
from pagewarden.session import fresh_path
from pagewarden.sources.tables import read_table

_indexes: dict[tuple[str, str], PageIndex] = {}


# A setting of the session: how many tasks the rows of a table are dealt out to.
PARTITIONS = "spark.pagewarden.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    partitions = spark.conf.get(PARTITIONS, None)
    return read_table(spark, f"{sf_dir}/{name}.parquet", int(partitions) if partitions else None)


def as_files(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        F.col("source").alias("unique_id"),
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias(
            "file_path"
        ),
        "text",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, unique_id, file_path, text): a tenant is a source."""
    return as_files(table(spark, sf_dir, "documents"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).drop("doc_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the stored vector of the same number; none if there is no such."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return asked.join(vectors(spark, sf_dir), "vec_id", "left").select(
        F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_embedding")
    )


def new_index(spark: SparkSession) -> PageIndex:
    return PageIndex(spark, fresh_path(spark, "index"))


def page_index(spark: SparkSession, sf_dir: str) -> PageIndex:
    """Index of all clean documents, written once per session and only read after."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not _indexes[key].exists():
        index = new_index(spark)
        ingest(documents(spark, sf_dir), index)
        _indexes[key] = index
    return _indexes[key]
