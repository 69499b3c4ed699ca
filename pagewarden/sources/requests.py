"""Ingestion and delete requests as rows: one row asks for one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("name", T.StringType())])


def upload_requests(files: DataFrame, model_id: str | None = None) -> DataFrame:
    """Requests for landed files (unique_id, name, file_path).

    Works on a batch and on a stream alike.
    """
    return files.select(
        "unique_id",
        "file_path",
        F.lit(True).alias("use_local_storage"),
        F.lit(model_id).cast("string").alias("model_id"),
        F.concat_ws("_", "unique_id", "name").alias("file_key"),
    )


def upload_stream(
    spark: SparkSession, landing: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Unbounded rows of the Parquet files that arrive in a landing folder.

    `files_per_batch` bounds a micro-batch, so a backlog is worked off in steps.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(landing)


def bulk_requests(bulk: DataFrame) -> DataFrame:
    """Requests from rows that name many files: (unique_id, file_paths)."""
    return bulk.select("unique_id", F.explode("file_paths").alias("file_path"))


def manifest_requests(spark: SparkSession, path: str, tenant: str | None = None) -> DataFrame:
    """Requests from JSON manifests: arrays of objects with a `name`.

    The tenant is the file name of the manifest, or what the first group of the pattern
    `tenant` finds in its path.
    """
    reader = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True)
    rows = reader.json(path)
    name = F.col("_metadata.file_name")
    owner = F.regexp_extract(F.col("_metadata.file_path"), tenant, 1) if tenant else name
    return rows.select(owner.alias("unique_id"), F.col("name").alias("file_path"))


def with_progress(requests: DataFrame, batch: str, order: str, block: int = 10_000) -> DataFrame:
    """Position of each request in its batch, batch size and the share done so far.

    `order` is a whole number that is unique within a batch. Positions are
    counted in blocks of that number, then shifted by the sizes of the blocks
    before, so no task has to sort a whole batch.
    """
    blocked = requests.withColumn("_block", F.col(order) - F.pmod(F.col(order), F.lit(block)))
    sizes = blocked.groupBy(batch, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    in_batch = W.partitionBy(batch)
    shifts = sizes.select(
        batch,
        "_block",
        (
            F.sum("_rows").over(in_batch.orderBy("_block")) - F.col("_rows")
        ).alias("_before"),
        F.sum("_rows").over(in_batch).alias("total"),
    )
    within = F.row_number().over(W.partitionBy(batch, "_block").orderBy(order))
    placed = blocked.withColumn("_at", within).join(shifts, [batch, "_block"])
    return (
        placed.withColumn("position", F.col("_at") + F.col("_before"))
        .withColumn("progress", F.round(F.col("position") / F.col("total"), 6))
        .drop("_block", "_at", "_before")
    )
