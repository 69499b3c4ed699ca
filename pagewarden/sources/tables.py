"""Stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table; `partitions` deals its rows out, for texts in few large files.

    Texts are costly to work on for their size, so a table in one file would keep one
    core busy and the others waiting. Only the caller knows what the shuffle is worth.
    """
    scanned = spark.read.parquet(path)
    return scanned.repartition(partitions) if partitions else scanned
