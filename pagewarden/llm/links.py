"""Connected components of links, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.session import drop_path, fresh_path


def stored(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, its lineage cut; and where it lies."""
    path = fresh_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: worked out once, its lineage cut."""
    return stored(frame, label)[0]


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("u"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all ids that a link names; the component is its smallest id.

    Every round hangs the larger neighbours of an id on its smallest one, then its
    smaller ones on the least of them. Links only ever get shorter and fewer, and after
    a number of rounds like the logarithm of the longest path they are stars. A hub's
    links are never gathered: its least neighbour is an aggregate, and the join back
    may split the hub's rows over tasks.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    links, path = stored(links.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "links")
    before = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select(
            F.col("u").alias("w"), F.least("u", "least").alias("least")
        )
        far = (
            both.join(least, F.col("u") == F.col("w"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
        lower = far.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "w")
        hung = far.join(lower, F.col("u") == F.col("w"))
        # A link from u to v also is the chance to hang v on u's least neighbour.
        near = hung.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("least").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                )
            ).alias("link")
        ).select("link.*")
        links, then = stored(near.where("u <> v").distinct(), "links")
        drop_path(links.sparkSession, path)
        path, after = then, _state(links)
        if after == before:
            break
        before = after
    roots = links.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
