"""Inverted-file search: vectors are kept in cells, a question looks into the nearest few.

Approximate by choice of `n_probe`; with every cell probed the search is the exact one.

`CellIndex` stores vectors by cell: each in its best and in its second cell, so that one
near a border is found from both sides, and rows sorted by cell, so that a search reads
only the row groups of the cells that some question probes. What is read is scored
exactly. A page index keeps one cell of each record when its embedder ends with
`place_in_cells`; records without a cell are compared with every question.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.constants import DEFAULT_K, VECTOR_DIM
from pagewarden.operators.search import MATRIX_CELLS, _matrix, nearest, pinned

# Cells that each vector is kept in.
HOMES = 2
# Bytes of a row group: the least that a search reads of a cell, about.
GROUP_BYTES = 4 << 20
# Vectors that one task holds while cells are learnt.
TRAIN_ROWS = 8192
# Probes (a question and a cell) that are worked out once and held; of more the planner decides.
PROBE_LIMIT = 1_000_000


def _features(vector: str, dim: int) -> Column:
    """Sparse vectors as those of the ML library, which hold their entries only."""

    @F.arrow_udf(VectorUDT())
    def pack(vectors: pa.Array) -> pa.Array:
        indices, values = vectors.field("indices"), vectors.field("values")
        rows = np.repeat(np.arange(len(vectors)), indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        places = rows * dim + indices.flatten().to_numpy(zero_copy_only=False)
        # In order, each place once; the last entry of a place counts.
        places, last = np.unique(places[::-1], return_index=True)
        weights = values.flatten().to_numpy(zero_copy_only=False)[::-1][last].astype(np.float64)
        ends = pa.array(np.searchsorted(places, np.arange(len(vectors) + 1) * dim).astype(np.int32))
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(len(vectors), np.int8)),
                pa.array(np.full(len(vectors), dim, np.int32)),
                pa.ListArray.from_arrays(ends, pa.array((places % dim).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(weights)),
            ],
            names=["type", "size", "indices", "values"],
        )

    return pack(F.col(vector))


def train_cells(
    vectors: DataFrame,
    n_cells: int,
    vector: str = "embedding",
    dim: int = VECTOR_DIM,
    seed: int = 7,
    iterations: int = 10,
) -> np.ndarray:
    """Unit centres of `n_cells` cells, as rows, learnt from all vectors.

    Vectors that are zero or hold elements that are null or not finite are left out.

    `dim` is needed for sparse vectors only.
    """
    sparse = isinstance(vectors.schema[vector].dataType, T.StructType)
    weights = F.col(f"{vector}.values") if sparse else F.col(vector)
    sound = F.exists(weights, lambda x: x != 0) & F.forall(weights, lambda x: F.abs(x) < float("inf"))
    usable = vectors.where(sound).select(vector)
    # Each task holds its rows through all passes, so they are dealt out in bounded numbers.
    n, cores = usable.count(), vectors.sparkSession.sparkContext.defaultParallelism
    usable = usable.repartition(max(1, -(-n // TRAIN_ROWS), min(cores, n // 1000)))
    features = _features(vector, dim) if sparse else array_to_vector(vector)
    usable = usable.select(features.alias("features"))
    model = KMeans(
        k=n_cells, seed=seed, maxIter=iterations, distanceMeasure="cosine", initMode="k-means||"
    ).fit(usable)
    centres = np.vstack(model.clusterCenters())
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres / np.where(lengths > 0, lengths, 1.0)


def _nearest_cells(centres: np.ndarray, n: int):
    """Array function: the `n` cells whose centres point most nearly the same way, nearest first."""
    n_cells, dim = centres.shape
    n, step = min(n, n_cells), max(64, MATRIX_CELLS // max(n_cells, dim))

    @F.arrow_udf("array<int>")
    def place(batch: pa.Array) -> pa.Array:
        cells = [np.zeros((0, n), np.int32)]
        for at in range(0, len(batch), step):
            close = _matrix(batch.slice(at, step), dim) @ centres.T
            cells.append(np.argsort(-close, axis=1, kind="stable")[:, :n])
        cells = np.concatenate(cells).astype(np.int32)
        ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * n)
        return pa.ListArray.from_arrays(ends, pa.array(cells.ravel()))

    return place


def place_in_cells(
    vectors: DataFrame, centres: np.ndarray, vector: str = "embedding", cell: str = "cell"
) -> DataFrame:
    """Adds the cell whose centre points most nearly the same way; the first of equals."""
    return vectors.withColumn(cell, F.get(_nearest_cells(centres, 1)(F.col(vector)), F.lit(0)))


def write_centres(spark: SparkSession, centres: np.ndarray, path: str) -> None:
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").write.parquet(path)


def read_centres(spark: SparkSession, path: str) -> np.ndarray:
    """Centres as `write_centres` wrote them: as many rows as there are cells."""
    return np.array([row["centre"] for row in spark.read.parquet(path).orderBy("cell").collect()])


def cell_visits(
    questions: DataFrame,
    centres: np.ndarray,
    n_probe: int,
    question_id: str = "question_id",
    question_vector: str = "question_embedding",
    cell: str = "cell",
) -> DataFrame:
    """The `n_probe` nearest cells of each question: (question_id, cell)."""
    near = _nearest_cells(centres, n_probe)(F.col(question_vector))
    return questions.select(question_id, F.explode(near).alias(cell))


class CellIndex:
    """Vectors by cell, below a path: `version=<n>/centres` and `version=<n>/cells`.

    `kept` names the columns that stay with a vector: its ids, and the tenant if searches
    go by tenants. A version counts once its cells stand; the latest is read.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        ids: list[str],
        vector: str = "embedding",
        tenant: str | None = None,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.ids, self.vector, self.tenant = ids, vector, tenant

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/cells/_SUCCESS")
        system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [status.getPath().toString() for status in system.globStatus(pattern) or []]
        return sorted(int(place.split("/version=")[-1].split("/")[0]) for place in found)

    def build(self, vectors: DataFrame, centres: np.ndarray, homes: int = HOMES, group_bytes: int = GROUP_BYTES) -> int:
        """Write all vectors into their `homes` nearest cells; returns the version.

        Rows go to tasks by ranges of cell and id, so a cell that holds much of the data
        is shared by several.
        """
        version = max(self._versions(), default=0) + 1
        place = f"{self.path}/version={version}"
        write_centres(self.spark, centres, f"{place}/centres")
        kept = [*self.ids, *([self.tenant] if self.tenant and self.tenant not in self.ids else [])]
        cells = _nearest_cells(centres, homes)(F.col(self.vector))
        rows = vectors.select(*kept, self.vector, cells.alias("_homes"))
        rows = rows.select(*kept, self.vector, F.explode("_homes").alias("cell"))
        order = ["cell", *self.ids]
        (
            rows.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.option("parquet.block.size", group_bytes)
            .parquet(f"{place}/cells")
        )
        return version

    def read(self) -> tuple[DataFrame, np.ndarray]:
        """Rows by cell, and the centres, of the latest version."""
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no cells at {self.path}")
        place = f"{self.path}/version={versions[-1]}"
        return self.spark.read.parquet(f"{place}/cells"), read_centres(self.spark, f"{place}/centres")

    def nearest(
        self,
        questions: DataFrame,
        k: int = DEFAULT_K,
        n_probe: int = 8,
        *,
        visits: DataFrame | None = None,
        question_id: str = "question_id",
        question_vector: str = "question_embedding",
        metric: str = "cosine",
        homes: int = HOMES,
    ) -> DataFrame:
        """Best k vectors of the probed cells: (question_id, rank, ids…, score).

        With `visits` (question_id, tenant) a question sees the vectors of its tenants only.
        """
        rows, centres = self.read()
        probes = cell_visits(questions, centres, n_probe, question_id, question_vector, "_probe")
        probes, _ = pinned(probes, PROBE_LIMIT)
        # At most as many as there are cells; the filter reaches the row groups.
        probed = [row[0] for row in probes.select("_probe").distinct().collect()]
        rows = rows.where(F.col("cell").isin(probed))
        cell = F.col("cell")
        if visits is not None:
            tenants = visits.select(F.col(question_id).alias("_of"), F.col(self.tenant).cast("string").alias("_tenant"))
            probes = probes.join(tenants, F.col(question_id) == F.col("_of"))
            probes = probes.select(question_id, F.concat_ws("/", "_probe", "_tenant").alias("_visit"))
            cell = F.concat_ws("/", "cell", F.col(self.tenant).cast("string"))
        else:
            probes = probes.select(question_id, F.col("_probe").alias("_visit"))
        # A vector comes from each of its homes that is probed, so at most `homes` times.
        hits = nearest(
            rows.withColumn("_visit", cell),
            questions,
            k * homes,
            ids=self.ids,
            vector=self.vector,
            question_id=question_id,
            question_vector=question_vector,
            dim=centres.shape[1],
            metric=metric,
            cell="_visit",
            visits=probes,
        )
        once = hits.groupBy(question_id, *self.ids).agg(F.max("score").alias("score"))
        best = W.partitionBy(question_id).orderBy(F.desc("score"), *map(F.asc, self.ids))
        ranked = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select(question_id, "rank", *self.ids, "score")
