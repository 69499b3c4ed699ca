"""Session settings and the folder for tables that outlive one job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# A batch ends with the row that fills it, so one longer row is a batch of its own.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_roots: dict[str, str] = {}


def build_session(app: str = "pagewarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; every setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A batch of long texts must not outgrow a Python worker.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session may go without the setting: it gets a folder of its
    own, because driver and tasks then are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="pagewarden-")
    return _local_roots[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that `fresh_path` placed, once no plan reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to `BATCH_BYTES`, for whole texts go to Python.

    A task holds a batch in the executor and once more in the worker, beside what is
    worked out from it. A smaller setting of the session stays.
    """
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(_LIMIT).strip().lower()).groups()
    size = int(number) << 10 * " kmgt".index(unit or " ")
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
