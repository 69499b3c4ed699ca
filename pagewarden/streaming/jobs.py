"""Message gate, background ingestion, transcript and session counters on streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pagewarden.constants import DEFAULT_THRESHOLD
from pagewarden.functions.phrases import PhraseList
from pagewarden.functions.pii import RULES, Rule
from pagewarden.operators.index import PageIndex
from pagewarden.operators.screening import gate_messages
from pagewarden.plans.chat import converse
from pagewarden.plans.ingest import ingest


def transcript_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    threshold: float = DEFAULT_THRESHOLD,
    partitions: int | None = None,
    rules: Iterable[Rule | PhraseList] = RULES,
) -> DataStreamWriter:
    """Gated messages as a growing transcript, one folder per role.

    No state, and no shuffle unless `partitions` asks to deal the messages out;
    the file sink writes each message once.
    """
    dealt = messages.repartition(partitions) if partitions else messages
    return (
        gate_messages(dealt, threshold, rules=list(rules))
        .writeStream.format("parquet")
        .partitionBy("role")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def chat_stream(
    messages: DataFrame, index: PageIndex, path: str, checkpoint: str, **options
) -> DataStreamWriter:
    """Messages gated and answered as they arrive; the transcript grows a step per batch.

    A batch is answered from the index as it stands then. Repeated, it overwrites
    its own step. Steps of a lost checkpoint stay beside those of the new one; read the
    transcript back with `transcript`, which has each message once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # Read for the gate, the questions and the answers.
        batch.persist()
        try:
            rows = converse(batch, index.read(), **options)
            rows.write.mode("overwrite").partitionBy("role").parquet(f"{path}/step={origin}-{batch_id}")
        finally:
            batch.unpersist()

    origin = stream_origin(messages.sparkSession, checkpoint)
    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `chat_stream` wrote, each message's from the latest step that holds it.

    A step that was written again after its checkpoint was lost replaces the older one
    message by message: rows of one message and step belong together.
    """
    rows = spark.read.parquet(path).withColumn("_written", F.col("_metadata.file_modification_time"))
    latest = rows.groupBy("message_id").agg(F.max(F.struct("_written", "step")).alias("_latest"))
    kept = rows.join(latest.withColumnRenamed("message_id", "_of"), F.col("message_id") == F.col("_of"))
    return kept.where(F.col("step") == F.col("_latest.step")).select("message_id", "role", "content")


def batch_sizes(query: StreamingQuery) -> list[int]:
    """Rows taken in by each of the latest micro-batches."""
    return [step["numInputRows"] for step in query.recentProgress]


def stream_origin(spark: SparkSession, checkpoint: str) -> str:
    """A name for the batches of one checkpoint, kept beside it.

    The numbers of batches start anew with every checkpoint; the name keeps batches of
    two streams, or of a stream that lost its checkpoint, from overwriting each other.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/origin")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in (system.listStatus(place) if system.exists(place) else [])]
    if found:
        return found[0]
    name = uuid.uuid4().hex
    system.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(place, name))
    return name


def ingest_stream(
    files: DataFrame,
    index: PageIndex,
    checkpoint: str,
    name: str = "uploads",
    partitions: int | None = None,
    replace: bool = True,
    **options,
) -> DataStreamWriter:
    """Index arriving files. A repeated micro-batch overwrites its own records.

    A file that arrives again, in this stream or another or after the checkpoint was
    lost, replaces its earlier records, unless `replace` is off.

    `partitions` deals the rows of each micro-batch out first, for streams whose
    rows come in few large files.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.repartition(partitions) if partitions else batch
        ingest(dealt, index, batch_id=f"{name}-{origin}-{batch_id}", replace=replace, **options)

    origin = stream_origin(files.sparkSession, checkpoint)
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def session_counts(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """Running message count per session."""
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("n_messages"))


def session_stream(
    messages: DataFrame, path: str, checkpoint: str, session: str = "conv_id"
) -> DataStreamWriter:
    """Counters as a table of changes: each micro-batch writes the sessions it touched.

    The state is one number per session. Read it back with `latest_counts`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/step={origin}-{batch_id}")

    origin = stream_origin(messages.sparkSession, checkpoint)
    return (
        session_counts(messages, session)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )


def latest_counts(changes: DataFrame, session: str = "conv_id") -> DataFrame:
    """Counts as they stand: a count only grows, so the highest is the latest."""
    return changes.groupBy(session).agg(F.max("n_messages").alias("n_messages"))
