"""Model catalogue, and routing of requests by model name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.constants import (
    BEDROCK_MODELS,
    DEFAULT_MODEL_POSITION,
    DEFAULT_TEMPERATURE,
    FIXED_TEMPERATURE,
    OPENAI_MODELS,
)


def model_catalogue(spark: SparkSession) -> DataFrame:
    """All models in order: (position, model_id, provider, is_default)."""
    names = [(m, "bedrock") for m in BEDROCK_MODELS] + [(m, "openai") for m in OPENAI_MODELS]
    rows = [(i, m, p, i == DEFAULT_MODEL_POSITION) for i, (m, p) in enumerate(names)]
    return spark.createDataFrame(
        rows, "position int, model_id string, provider string, is_default boolean"
    )


# By what a call is for.
TEMPERATURES = {"describe": FIXED_TEMPERATURE, "answer": FIXED_TEMPERATURE, "chat": DEFAULT_TEMPERATURE}


def limit_key(model_id):
    """Name of the reply-length setting in the model's family."""
    camel = F.lower(model_id).contains("amazon") & ~F.lower(model_id).contains("anthropic")
    return F.when(camel, F.lit("maxTokenCount")).otherwise(F.lit("max_tokens"))


def model_settings(
    model_id, max_tokens: int | None = None, temperature: float | None = None, path: str = "chat"
):
    """Settings of a call as a map; the reply length under its family's name, if given.

    The temperature is that of the `path` (`TEMPERATURES`) unless one is given.
    """
    if temperature is None:
        temperature = TEMPERATURES[path]
    settings = F.create_map(F.lit("temperature"), F.lit(float(temperature)))
    if not max_tokens:
        return settings
    return F.map_concat(settings, F.create_map(limit_key(model_id), F.lit(float(max_tokens))))


def route(
    requests: DataFrame, catalogue: DataFrame, default_model: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Requests with provider and length setting, and those no provider takes.

    A request without a model takes the default, or is refused if there is none.
    The catalogue is a fixed list, so it is sent to the requests.
    """
    chosen = requests.withColumn(
        "model_id", F.coalesce("model_id", F.lit(default_model).cast("string"))
    )
    known = F.broadcast(catalogue.select("model_id", "provider"))
    joined = chosen.join(known, "model_id", "left")
    routed = joined.where("provider is not null").withColumn(
        "limit_key", limit_key(F.col("model_id"))
    )
    refused = joined.where("provider is null").drop("provider")
    missing = F.lit("Model ID must be provided")
    return routed, refused.withColumn(
        "error",
        F.when(F.col("model_id").isNull(), missing).otherwise(
            F.concat(F.lit("Unsupported model: "), F.col("model_id"))
        ),
    )
