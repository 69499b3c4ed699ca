"""Record shapes."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("entity_group", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("unique_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("page_number", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

# A text vector counts hashed tokens, so most of its places are zero.
SPARSE_VECTOR = T.StructType(
    [
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.IntegerType())),
    ]
)
DENSE_VECTOR = T.ArrayType(T.FloatType())

# Where a stored record stands: its file, and its row in that.
PLACE = ["record_file", "record_row"]
PAGE_KEY = ["unique_id", "file_path", "page_no"]


def index_record(vector: T.DataType = SPARSE_VECTOR) -> T.StructType:
    """Columns of one indexed page; `unique_id` is the partition column."""
    return T.StructType(
        [
            T.StructField("file_path", T.StringType()),
            T.StructField("page_no", T.IntegerType()),
            T.StructField("page_number", T.StringType()),
            T.StructField("llm_generated", T.StringType()),
            T.StructField("contains_pii", T.BooleanType()),
            T.StructField("model_id", T.StringType()),
            T.StructField("text_embedding", vector),
            T.StructField("cell", T.IntegerType()),
            T.StructField("unique_id", T.StringType()),
        ]
    )
