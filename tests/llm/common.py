"""Odd tables that every operator must take."""

from pyspark.sql import types as T

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "word " * 3000,
    "x" * 20000,
    "Ein Satz mit Ümläuten und ß, dazu 漢字 und 🙂.\nZweite Zeile\r\n",
    "same text here, twice over and over, twice over and over",
    "same text here, twice over and over, twice over and over",
    "\x00\x01 control \x1f \x85   marks",
]

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None if n % 5 == 4 else f"src{n % 3}", None) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Null and repeated ids among odd texts."""
    texts = [*ODD_TEXTS, *ODD_TEXTS[4:9], "no id"]
    ids = [*range(len(ODD_TEXTS)), *range(4, 9), None]
    return documents(spark, texts, ids)


def clashing(frame, *names):
    """The same rows with extra columns of these names."""
    from pyspark.sql import functions as F

    for name in names:
        frame = frame.withColumn(name, F.lit(f"extra {name}"))
    return frame
