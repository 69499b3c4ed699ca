"""Dropping lines that many documents share, with DataFrame functions only.

Lines become hashes with their document and position. The hashes are partitioned by
range and sorted by hash, document and position, so a line that a third of all
documents hold spreads over as many tasks as it needs, in order, and a document's
first occurrence of a hash is met as the rows stream by. Counts of documents are
added up before the one small shuffle by hash. What comes back to a document is no
text but a bitmap of its dropped lines, of which only the 64-bit words with a drop
are kept.

Null and empty texts are one empty line. Rows without an id count for nothing and lose
nothing. Repeated rows of an id are one document. Other columns play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewarden.llm.arrays import SPACES
from pagewarden.llm.links import written
from pagewarden.llm.names import others, own

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    # The same for ASCII, and faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _spots(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, row, word, mask, first): keyed lines by document, 64 positions at a time.

    `first` marks where the stream of rows meets a hash in a document for the first time.
    """
    lines = docs.select("doc_id", "row", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keyed = lines.where(F.length("line") >= least_chars).withColumn("key", line_key(F.col("line")))
    hashed = keyed.where(F.length("key") >= least_chars).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        "doc_id",
        "row",
        "at",
    )
    # Texts are read once: drawing the ranges then looks at hashes only.
    ordered = (
        written(hashed, "line-hashes")
        .repartitionByRange("h1", "h2", "doc_id")
        .sortWithinPartitions("h1", "h2", "doc_id", "row", "at")
    )
    # Within the ranges already: nothing of this is shuffled again.
    words = ordered.groupBy("h1", "h2", "doc_id", "row", F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("mask")
    )
    met = W.partitionBy("h1", "h2", "doc_id").orderBy("row", "word")
    return written(words.withColumn("first", F.row_number().over(met) == 1), "line-spots")


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("row")
    )


def drop_bitmaps(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """(doc_id, row, drops): for documents that lose lines, which.

    `row` tells texts of one id apart. `drops` maps a word number to 64 bits, lowest
    first; bit b of word w is set if line 64 w + b goes. Words without a drop are absent.
    """
    spots = _spots(_identified(docs, doc_id, text).where(F.col("doc_id").isNotNull()), least_chars)
    shared = (
        spots.where("first")
        .groupBy("h1", "h2")
        .agg(F.count("doc_id").alias("holders"), F.max("doc_id").alias("keeper"))
        .where(F.col("holders") >= least_documents)
        .drop("holders")
    )
    # Written, so that the join may split a line that much of the data shares.
    shared = written(shared, "shared-lines")
    gone = spots.join(shared, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    words = gone.groupBy("doc_id", "row", "word").agg(F.bit_or("mask").alias("mask"))
    return words.groupBy("doc_id", "row").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "mask")))).alias("drops")
    )


def drop_shared_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """All rows and columns, `text` without its dropped lines, with (n_lines, n_dropped).

    `n_lines` counts before dropping. Texts that lose nothing stay as they are, null
    included. Columns named like the two counts are replaced.
    """
    rest = others(docs, "n_lines", "n_dropped")
    mine, theirs, whose, row, drops, bits = own(docs, "mine", "theirs", "whose", "row", "drops", "bits")
    bitmaps = drop_bitmaps(docs, doc_id, text, least_chars, least_documents).select(
        F.col("doc_id").alias(whose), F.col("row").alias(theirs), F.col("drops").alias(drops)
    )
    marked = docs.select(*rest, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(mine))
    joined = marked.join(
        bitmaps, (F.col(doc_id) == F.col(whose)) & (F.col(mine) == F.col(theirs)), "left"
    )
    lines = lines_of(F.col(text))
    loses = F.col(drops).isNotNull()
    # A word for every 64 lines, those that are absent as zero.
    dense = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.size(lines) - 1) / 64)),
        lambda word: F.coalesce(F.try_element_at(drops, word), F.lit(0).cast("bigint")),
    )
    kept = F.filter(
        lines,
        lambda line, at: F.shiftrightunsigned(F.get(F.col(bits), (at / 64).cast("int")), 0)
        .bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 64))
        == 0,
    )
    return (
        joined.withColumn(bits, F.when(loses, dense))
        .withColumn(row, F.when(loses, kept))
        .select(
            *[
                F.coalesce(F.array_join(row, "\n"), F.col(text)).alias(text) if name == f"`{text}`" else name
                for name in rest
            ],
            F.size(lines).cast("bigint").alias("n_lines"),
            F.coalesce(F.size(lines) - F.size(row), F.lit(0)).cast("bigint").alias("n_dropped"),
        )
    )
