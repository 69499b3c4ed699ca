"""Page cutting, page text, tokens and hashed token vectors."""

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.constants import LINES_PER_PAGE, PLACEHOLDER_CONTENT, VECTOR_DIM
from pagewarden.schema import SPARSE_VECTOR
from pagewarden.session import bound_batches

# Bytes of text that are cut into tokens at a time; a longer text goes alone.
TOKEN_BYTES = 2 << 20
# Tokens whose number a worker keeps.
KNOWN_TOKENS = 1 << 16


def page_texts(lines: str, lines_per_page: int = LINES_PER_PAGE) -> Column:
    """Array of page texts: runs of `lines_per_page` lines, the last one shorter.

    Takes the name of a column that holds the lines, not an expression, which
    would be worked out again for every page.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_page).cast("int"))
    return F.transform(
        starts,
        lambda i: F.array_join(F.slice(lines, i * lines_per_page + 1, lines_per_page), "\n"),
    )


def with_markup_text(df: DataFrame, html: str, name: str = "text") -> DataFrame:
    """Add the readable text of raw web pages. Character entities stay as they are.

    Code is looked for up to the last closing tag, and tags up to the last `>`:
    beyond, every opening would be followed to the end of the page for nothing.
    """
    up_to_code_end = F.regexp_extract(html, r"(?is)^.*</(?:script|style|nav)>", 0)
    staged = df.withColumn("_code", up_to_code_end)
    after = F.substr(F.col(html), F.length("_code") + 1)
    no_code = F.regexp_replace(
        "_code", r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " "
    )
    staged = staged.withColumn("_plain", F.concat(no_code, after))
    staged = staged.withColumn("_end", F.substring_index("_plain", ">", -1))
    tagged = F.left("_plain", F.length("_plain") - F.length("_end"))
    no_tags = F.concat(F.regexp_replace(tagged, r"(?s)<[^>]+>", " "), F.col("_end"))
    text = F.trim(F.regexp_replace(no_tags, r"\s+", " "))
    return staged.withColumn("_text", text).drop("_code", "_plain", "_end").withColumnRenamed(
        "_text", name
    )


def collapse_space(text: Column) -> Column:
    """The whole text with every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def or_placeholder(content: Column) -> Column:
    """Null and empty content becomes a fixed text; blanks count as content."""
    return F.coalesce(F.nullif(content, F.lit("")), F.lit(PLACEHOLDER_CONTENT))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


@lru_cache(KNOWN_TOKENS)
def _token_number(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def _token_counts(texts: pa.Array, dim: int) -> pa.Array:
    """Sparse vectors of a batch of lower-case texts, some `TOKEN_BYTES` of text at a time.

    The tokens of a text take many times its bytes, and a batch may hold any number of pages.
    """
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    parts, at = [], 0
    while at < len(texts):
        limit = ends[at] - sizes[at] + TOKEN_BYTES
        upto = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        parts.append(_counts_of_part(texts.slice(at, upto - at), dim))
        at = upto
    return pa.concat_arrays(parts) if parts else _counts_of_part(texts, dim)


def _counts_of_part(texts: pa.Array, dim: int) -> pa.Array:
    """Splitting, numbering of distinct tokens and counting run on whole arrays;
    Python sees each distinct token of the texts once, to hash it.
    """
    split = pc.split_pattern_regex(texts, "[^a-z0-9]+")
    numbered = split.flatten().dictionary_encode()
    buckets = np.array(
        [
            _token_number(token) % dim if token else -1
            for token in numbered.dictionary.to_pylist()
        ],
        dtype=np.int64,
    )
    bucket = buckets[numbered.indices.to_numpy()]
    sizes = split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(split)), sizes)
    is_token = bucket >= 0
    places, counts = np.unique(row[is_token] * dim + bucket[is_token], return_counts=True)
    ends = np.searchsorted(places, np.arange(len(split) + 1) * dim)
    offsets = pa.array(ends.astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(offsets, pa.array((places % dim).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
        ],
        names=["indices", "values"],
    )


def hashed_vector(text: Column, dim: int = VECTOR_DIM) -> Column:
    """Sparse vector of the token counts of a text.

    The place of a token is the number its MD5 begins with (32 bits), modulo
    `dim`. The vector is made inside the row: grouping exploded tokens would
    shuffle a row per distinct token of every page. An array function does it in
    a third of the time that nested array expressions take.
    """

    @F.arrow_udf(SPARSE_VECTOR)
    def count_tokens(texts: pa.Array) -> pa.Array:
        return _token_counts(texts, dim)

    return count_tokens(F.lower(text))


def with_hashed_vector(
    df: DataFrame, text: str, name: str = "text_embedding", dim: int = VECTOR_DIM
) -> DataFrame:
    """Add the sparse token-count vector of a text column."""
    bound_batches(df.sparkSession)
    return df.withColumn(name, hashed_vector(F.col(text), dim))


def vector_entries(df: DataFrame, keys: list[str], vector: str = "text_embedding") -> DataFrame:
    """One row (keys, bucket, w) for every place of a sparse vector that is not zero."""
    zipped = F.arrays_zip(
        F.col(f"{vector}.indices").alias("bucket"), F.col(f"{vector}.values").alias("w")
    )
    return df.select(*keys, F.inline(zipped)).toDF(*keys, "bucket", "w")


def zero_vector(dim: int = VECTOR_DIM) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def or_zero_vector(vector: Column, dim: int = VECTOR_DIM) -> Column:
    """A missing or empty dense vector becomes all zeros."""
    return F.when(F.size(F.coalesce(vector, F.array().cast("array<float>"))) > 0, vector).otherwise(
        zero_vector(dim)
    )


def shares_token(path: Column, wanted: str | Column) -> Column:
    """True where a path has any token in common with the wanted text."""
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return F.arrays_overlap(tokens(path), tokens(wanted))
