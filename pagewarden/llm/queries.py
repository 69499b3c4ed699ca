"""The numbered queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import bands, bpe, html, language, lines, minhash, mixing, packing, pii, polytope, prefixes, spelling, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, vocabulary(), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.learn(docs)).drop("text")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.link(table(spark, sf_dir, "embeddings"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    trees = html.train(html.sample(pages))
    return html.extract(pages, trees).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_shared_lines(docs).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP8_SQL = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


# The unsigned crc32 of UTF-8 `s`, from rows of `s` and a list `t` of the remainders of all bytes.
REMAINDERS_SQL = """
SELECT list(t ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t
    FROM (SELECT unnest(range(256)) AS b))
"""
CRC32_SQL = """
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(s)) + 1),
    lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.numbered(table(spark, sf_dir, "conversations"))
    return prefixes.trie(*prefixes.regrafted(turns))


OP11_SQL = f"""
WITH remainders AS ({REMAINDERS_SQL}),
turns AS (
    SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, conv_id - conv_id % 100 AS head, CAST(conv_id AS VARCHAR) AS s, list(said ORDER BY pos) AS turns
    FROM turns GROUP BY conv_id
), hashed AS (
    SELECT conv_id, head, turns, {CRC32_SQL} % 6 AS h FROM own, remainders
), built AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
    FROM hashed a LEFT JOIN own b ON a.head = b.conv_id
), prefixes AS (
    SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM built
), members AS (
    SELECT conv_id, depth, turns[1:depth] AS prefix, turns[1:depth - 1] AS above, len(turns) = depth AS ended,
           CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars
    FROM prefixes
), nodes AS (
    SELECT depth, prefix, any_value(above) AS above, any_value(chars) AS chars, min(conv_id) AS conv_id,
           count(*) AS n_convs, bool_and(ended) AS childless,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends
    FROM members GROUP BY depth, prefix
), children AS (
    SELECT depth - 1 AS depth, above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY depth, above
), below AS (
    SELECT m.depth, m.prefix, sum(CAST(n.childless AS INT)) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
    FROM members m JOIN nodes n ON n.conv_id = m.conv_id AND n.depth >= m.depth GROUP BY m.depth, m.prefix
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b ON n.depth = b.depth AND n.prefix = b.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.above
LEFT JOIN children c ON c.depth = n.depth AND c.above = n.prefix
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = f"""
WITH RECURSIVE remainders AS ({REMAINDERS_SQL}),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), counted AS (
    SELECT run, id || ':' || run AS s, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY id, run
), hashed AS (
    SELECT run, times, {CRC32_SQL} AS h FROM counted, remainders
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END
           AS word, CAST(sum(times) AS BIGINT) AS n
    FROM hashed GROUP BY word HAVING sum(times) >= 3 AND length(word) >= 5
), less AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
    UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, {{'less': -n, 'near': near}}) AS best
    FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * w.n THEN b.best END AS form,
           CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), up AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON up.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM forms f JOIN up ON f.word = up.word
JOIN forms r ON r.word = up.root WHERE r.form IS NULL
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    # Only digests of the ids go on.
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_embedding_duplicates": op5_embedding_duplicates,
    "op6_compression_bands": op6_compression_bands,
    "op7_main_text": op7_main_text,
    "op8_line_dedup": op8_line_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_language": op10_language,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_packing": op13_packing,
}

SQL = {"op8_line_dedup": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_spelling_variants": OP12_SQL}
