"""EMB-1 / EMB-2: hashed n-gram vectors and metric query vectors.

A chunk's vector is sparse: (bucket, tf) rows with the chunk's squared norm.
Tokens are the chunk's words (letters and digits only, lower-cased) plus the
character bigrams inside each word, so CJK text without blanks still matches.
The bucket is the first 32 bits of the token's md5 modulo ``dim``; the same
expression exists in DuckDB, which keeps the oracle exact.

Plan shape: the chunk rows (not the much larger token rows) are hash
partitioned on the chunk key once, so a long document's chunks spread over
many tasks. Tokens and their buckets are computed by JVM expressions as one
array per chunk (no row per token); counting buckets per chunk is a numpy
step per Arrow batch, so the term table needs no aggregate or window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.functions.sparse import TokenHasher, term_rows

# --- Fixed values ------------------------------------------------------------------
DEFAULT_DIM = 4096
QUERY_TEMPLATE = "尋找關於 %s 的資訊"   # metric name -> search text
# ---------------------------------------------------------------------------------


def _clean_words(text: Column) -> Column:
    """Words of blank-separated text, lower-cased, letters and digits only.

    Dropping everything but letters, digits and blanks from the whole text and
    then splitting on blanks equals cleaning word by word, because words hold
    no blanks.
    """
    cleaned = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N} ]+", ""))
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def tokens_col(text: Column, char_ngrams: bool = True) -> Column:
    """ARRAY<STRING> of tokens: 'w:'+word and 'b:'+bigram (bigrams inside words)."""
    words = F.transform(_clean_words(text), lambda w: F.concat(F.lit("w:"), w))
    if not char_ngrams:
        return words
    return F.concat(words, F.transform(_bigrams(text), lambda g: F.concat(F.lit("b:"), g)))


def _bigrams(text: Column) -> Column:
    # Every position followed by two non-blank characters starts a bigram: one
    # linear scan of the cleaned text instead of a loop per word.
    cleaned = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N} ]+", ""))
    return F.regexp_extract_all(cleaned, F.lit("(?=([^ ]{2}))"), 1)


def bucket_col(token: Column, dim: int = DEFAULT_DIM) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def hash_embed(chunks: DataFrame, key_cols=("document_id", "chunk_index"), text_col: str = "text",
               dim: int = DEFAULT_DIM, char_ngrams: bool = True,
               prepartitioned: bool = False) -> DataFrame:
    """(keys, bucket BIGINT, tf BIGINT, norm2 BIGINT) — one row per non-zero bucket.

    Whitespace in chunk text is single blanks (chunks are words joined by one
    blank); other text is split on blanks the same way. ``prepartitioned``:
    the rows are already hash-partitioned on the keys (``partition_chunks``).
    Tokenising, hashing and counting run per Arrow batch (``TokenHasher``).
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    src = chunks.select(*keys, text_col)
    if not prepartitioned:
        from docmetrics.operators.chunk import partition_chunks
        src = partition_chunks(src, keys)
    key_fields = [f for f in src.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("bucket", T.LongType()),
                                        T.StructField("tf", T.LongType()),
                                        T.StructField("norm2", T.LongType())])

    def count(batches):
        hasher = TokenHasher(dim, char_ngrams)
        for batch in batches:
            yield from term_rows(batch, keys, hasher, text_col)

    return src.mapInArrow(count, schema)


def hash_embed_sql_form(chunks: DataFrame, key_cols=("document_id", "chunk_index"),
                        text_col: str = "text", dim: int = DEFAULT_DIM,
                        char_ngrams: bool = True) -> DataFrame:
    """EMB-1 with DataFrame operators only (explode, count per bucket, norm window).

    Same rows as ``hash_embed``; kept as the plain relational form and used by
    tests to cross-check the Python tokeniser and numpy counting. (Measured at
    sf0.1: its interpreted per-token lambdas cost ~9 s against ~2 s for the
    Arrow-batch form.)
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    from docmetrics.operators.chunk import partition_chunks
    src = partition_chunks(chunks.select(*keys, text_col), keys)
    terms = (src.select(*keys, F.explode(tokens_col(F.col(text_col), char_ngrams)).alias("tok"))
             .groupBy(*keys, bucket_col(F.col("tok"), dim).alias("bucket"))
             .agg(F.count(F.lit(1)).alias("tf")))
    w = Window.partitionBy(*keys)
    return terms.withColumn("norm2", F.sum(F.col("tf") * F.col("tf")).over(w))


def query_texts_from_catalog(spark, catalog) -> DataFrame:
    """EMB-2: one search text per metric: the template filled with the metric name."""
    from docmetrics.catalog import catalog_array
    return (spark.range(1).select(F.inline(catalog_array(catalog)))
            .select(F.col("metric_id").alias("query_id"),
                    F.format_string(QUERY_TEMPLATE, F.col("name")).alias("text")))


def query_vectors(queries: DataFrame, id_col: str = "query_id", text_col: str = "text",
                  dim: int = DEFAULT_DIM, char_ngrams: bool = True) -> DataFrame:
    """(query_id, bucket, tf, norm2) for a small query table.

    Queries are words joined by arbitrary whitespace; they are normalised to
    single blanks first so they tokenise like chunks.
    """
    q = queries.select(F.col(id_col).alias("query_id"),
                       F.regexp_replace(F.col(text_col), r"[ \t\n\x0B\f\r]+", " ").alias("text"))
    return hash_embed(q, ["query_id"], "text", dim, char_ngrams)
