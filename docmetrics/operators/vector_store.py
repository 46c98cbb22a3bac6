"""Stored chunk vectors that are searched again (EMB-1 dense and idf forms, SINK-1, KNN-1/2/3, JN-6, hits with text).

The table holds a row per chunk: document_id, chunk_index, text, metadata, embedding ARRAY<FLOAT>, norm DOUBLE.
It lies in ``part`` folders, a document's hash modulo ``parts``, sorted by document and chunk in each file. So

* scoring reads keys, embedding and norm only (the norm is not computed again), never texts;
* texts and metadata are fetched for the hits alone, by a join on (part, document, chunk) that prunes the part
  folders without hits at run time (dynamic partition pruning);
* a search within documents reads the folders of those documents only (static pruning by the parts of the
  query side, at most ``parts`` integers).

Embeddings are hashed term counts, optionally weighted by inverse document frequency in whole thousandths, so
every component, dot product and squared norm is a whole number and scores do not depend on summation order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.functions.sparse import TokenHasher, count_runs
from docmetrics.operators.idfilter import id_filter, may_be_in
from docmetrics.operators.knn import knn_dense

KEYS = ["document_id", "chunk_index"]
DENSE_DIM = 512
PARTS = 64
# Chunks of one document that stay in one file; a longer document's blocks go to several tasks.
BLOCK_CHUNKS = 256
# Hits that are broadcast to the fetch of their texts; more are joined by shuffle.
MAX_BROADCAST_HITS = 100_000
# Cells of the dense block that one slice of a batch may take.
CELLS = 500_000


STORE_SCHEMA = ("document_id string, chunk_index int, text string, metadata map<string,string>, embedding array<float>, "
                "norm double, part int")
STORE_COLUMNS = ["document_id", "chunk_index", "text", "metadata", "embedding", "norm"]


# --- embedding ---------------------------------------------------------------------------

def bucket_weights(chunks: DataFrame, dim: int = DENSE_DIM, char_ngrams: bool = True, text_col: str = "text") -> DataFrame:
    """(bucket, df, weight) for every bucket 0..dim-1: ``df`` chunks hold it; the weight is
    1 + ln((1 + chunks) / (1 + df)) in thousandths, rounded to a whole number.

    One pass with a count per bucket and task, so ``dim`` + 1 rows a task are shuffled."""

    def count(batches):
        hasher, df, rows = TokenHasher(dim, char_ngrams), np.zeros(dim, np.int64), 0
        for batch in batches:
            for _, _, (_, b, _, _) in count_runs(batch.column(text_col), hasher):
                df += np.bincount(b, minlength=dim)
            rows += batch.num_rows
        yield pa.record_batch([pa.array(np.arange(-1, dim)), pa.array(np.concatenate([[rows], df]))], names=["bucket", "df"])

    parts = chunks.select(text_col).mapInArrow(count, "bucket long, df long")
    every = chunks.sparkSession.range(-1, dim).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("df"))
    counts = parts.unionByName(every).groupBy("bucket").agg(F.sum("df").alias("df"))
    total = counts.where("bucket = -1").select(F.col("df").alias("_n"))  # one row
    weight = F.round(1000 * (1 + F.log((1 + F.col("_n")) / (1 + F.col("df")))), 0).cast("long")
    return counts.where("bucket >= 0").join(F.broadcast(total)).select("bucket", "df", weight.alias("weight"))


def weight_array(weights: DataFrame, dim: int = DENSE_DIM) -> np.ndarray:
    """The weights on the driver: ``dim`` numbers."""
    out = np.ones(dim, np.int64)
    for r in weights.select("bucket", "weight").collect():
        out[r["bucket"]] = r["weight"]
    return out


def dense_vectors(chunks: DataFrame, dim: int = DENSE_DIM, weights: np.ndarray | None = None, char_ngrams: bool = True,
                  text_col: str = "text") -> DataFrame:
    """All columns of ``chunks`` plus embedding ARRAY<FLOAT> and norm DOUBLE; NULL for a text without tokens.

    Runs in the stage that made the chunks; no exchange. ``weights`` (one per bucket) multiply the counts."""
    spark = chunks.sparkSession
    bc = spark.sparkContext.broadcast(None if weights is None else np.asarray(weights, np.float64))
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("norm", T.DoubleType())])

    def embed(batches):
        hasher, w = TokenHasher(dim, char_ngrams), bc.value
        step = max(1, CELLS // dim)
        pieces = (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step))
        for piece in pieces:
            for first, n, (r, b, tf, _) in count_runs(piece.column(text_col), hasher):
                batch = piece.slice(first, n)
                x = np.zeros((n, dim))
                x[r, b] = tf if w is None else tf * w[b]
                norm = np.sqrt((x * x).sum(axis=1))
                none = norm == 0
                offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, dim))]).astype(np.int32)
                mask = pa.array(np.append(none, False))
                flat = pa.array(x[~none].astype(np.float32).ravel())
                listed = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), flat,
                                                  mask=mask.slice(0, len(none)))
                yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(norm, mask=none)], names=[f.name for f in schema])

    return chunks.mapInArrow(embed, schema)


def query_embeddings(queries: DataFrame, dim: int = DENSE_DIM, weights: np.ndarray | None = None, char_ngrams: bool = True) -> DataFrame:
    """(query_id, qvec) of query texts (query_id, text), blanks normalised as in chunks; without tokens none."""
    q = queries.select("query_id", F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ").alias("text"))
    return dense_vectors(q, dim, weights, char_ngrams).where("embedding IS NOT NULL").select("query_id", F.col("embedding").alias("qvec"))


# --- table --------------------------------------------------------------------------------

def part_col(document_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(parts)).cast("int")


def store_vectors(vectors: DataFrame, path: str, parts: int = PARTS, mode: str = "append") -> None:
    """SINK-1/2: (document_id, chunk_index, text, metadata, embedding, norm) -> part folders under ``path``.

    Rows without a vector are left out (``batch_alignment`` reports them). One shuffle, by part and by block of
    ``BLOCK_CHUNKS`` chunks, so a document with a third of all chunks is written by many tasks. ``parts`` must
    stay the same over appends; choose it so that a folder holds some 100 MB to 1 GB."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    rows = vectors.where("embedding IS NOT NULL").select(*STORE_COLUMNS).withColumn("part", part_col(F.col("document_id"), parts))
    (rows.repartition(parts, "part", F.floor(F.col("chunk_index") / BLOCK_CHUNKS)).sortWithinPartitions("part", *KEYS)
     .write.mode(mode).partitionBy("part").parquet(path))


def open_vectors(spark: SparkSession, path: str, documents: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """The stored table, of all documents or of those in ``documents`` (document_id): only their folders are read.
    ``parts`` integers at most reach the driver."""
    table = spark.read.schema(STORE_SCHEMA).parquet(path)
    if documents is None:
        return table
    ids = documents.select("document_id").distinct()
    some = [r[0] for r in ids.select(part_col(F.col("document_id"), parts)).distinct().collect()]
    return table.where(F.col("part").isin(some)).join(ids, "document_id", "left_semi")


# --- search -------------------------------------------------------------------------------

def search_vectors(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, metric: str = "cosine", scope: str = "corpus",
                   parts: int = PARTS, fetch: bool = True) -> DataFrame:
    """The k nearest stored chunks of every query, exact: query_id, document_id, chunk_index, rank, distance, score
    and, with ``fetch``, the hit's text and metadata.

    ``queries``: (query_id, qvec), and document_id with ``scope='document'``, where a query sees the chunks of
    its own document only and the folders of other documents are not read."""
    if scope not in ("corpus", "document"):
        raise ValueError(f"unknown scope {scope!r}")
    within = queries.select("document_id") if scope == "document" else None
    scanned = spark.read.schema(STORE_SCHEMA).parquet(path)
    if within is not None:  # no semi-join: the kernel drops rows of documents without a query
        some = [r[0] for r in within.select(part_col(F.col("document_id"), parts)).distinct().collect()]
        scanned = scanned.where(F.col("part").isin(some))
    hits = knn_dense(scanned.select(*KEYS, "embedding", "norm"), queries, k, metric, key_cols=KEYS, norm_col="norm",
                     scope_col="document_id" if scope == "document" else None)
    hits = hits.select("query_id", *KEYS, "rank", "distance", "score")
    return fetch_hits(spark, path, hits, parts, max_hits=k * queries.count(), documents=within) if fetch else hits


def fetch_hits(spark: SparkSession, path: str, hits: DataFrame, parts: int = PARTS, max_hits: int | None = None,
               documents: DataFrame | None = None) -> DataFrame:
    """``hits`` with the text and metadata of their rows (D9); a hit whose row is gone drops out.

    The hits meet the table on (part, document, chunk): folders without hits are pruned at run time. ``documents``
    (document_id), if known, are those that can have hits: where hits are too many to be broadcast, no others' texts are shuffled."""
    table = spark.read.schema(STORE_SCHEMA).parquet(path).select("part", *KEYS, "text", "metadata")
    wanted = hits.withColumn("part", part_col(F.col("document_id"), parts)).where(F.col("rank") >= 1)
    if max_hits is not None and max_hits <= MAX_BROADCAST_HITS:
        wanted = F.broadcast(wanted)
    elif documents is not None:
        table = may_be_in(table, id_filter(documents, ["document_id"]), ["document_id"])
    return table.join(wanted, ["part", *KEYS]).select("query_id", *KEYS, "rank", "distance", "score", "text", "metadata")
