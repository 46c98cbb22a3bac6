"""Exact k-nearest-neighbour search (JN-2, JN-6, KNN-1..4, TOPK-1, PRJ-3).

One plan at every size: the query side (metric questions, benchmark items, class centroids) is read in
blocks of bounded size, almost always one; each block is broadcast, and the chunk/vector side is streamed
past it and never shuffled for scoring. A task scores its Arrow batches with numpy and keeps a running
top k per query, given out once at its end, so no (query, chunk) pair rows exist; the final
``row_number() <= k`` (Catalyst's WindowGroupLimit, partial and final) ranks at most k rows per query
and task.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.functions.sparse import (
    QueryMatrix,
    RunningTopK,
    TokenHasher,
    contexts_of_lists,
    count_runs,
    dense_pairs_top_k,
    dense_score_batch,
    score_batch,
    score_batch_per_document,
)
from docmetrics.operators.idfilter import id_filter, may_be_in
from docmetrics.session import materialized

# Query vectors (or query texts) in one broadcast block: 50 MB at 1,536 wide.
MAX_BROADCAST_QUERIES = 4_096
# The same for the sparse form, in (query, bucket) rows.
MAX_BROADCAST_TERMS = 500_000
# Query numbers that one row of a scope's queries holds.
SCOPE_QUERIES = 256
# Longer query texts are hashed by Spark, not on the driver.
MAX_QUERY_TEXT = 16_384


def top_k(scored: DataFrame, partition_cols, order_cols, k: int, name: str = "rank") -> DataFrame:
    """TOPK-1: keep rank 1..k per partition; ties broken by the order columns."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return scored.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def _term_blocks(terms: DataFrame, bound: int):
    """(query_id, bucket, tf) rows in blocks of about ``bound``; a query's rows are in one block."""
    rows = terms.limit(bound + 1).collect()
    if len(rows) <= bound:
        yield rows
        return
    block = []
    for row in (terms.groupBy("query_id", "bucket").agg(F.sum("tf").alias("tf")).orderBy("query_id").toLocalIterator()):
        if len(block) >= bound and block[-1][0] != row[0]:
            yield block
            block = []
        block.append(row)
    yield block


def knn_sparse(chunks: DataFrame, query_terms: DataFrame, k: int = 3,
               key_cols=("document_id", "chunk_index"), scope: str = "corpus",
               dim: int | None = None, text_col: str = "text", char_ngrams: bool = True,
               max_broadcast: int = MAX_BROADCAST_TERMS, carry_cols=()) -> DataFrame:
    """KNN-4: exact cosine over hashed term vectors.

    ``chunks``: (keys, text); ``query_terms``: (query_id, bucket, tf) from ``query_vectors`` with the same
    ``dim``; rows of one query and bucket add up. ``scope='document'`` ranks per (query, document_id),
    which must be the first key. Query terms beyond ``max_broadcast`` rows are scored in several blocks,
    one scan of the chunks each. ``carry_cols`` are passed through to the hits.
    Output: query_id, keys, [carry], rank INT, dot, score, distance.
    """
    dim = dim or 4096
    parts = [_knn_sparse_scored(chunks, QueryMatrix.payload([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], dim),
                                k, list(key_cols), scope, dim, text_col, char_ngrams, tuple(carry_cols))
             for rows in _term_blocks(query_terms.select("query_id", "bucket", "tf"), max_broadcast)]
    return reduce(DataFrame.unionByName, parts)


def _short_texts(queries: DataFrame, max_queries: int) -> list | None:
    """(query_id, text) rows on the driver, or None if they are too many, or one is too long."""
    long = F.coalesce(F.length("text") > MAX_QUERY_TEXT, F.lit(False))
    rows = queries.select("query_id", F.when(~long, F.col("text")).alias("text"), long).limit(max_queries + 1).collect()
    return None if len(rows) > max_queries or any(r[2] for r in rows) else rows


def _hashed_texts(rows: list, dim: int, char_ngrams: bool):
    """Query texts hashed on the driver with the tokeniser of the chunks."""
    ws = re.compile(r"[ \t\n\x0b\f\r]+")
    texts = [None if r[1] is None else ws.sub(" ", r[1]) for r in rows]
    hasher = TokenHasher(dim, char_ngrams)
    at, b, tf = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, _, (r, bucket, n, _) in count_runs(pa.array(texts, type=pa.string()), hasher):
        at += (r + first).tolist()
        b.append(bucket)
        tf.append(n)
    return QueryMatrix.payload([rows[i][0] for i in at], np.concatenate(b), np.concatenate(tf), dim)


def knn_sparse_text(chunks: DataFrame, queries: DataFrame, k: int = 3,
                    key_cols=("document_id", "chunk_index"), scope: str = "corpus",
                    dim: int | None = None, text_col: str = "text", char_ngrams: bool = True,
                    max_queries: int = MAX_BROADCAST_QUERIES, carry_cols=()) -> DataFrame:
    """KNN-4 from query texts ``(query_id, text)``, same results as ``knn_sparse``.

    A few short texts are collected and hashed on the driver with the same tokeniser, instead of in a
    Spark job of their own; more than ``max_queries``, or one over ``MAX_QUERY_TEXT`` characters, become
    term rows in Spark.
    """
    dim = dim or 4096
    rows = _short_texts(queries, max_queries)
    if rows is None:
        from docmetrics.operators.embed import query_vectors
        return knn_sparse(chunks, query_vectors(queries, dim=dim, char_ngrams=char_ngrams), k,
                          key_cols, scope, dim, text_col, char_ngrams, carry_cols=carry_cols)
    return _knn_sparse_scored(chunks, _hashed_texts(rows, dim, char_ngrams), k, list(key_cols), scope, dim, text_col,
                              char_ngrams, tuple(carry_cols))


def document_contexts(lists: DataFrame, queries: DataFrame, k: int = 3, key_cols=("document_id",), dim: int | None = None,
                      char_ngrams: bool = True) -> DataFrame:
    """JN-6 + RAG-1: (keys, query_id, context), the texts of every document's k nearest chunks to each query, best first,
    joined by newlines; a query that shares no term with any chunk of the document has none.

    ``lists``: (keys, chunks ARRAY<STRING>) from ``chunk_lists``: a document's chunks are in its row, so its search and its
    contexts need no exchange at all. Queries are taken in blocks of ``MAX_BROADCAST_TERMS`` term rows."""
    from docmetrics.operators.embed import query_vectors

    dim = dim or 4096
    rows = _short_texts(queries, MAX_BROADCAST_QUERIES)
    payloads = [_hashed_texts(rows, dim, char_ngrams)] if rows is not None else [
        QueryMatrix.payload([r[0] for r in part], [r[1] for r in part], [r[2] for r in part], dim)
        for part in _term_blocks(query_vectors(queries, dim=dim, char_ngrams=char_ngrams).select("query_id", "bucket", "tf"), MAX_BROADCAST_TERMS)]
    keys = list(key_cols)
    schema = T.StructType([*(lists.schema[c] for c in keys), T.StructField("query_id", T.StringType()), T.StructField("context", T.StringType())])

    def part(payload) -> DataFrame:
        bc = lists.sparkSession.sparkContext.broadcast(payload)

        def contexts(batches):
            qm, hasher = QueryMatrix.from_payload(bc.value), TokenHasher(dim, char_ngrams)
            for batch in batches:
                for rows, of, text in contexts_of_lists(batch.column("chunks"), qm, k, hasher):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in keys), pa.array([qm.ids[i] for i in of], pa.string()),
                                                      pa.array(text, pa.string())], names=[f.name for f in schema])

        return lists.select(*keys, "chunks").mapInArrow(contexts, schema)

    return reduce(DataFrame.unionByName, map(part, payloads))


def _knn_sparse_scored(chunks, payload, k, keys, scope, dim, text_col, char_ngrams, carry=()):
    spark = chunks.sparkSession
    bc = spark.sparkContext.broadcast(payload)
    per_doc = scope == "document"
    key_fields = [chunks.schema[c] for c in (*keys, *carry)]
    schema = T.StructType([T.StructField("query_id", T.StringType())] + key_fields
                          + [T.StructField("dot", T.DoubleType()),
                             T.StructField("score", T.DoubleType())])

    def score(batches):
        qm = QueryMatrix.from_payload(bc.value)
        hasher = TokenHasher(dim, char_ngrams)
        top = RunningTopK(qm.ids, k, keys)
        for batch in batches:
            if not batch.num_rows or not qm.n:
                continue
            if per_doc:
                yield from score_batch_per_document(batch, keys, qm, k, hasher, text_col, carry)
            else:
                score_batch(batch, qm, top, hasher, text_col, carry)
        yield from top.batches((*keys, *carry, "dot"), "score")

    partial = chunks.select(*dict.fromkeys((*keys, *carry, text_col))).mapInArrow(score, schema)
    part = ["query_id"] + (["document_id"] if per_doc else [])
    order = [F.col("score").desc()] + [F.col(c) for c in keys]
    return (top_k(partial, part, order, k)
            .select("query_id", *keys, *carry, "rank", "dot", "score",
                    (F.lit(1.0) - F.col("score")).alias("distance")))


def knn_sparse_join(chunk_terms: DataFrame, query_terms: DataFrame, k: int = 3,
                    key_cols=("document_id", "chunk_index"), scope: str = "corpus") -> DataFrame:
    """KNN-4 as relational operators: the plain form that tests hold ``knn_sparse`` against.

    ``chunk_terms``: (keys, bucket, tf, norm2); ``query_terms``: (query_id, bucket, tf), where rows of one
    query and bucket add up. Equi-join on ``bucket``, sums per (query, chunk), then top-k.
    """
    keys = list(key_cols)
    q = query_terms.groupBy("query_id", "bucket").agg(F.sum("tf").alias("qtf"))
    q = q.join(q.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("qtf")).alias("qnorm2")), "query_id")
    scored = (chunk_terms.join(q, "bucket")
              .groupBy("query_id", *keys, "norm2", "qnorm2")
              .agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot")))
    score = F.col("dot") / (F.sqrt(F.col("qnorm2")) * F.sqrt(F.col("norm2")))
    scored = scored.select("query_id", *keys, F.col("dot").cast("double").alias("dot"),
                           score.alias("score"))
    part = ["query_id"] + (["document_id"] if scope == "document" else [])
    order = [F.col("score").desc()] + [F.col(c) for c in keys]
    return (top_k(scored, part, order, k)
            .select("query_id", *keys, "rank", "dot", "score",
                    (F.lit(1.0) - F.col("score")).alias("distance")))


def _dense_blocks(queries: DataFrame, bound: int, n_ids: int):
    """The query rows (ids..., vector) in blocks of at most ``bound``, in the order in which they are read.
    Equal rows are one query; different vectors of one id raise."""
    as_array = lambda r: (*r[:n_ids], None if r[n_ids] is None else
                          np.array([np.nan if x is None else x for x in r[n_ids]], dtype=np.float64))
    rows = queries.limit(bound + 1).collect()
    many = len(rows) > bound
    if many:
        queries = queries.dropDuplicates()
        repeated = not queries.groupBy(*queries.columns[:n_ids]).count().where("count > 1").isEmpty()
    else:
        first: dict = {}
        for r in map(as_array, rows):
            first.setdefault((r[:n_ids], None if r[n_ids] is None else r[n_ids].tobytes()), r)
        repeated = len({ids for ids, _ in first}) < len(first)
    if repeated:
        raise ValueError("a query id is given with several vectors")
    if not many:
        yield list(first.values())
        return
    rows = queries.toLocalIterator()
    while block := [as_array(r) for r in islice(rows, bound)]:
        yield block


def knn_dense(vectors: DataFrame, queries: DataFrame, k: int = 3, metric: str = "cosine",
              key_cols=("document_id", "chunk_index"), vec_col: str = "embedding",
              query_vec_col: str = "qvec", scope_col: str | None = None,
              max_broadcast: int = MAX_BROADCAST_QUERIES, norm_col: str | None = None) -> DataFrame:
    """KNN-1 (cosine) / KNN-2 (L2) over ARRAY<FLOAT> vectors, exact and exhaustive.

    With ``scope_col`` (JN-6) each query only sees vectors with the same value of that column: the kernel
    scores a scope's rows against that scope's queries. Equal rows of a query id (with its scope)
    are one query; different vectors of one id raise. Queries beyond ``max_broadcast`` are scored in several blocks, one scan
    of the vectors each; with ``scope_col``, they are joined to the vectors of their scope, in one scan. Vectors whose width differs from the queries', with NULL/NaN elements, or
    with a zero norm under cosine get no distance and drop out. Equal vectors have equal distances, so
    ties go by key. ``norm_col`` names a column that holds the vectors' norms, which are then not computed.
    Output: query_id, [scope_col], keys, rank, distance, score (= 1 - distance).
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    ids = ["query_id"] + ([scope_col] if scope_col else [])
    if scope_col and queries.select("query_id").limit(max_broadcast + 1).count() > max_broadcast:
        return _knn_dense_joined(vectors, queries.select(*ids, F.col(query_vec_col).alias("qvec")), k, metric, [c for c in key_cols if c not in ids], vec_col,
                                 scope_col, max_broadcast, norm_col)
    parts = [_knn_dense_block(vectors, rows, k, metric, [c for c in key_cols if c not in ids], vec_col, scope_col, norm_col)
             for rows in _dense_blocks(queries.select(*ids, query_vec_col), max_broadcast, len(ids))]
    return reduce(DataFrame.unionByName, parts)


def _knn_dense_block(vectors, rows, k, metric, keys, vec_col, scope_col, norm_col=None):
    rows = [r for r in rows if r[-1] is not None]
    widths = {len(r[-1]) for r in rows}
    if len(widths) > 1:
        raise ValueError("query vectors differ in width")
    scopes: dict | None = None
    if scope_col:
        scopes = {}
        for i, r in enumerate(rows):
            if r[1] is not None:
                scopes.setdefault(r[1], []).append(i)
        scopes = {s: np.array(of) for s, of in scopes.items()}
    matrix = np.array([r[-1] for r in rows], dtype=np.float64).reshape(len(rows), widths.pop() if widths else 0)
    bc = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], matrix, scopes))
    columns = [*([scope_col] if scope_col else []), *keys]
    schema = T.StructType([T.StructField("query_id", T.StringType()), *(vectors.schema[c] for c in columns),
                           T.StructField("distance", T.DoubleType())])

    def score(batches):
        names, q, of = bc.value
        top = RunningTopK(names, k, keys)
        for batch in batches:
            if batch.num_rows and len(names):
                dense_score_batch(batch, vec_col, q, metric, top, columns, scope_col, of, norm_col)
        yield from top.batches(columns, "distance", np.negative)

    partial = vectors.select(*columns, vec_col, *([norm_col] if norm_col else [])).mapInArrow(score, schema)
    part = ["query_id", *([scope_col] if scope_col else [])]
    order = [F.col("distance").asc()] + [F.col(c) for c in keys]
    return (top_k(partial, part, order, k)
            .select(*part, *keys, "rank", "distance", (F.lit(1.0) - F.col("distance")).alias("score")))


def _knn_dense_joined(vectors, queries, k, metric, keys, vec_col, scope_col, bound, norm_col=None):
    """Many queries, each of one scope: every vector meets its scope's queries by a join, so the work is one scan of
    the vectors and the pairs of equal scope, however many scopes have queries. Up to ``bound`` distinct query vectors
    are broadcast and the join brings their numbers; with more, it brings the vectors, a row per pair. Vectors of scopes
    without a query are dropped before the join (``idfilter``)."""
    ids = ["query_id", scope_col]
    kind = queries.schema["qvec"].dataType
    known = [r[0] for r in queries.select("qvec").distinct().limit(bound + 1).collect()]
    if numbered := len(known) <= bound:
        numbers = vectors.sparkSession.createDataFrame(list(enumerate(known)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("_v", kind)]))
        rows = queries.join(F.broadcast(numbers), F.col("qvec").eqNullSafe(F.col("_v"))).select(*ids, "query").dropDuplicates()
        none = F.col("query").isin([i for i, v in enumerate(known) if v is None])
    else:
        rows = queries.withColumnRenamed("qvec", "query").dropDuplicates()
        none = F.col("query").isNull()
    rows = materialized(rows, "scoped_queries")
    if not rows.groupBy(*ids).count().where("count > 1").isEmpty():
        raise ValueError("a query id is given with several vectors")
    rows = rows.where(~none & F.col(scope_col).isNotNull())
    widths = {len(v) for v in known if v is not None} if numbered else {r[0] for r in rows.select(F.size("query")).distinct().limit(2).collect()}
    if len(widths) > 1:
        raise ValueError("query vectors differ in width")
    width = widths.pop() if widths else 0
    one = F.struct("query_id", "query")
    if numbered:  # about SCOPE_QUERIES to a row, so no row grows with its scope's queries
        parts = rows.groupBy(scope_col).agg(F.ceil(F.count("*") / F.lit(SCOPE_QUERIES)).alias("_parts"))
        given = (rows.join(parts, scope_col).groupBy(scope_col, F.pmod(F.xxhash64("query_id"), F.col("_parts")).alias("_part"))
                 .agg(F.collect_list(one).alias("_of")).drop("_part"))
        matrix = np.array([[np.nan if x is None else x for x in (v if v is not None else [None] * width)] for v in known], dtype=np.float64).reshape(len(known), width)
    else:
        given, matrix = rows.select(scope_col, F.array(one).alias("_of")), None
    bc = vectors.sparkSession.sparkContext.broadcast(matrix)
    columns = [scope_col, *keys]
    some = vectors.select(*columns, vec_col, *([norm_col] if norm_col else []))
    if vectors.schema[scope_col].dataType == queries.schema[scope_col].dataType:
        some = may_be_in(some, id_filter(rows, [scope_col]), [scope_col])
    schema = T.StructType([T.StructField("query_id", T.StringType()), *(vectors.schema[c] for c in columns), T.StructField("distance", T.DoubleType())])

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                yield from dense_pairs_top_k(batch, vec_col, "_of", bc.value, width, metric, k, scope_col, keys, norm_col)

    partial = some.join(given, scope_col).mapInArrow(score, schema)
    return (top_k(partial, ids, [F.col("distance").asc()] + [F.col(c) for c in keys], k)
            .select(*ids, *keys, "rank", "distance", (F.lit(1.0) - F.col("distance")).alias("score")))


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding",
              digits: int | None = 6) -> DataFrame:
    """Mean vector per group: (group_col, qvec ARRAY<DOUBLE>).

    Dimensions are averaged as rows (partial aggregation before the shuffle),
    then put back in order; a group's array holds one value per dimension, so
    its size is bounded by the width, not by the group's row count.
    """
    per_dim = (vectors.select(group_col, F.posexplode(vec_col).alias("pos", "x"))
               .groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    m = F.round("m", digits) if digits is not None else F.col("m")
    return (per_dim.groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("pos", m.alias("m")))).alias("s"))
            .select(group_col, F.transform("s", lambda e: e["m"]).alias("qvec")))
