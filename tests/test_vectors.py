"""Vectors: validation, dense and sparse kNN against brute force (FLT-4/5, KNN-1..4, EMB-1)."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmetrics.operators import chunk as C
from docmetrics.operators import embed as E
from docmetrics.operators import knn as K
from docmetrics.operators import validate as V


def test_vector_validate_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0, 1.0]), (4, []), (5, None),
            (6, [1.0, None, 0.0]), (7, [1.0, float("nan"), 0.0]), (8, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = {r.vec_id: (r.status, r.reason) for r in V.vector_validate(df, 3).collect()}
    assert got == {1: ("valid", None), 2: ("rejected", "wrong width"), 3: ("rejected", "wrong width"),
                   4: ("rejected", "wrong width"), 5: ("rejected", "null vector"),
                   6: ("rejected", "null element"), 7: ("rejected", "nan element"),
                   8: ("rejected", "zero norm")}


def test_batch_alignment(spark):
    t = spark.createDataFrame([(1,), (2,)], "key int")
    v = spark.createDataFrame([(2,), (3,)], "key int")
    got = {r.key: r.status for r in V.batch_alignment(t, v, ["key"]).collect()}
    assert got == {1: "text_only", 2: "aligned", 3: "vector_only"}


def _brute(vecs, queries, k, metric):
    out = {}
    for qid, q in queries:
        scored = []
        for (vid, v) in vecs:
            a, b = np.array(v, dtype=float), np.array(q, dtype=float)
            if metric == "cosine":
                d = 1 - a.dot(b) / (np.linalg.norm(a) * np.linalg.norm(b))
            else:
                d = float(np.sqrt(((a - b) ** 2).sum()))
            scored.append((d, vid))
        out[qid] = [vid for _, vid in sorted(scored)[:k]]
    return out


def test_knn_dense_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    queries = [(f"q{j}", rng.normal(size=16).tolist()) for j in range(5)]
    vdf = spark.createDataFrame([(0, i, v) for i, v in vecs], "document_id int, chunk_index int, embedding array<float>")
    qdf = spark.createDataFrame(queries, "query_id string, qvec array<double>")
    for metric in ("cosine", "l2"):
        got = {}
        for r in K.knn_dense(vdf, qdf, 4, metric).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.chunk_index))
        want = _brute(vecs, queries, 4, metric)
        assert {q: [c for _, c in sorted(v)] for q, v in got.items()} == want


def test_knn_dense_scoped_and_plan(spark):
    vdf = spark.createDataFrame([(d, i, [float(i), 1.0]) for d in range(3) for i in range(1, 5)],
                                "document_id int, chunk_index int, embedding array<float>")
    qdf = spark.createDataFrame([("q", d, [1.0, 1.0]) for d in range(3)], "query_id string, document_id int, qvec array<double>")
    out = K.knn_dense(vdf, qdf, 1, "cosine", key_cols=("chunk_index",), scope_col="document_id")
    assert sorted((r.document_id, r.chunk_index) for r in out.collect()) == [(0, 1), (1, 1), (2, 1)]
    plan = K.knn_dense(vdf, qdf.drop("document_id"), 2).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "CartesianProduct" not in plan


def _texts():
    words = "alpha beta gamma delta emissions water energy 溫室氣體 排放量 員工 培訓".split()
    rng = np.random.default_rng(3)
    return [" ".join(rng.choice(words, size=rng.integers(1, 30))) for _ in range(400)]


def test_hash_embed_numpy_equals_relational(spark):
    df = spark.createDataFrame([(f"d{i % 7}", i, t) for i, t in enumerate(_texts())],
                               "document_id string, chunk_index int, text string")
    a = E.hash_embed(df).collect()
    b = E.hash_embed_sql_form(df).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_knn_sparse_equals_join_form_and_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(f"d{i % 7}", i, t) for i, t in enumerate(texts)],
                               "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([("q1", "溫室氣體 排放量"), ("q2", "water energy beta"), ("q3", "員工 培訓 alpha")],
                              "query_id string, text string")
    qv = E.query_vectors(q)
    for scope in ("corpus", "document"):
        fast = sorted((r.query_id, r.document_id, r.chunk_index, r.rank, r.score)
                      for r in K.knn_sparse(C.partition_chunks(df), qv, 3, scope=scope).collect())
        slow = sorted((r.query_id, r.document_id, r.chunk_index, r.rank, r.score)
                      for r in K.knn_sparse_join(E.hash_embed(df), qv, 3, scope=scope).collect())
        assert fast == slow
    # brute force on the term table
    terms = {}
    for r in E.hash_embed(df).collect():
        terms.setdefault((r.document_id, r.chunk_index), {})[r.bucket] = r.tf
    qt = {}
    for r in qv.collect():
        qt.setdefault(r.query_id, {})[r.bucket] = r.tf
    for qid, qvec in qt.items():
        scored = []
        for key, cv in terms.items():
            dot = sum(cv.get(b, 0) * t for b, t in qvec.items())
            if dot:
                s = dot / (math.sqrt(sum(t * t for t in qvec.values())) * math.sqrt(sum(t * t for t in cv.values())))
                scored.append((-s, key))
        want = [k for _, k in sorted(scored)[:3]]
        got = [(r.document_id, r.chunk_index) for r in sorted(
            K.knn_sparse(C.partition_chunks(df), qv.filter(F.col("query_id") == qid), 3).collect(),
            key=lambda r: r.rank)]
        assert got == want


def test_knn_sparse_plan_has_partial_topk(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(_texts()[:50])],
                               "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([("q1", "alpha beta")], "query_id string, text string")
    out = K.knn_sparse(C.partition_chunks(df), E.query_vectors(q), 3)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_centroids(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0])], "label int, embedding array<float>")
    got = {r.label: r.qvec for r in K.centroids(df, "label").collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 5.0]}


def test_knn_sparse_text_equals_vector_form(spark):
    df = spark.createDataFrame([(f"d{i % 5}", i, t) for i, t in enumerate(_texts()[:200])],
                               "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([("q1", "溫室氣體  排放量\n員工"), ("q2", "Water, energy!")], "query_id string, text string")
    pc = C.partition_chunks(df)
    for scope in ("corpus", "document"):
        a = sorted(map(tuple, K.knn_sparse_text(pc, q, 3, scope=scope).collect()))
        b = sorted(map(tuple, K.knn_sparse(pc, E.query_vectors(q), 3, scope=scope).collect()))
        assert a == b


def test_knn_dense_blocks_equal_single_broadcast(spark):
    rng = np.random.default_rng(11)
    vdf = spark.createDataFrame([(0, i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)],
                                "document_id int, chunk_index int, embedding array<float>")
    qdf = spark.createDataFrame([(f"q{j}", rng.normal(size=8).tolist()) for j in range(9)],
                                "query_id string, qvec array<double>")
    def rows(df):   # the same to the last bit in any block layout
        return sorted((r.query_id, r.chunk_index, r.rank, r.distance) for r in df.collect())

    for metric in ("cosine", "l2"):
        assert rows(K.knn_dense(vdf, qdf, 3, metric)) == rows(K.knn_dense(vdf, qdf, 3, metric, max_broadcast=4))


def test_knn_sparse_expansion_path_equals_join_form(spark, monkeypatch):
    # Force the sparse (term x query expansion) kernel that large query sets use.
    from docmetrics.functions import sparse
    monkeypatch.setattr(sparse, "DENSE_Q", 0)
    monkeypatch.setattr(sparse, "MAX_PAIRS", 500)      # many small slices
    df = spark.createDataFrame([(f"d{i % 7}", i, t) for i, t in enumerate(_texts()[:300])],
                               "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([("q1", "溫室氣體 排放量"), ("q2", "water energy beta"), ("q3", "員工 培訓 alpha")],
                              "query_id string, text string")
    qv = E.query_vectors(q)
    for scope in ("corpus", "document"):
        fast = sorted((r.query_id, r.document_id, r.chunk_index, r.rank, r.score)
                      for r in K.knn_sparse(C.partition_chunks(df), qv, 3, scope=scope).collect())
        slow = sorted((r.query_id, r.document_id, r.chunk_index, r.rank, r.score)
                      for r in K.knn_sparse_join(E.hash_embed(df), qv, 3, scope=scope).collect())
        assert fast == slow


def test_knn_sparse_blocks_and_repeated_ids_give_one_answer(spark):
    df = spark.createDataFrame([(f"d{i % 7}", i, t) for i, t in enumerate(_texts()[:200])],
                               "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([("q1", "溫室氣體 排放量"), ("q2", "water energy beta"), ("q1", "alpha 培訓 溫室氣體"), ("q3", "員工 alpha")],
                              "query_id string, text string")
    terms = E.query_vectors(q)
    rows = lambda d: sorted(map(tuple, d.collect()))
    for scope in ("corpus", "document"):
        want = rows(K.knn_sparse_join(E.hash_embed(df), terms, 3, scope=scope))
        assert rows(K.knn_sparse(df, terms, 3, scope=scope)) == want
        assert rows(K.knn_sparse(df, terms, 3, scope=scope, max_broadcast=2)) == want
        assert rows(K.knn_sparse_text(df, q, 3, scope=scope)) == want
        assert rows(K.knn_sparse_text(df, q, 3, scope=scope, max_queries=1)) == want


def test_a_long_query_text_is_hashed_by_spark(spark, monkeypatch):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(_texts()[:50])], "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([("q1", "water energy beta"), ("q2", None)], "query_id string, text string")
    want = sorted(map(tuple, K.knn_sparse_text(df, q).collect()))
    monkeypatch.setattr(K, "MAX_QUERY_TEXT", 3)
    assert sorted(map(tuple, K.knn_sparse_text(df, q).collect())) == want and want


def test_knn_dense_refuses_repeated_ids(spark):
    vdf = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(9)], "document_id int, chunk_index int, embedding array<float>")
    same = spark.createDataFrame([("q", [1.0, 1.0])] * 8, "query_id string, qvec array<double>")
    other = spark.createDataFrame([("q", [1.0, float(i)]) for i in range(8)], "query_id string, qvec array<double>")
    for bound in (5, 100):
        assert [r.chunk_index for r in K.knn_dense(vdf, same, 3, max_broadcast=bound).orderBy("rank").collect()] == [1, 2, 3]
        with pytest.raises(ValueError, match="several vectors"):
            K.knn_dense(vdf, other, 3, max_broadcast=bound)


def test_equal_vectors_rank_by_key_in_any_batch(spark):
    rng = np.random.default_rng(5)
    copy, other = rng.normal(size=33).astype(np.float32).tolist(), rng.normal(size=33).astype(np.float32).tolist()
    rows = [(0, i, copy if i % 3 == 0 else other) for i in range(1, 1004)]
    vdf = spark.createDataFrame(rows[::-1], "document_id int, chunk_index int, embedding array<float>").repartition(5)
    qdf = spark.createDataFrame([("q", copy)], "query_id string, qvec array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("1", "13", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for metric in ("cosine", "l2"):
                got = [r.chunk_index for r in K.knn_dense(vdf, qdf, 4, metric).orderBy("rank").collect()]
                assert got == [3, 6, 9, 12]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_scoped_search_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 4 if i % 11 else None, i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200)]
    queries = [("a", d, rng.normal(size=6).tolist()) for d in (0, 1, 3)] + [("b", 1, rng.normal(size=6).tolist()), ("c", None, [1.0] * 6)]
    vdf = spark.createDataFrame(rows, "document_id int, chunk_index int, embedding array<float>")
    qdf = spark.createDataFrame(queries, "query_id string, document_id int, qvec array<double>")
    for metric in ("cosine", "l2"):
        got = {}
        for r in K.knn_dense(vdf, qdf, 3, metric, scope_col="document_id").orderBy("rank").collect():
            got.setdefault((r.query_id, r.document_id), []).append(r.chunk_index)
        want = {(q, d): _brute([(i, v) for s, i, v in rows if s == d], [(q, vec)], 3, metric)[q] for q, d, vec in queries if d is not None}
        assert got == want


def test_running_top_k_gives_at_most_k_rows_a_query():
    from docmetrics.functions.sparse import RunningTopK
    rng = np.random.default_rng(1)
    top = RunningTopK(["a", "b", "c"], 4, ["key"])
    top.limit = 50
    seen = []
    for _ in range(40):
        query, score, key = rng.integers(0, 2, 30), rng.integers(0, 6, 30).astype(float), rng.integers(0, 10**6, 30)
        seen += zip(query.tolist(), (-score).tolist(), key.tolist())
        near = score >= top.kth[query]
        top.add(query[near], score[near], {"key": pa.array(key[near])})
        assert top.rows <= top.limit + 30
    out = pa.Table.from_batches(top.batches(["key"], "score")).to_pylist()
    want = [(q, -s, k) for q in (0, 1) for _, s, k in sorted(x for x in seen if x[0] == q)[:4]]
    assert [("ab".index(r["query_id"]), r["score"], r["key"]) for r in out] == want


def test_chunks_without_an_id_are_refused(spark):
    from docmetrics.sources.documents import identified
    df = spark.createDataFrame([("a", 0, "x"), (None, 0, "y")], "document_id string, chunk_index int, text string")
    with pytest.raises(Exception, match="document_id of a chunk is null"):
        C.partition_chunks(df).collect()
    known, rejected = identified(df)
    assert [tuple(r) for r in C.partition_chunks(known).collect()] == [("a", 0, "x")]
    assert [(r.text, r.reason) for r in rejected.collect()] == [("y", "document_id is null")]


def test_many_scoped_queries_need_one_scan(spark, monkeypatch):
    """More queries than one block holds meet their scope's vectors by one join: same rows, one pass, whatever their vectors."""
    from docmetrics.operators import knn
    rng = np.random.default_rng(4)
    rows = [(i % 9 if i % 11 else None, i, rng.normal(size=6).astype(np.float32).tolist() if i % 13 else None) for i in range(300)] + [(1, 300, [0.0] * 6)]
    vdf = spark.createDataFrame(rows, "document_id int, chunk_index int, embedding array<float>")
    few = [rng.normal(size=6).tolist() for _ in range(3)]
    few[2][1] = None
    for queries in ([(f"q{j}", d, few[j]) for d in range(12) for j in range(3)], [(f"q{j}", d, rng.normal(size=6).tolist()) for d in range(12) for j in range(3)]):
        qdf = spark.createDataFrame(queries + queries[:2] + [("c", None, few[0]), ("n", 3, None)], "query_id string, document_id int, qvec array<double>")
        for metric in ("cosine", "l2"):
            want = sorted(map(tuple, K.knn_dense(vdf, qdf, 4, metric, scope_col="document_id").collect()))
            monkeypatch.setattr(knn, "SCOPE_QUERIES", 2)
            out = K.knn_dense(vdf, qdf, 4, metric, scope_col="document_id", max_broadcast=5)
            assert sorted(map(tuple, out.collect())) == want and want
            assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    other = spark.createDataFrame([("q", 0, [1.0] * 6), ("q", 0, [2.0] * 6)] * 4, "query_id string, document_id int, qvec array<double>")
    with pytest.raises(ValueError, match="several vectors"):
        K.knn_dense(vdf, other, 3, scope_col="document_id", max_broadcast=5)


def test_kernels_work_on_runs_of_a_batch(monkeypatch):
    """Working arrays are those of a run of texts, not of a batch, with the rows of the whole batch."""
    from docmetrics.functions import sparse, text
    batch = pa.record_batch([pa.array(range(400)), pa.array([None if i % 7 == 3 else t for i, t in enumerate(_texts())])], names=["key", "text"])
    whole = pa.Table.from_batches(sparse.term_rows(batch, ["key"], sparse.TokenHasher(512)))
    seen = []
    monkeypatch.setattr(text, "SLICE_BYTES", 500)
    hashed = sparse.TokenHasher.batch
    monkeypatch.setattr(sparse.TokenHasher, "batch", lambda self, texts: seen.append(texts.nbytes) or hashed(self, texts))
    parts = list(sparse.term_rows(batch, ["key"], sparse.TokenHasher(512)))
    assert pa.Table.from_batches(parts).equals(whole) and len(parts) > 20 and max(seen) < 1_500
    assert sparse.TokenHasher.MAX_MEMO <= 100_000


def test_lists_are_made_run_by_run(monkeypatch):
    from docmetrics.functions import text
    monkeypatch.setattr(text, "SLICE_BYTES", 10)
    texts = pa.array(["a b", None, "", "c" * 30, "d", "e"])
    assert list(text.text_runs(texts)) == [(0, 3), (3, 4), (4, 6)]
    lists = pa.array([["a b", None], None, [], ["c" * 30, "d"], ["e"]])
    assert list(text.text_runs(lists)) == [(0, 3), (3, 4), (4, 5)] and list(text.text_runs(lists.slice(3))) == [(0, 1), (1, 2)]
    calls = []
    got = text.by_runs(lambda items: calls.append(len(items)) or [[t] for t in items], texts, pa.list_(pa.string()))
    assert calls == [3, 1, 2] and got.to_pylist() == [[t] for t in texts.to_pylist()]
    assert text.by_runs(lambda items: items, texts.slice(0, 0), pa.string()).to_pylist() == []


def test_copies_in_a_batch_offer_k_rows_a_query(monkeypatch):
    """Equal chunks tie for every query; no more than k of them a query have their columns taken, and keys decide which."""
    from docmetrics.functions import sparse
    offered = []
    add = sparse.RunningTopK.add
    monkeypatch.setattr(sparse.RunningTopK, "add", lambda self, query, score, columns: offered.append(len(query)) or add(self, query, score, columns))
    n, names = 300, [f"q{i:02d}" for i in range(40)]
    keys = [f"d{(i * 7) % n:03d}" for i in range(n)]
    batch = pa.record_batch([pa.array(keys), pa.array(["same words in all chunks"] * n), pa.array([[1.0, 2.0]] * n, pa.list_(pa.float32()))], names=["key", "text", "vec"])
    hasher = sparse.TokenHasher(512)
    at, bucket, tf, _ = sparse.bucket_counts(*hasher.batch(pa.array(["words"] * len(names))), len(names), 512)
    qm = sparse.QueryMatrix.from_payload(sparse.QueryMatrix.payload([names[i] for i in at], bucket, tf, 512))
    top = sparse.RunningTopK(qm.ids, 3, ["key"])
    sparse.score_batch(batch, qm, top, hasher, carry_cols=("text",))
    got = pa.Table.from_batches(list(top.batches(("key", "text", "dot"), "score"))).to_pylist()
    assert [(r["query_id"], r["key"]) for r in got] == [(q, f"d{i:03d}") for q in names for i in range(3)]
    assert {r["text"] for r in got} == {"same words in all chunks"} and len({r["dot"] for r in got}) == 1
    assert sum(offered) <= 3 * len(names)
    offered.clear()
    top = sparse.RunningTopK(names, 3, ["key"])
    sparse.dense_score_batch(batch, "vec", np.ones((len(names), 2)), "cosine", top, ["key"])
    got = pa.Table.from_batches(list(top.batches(["key"], "distance", np.negative))).to_pylist()
    assert [(r["query_id"], r["key"]) for r in got] == [(q, f"d{i:03d}") for q in names for i in range(3)]
    assert sum(offered) <= 3 * len(names)
