"""The stored vector table: write, read, search with text and metadata, pruning, idf weights, L2 kernel."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmetrics.functions import sparse
from docmetrics.operators import embed as E
from docmetrics.operators import validate as V
from docmetrics.operators import vector_store as VS

DIM, PARTS = 64, 8


def chunk_rows():
    rows = [(f"d{d}", i, f"word{d} topic{i % 5} shared alpha{d * i % 7} beta" + " gamma" * (i % 3)) for d in range(12) for i in range(6)]
    return rows + [("d0", 6, "!!! ..."), ("d1", 6, None), ("hot", 0, "topic1 topic2")] + [("hot", i, f"topic{i % 5} hot{i}") for i in range(1, 400)]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(chunk_rows(), "document_id string, chunk_index int, text string").repartition(4)
    return df.withColumn("metadata", F.create_map(F.lit("n"), F.length("text").cast("string")))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q1", "topic1  shared"), ("q2", "alpha3\nbeta"), ("q3", "!!!")], "query_id string, text string")


@pytest.fixture(scope="module")
def path(spark, chunks, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("vectors") / "table")
    VS.store_vectors(VS.dense_vectors(chunks, DIM), out, parts=PARTS)
    return out


def brute(chunks, queries, k, metric="cosine", weights=None, dim=DIM):
    vec = lambda df, keys: {tuple(r[c] for c in keys): r for r in df.collect()}

    def dense(df, keys):
        out = {}
        for r in E.hash_embed_sql_form(df, keys, "text", dim).collect():
            v = out.setdefault(tuple(r[c] for c in keys), np.zeros(dim))
            v[r["bucket"]] = r["tf"] * (1 if weights is None else weights[r["bucket"]])
        return out
    del vec
    cs = dense(chunks.where("text IS NOT NULL"), ["document_id", "chunk_index"])
    qs = dense(queries.withColumn("text", F.regexp_replace("text", r"\s+", " ")), ["query_id"])
    out = {}
    for (q,), x in qs.items():
        if metric == "cosine":
            scored = [(1.0 - (x @ v) / (math.sqrt(v @ v) * math.sqrt(x @ x)), key) for key, v in cs.items()]
        else:
            scored = [(math.sqrt(((x - v)**2).sum()), key) for key, v in cs.items()]
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_search_equals_brute_force_and_brings_text(spark, chunks, queries, path, metric):
    hits = VS.search_vectors(spark, path, VS.query_embeddings(queries, DIM), 4, metric, parts=PARTS).collect()
    texts = {(d, i): t for d, i, t in chunk_rows()}
    got = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        got.setdefault(h["query_id"], []).append((h["distance"], (h["document_id"], h["chunk_index"])))
        text = texts[h["document_id"], h["chunk_index"]]
        assert h["text"] == text and h["metadata"] == {"n": str(len(text))}
    assert got == brute(chunks, queries, 4, metric) and set(got) == {"q1", "q2"}  # q3 has no token, so no vector


def test_idf_weights_and_weighted_search(spark, chunks, queries, tmp_path):
    known = chunks.where("text IS NOT NULL")
    weights = VS.weight_array(VS.bucket_weights(chunks, DIM), DIM)
    df = {r["bucket"]: r["n"] for r in E.hash_embed_sql_form(known, dim=DIM).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    n = chunks.count()
    assert weights.tolist() == [round(1000 * (1 + math.log((1 + n) / (1 + df.get(b, 0))))) for b in range(DIM)]
    out = str(tmp_path / "idf")
    VS.store_vectors(VS.dense_vectors(chunks, DIM, weights), out, parts=PARTS)
    hits = VS.search_vectors(spark, out, VS.query_embeddings(queries, DIM, weights), 3, parts=PARTS, fetch=False).collect()
    got = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        got.setdefault(h["query_id"], []).append((h["distance"], (h["document_id"], h["chunk_index"])))
    assert got == brute(chunks, queries, 3, weights=weights)


def test_scoring_reads_no_text_and_the_fetch_prunes_folders(spark, queries, path):
    q = VS.query_embeddings(queries, DIM)
    plan = VS.search_vectors(spark, path, q, 2, parts=PARTS)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "ReadSchema" in line and "norm:double" in line]
    assert scans and all("text:string" not in line and "metadata" not in line for line in scans)
    assert "dynamicpruning" in plan


def test_search_within_documents_reads_their_folders_only(spark, chunks, queries, path):
    docs = spark.createDataFrame([("d3",), ("hot",)], "document_id string")
    some = VS.open_vectors(spark, path, docs, PARTS)
    assert {r[0] for r in some.select("document_id").distinct().collect()} == {"d3", "hot"}
    scoped = docs.crossJoin(VS.query_embeddings(queries, DIM))
    hits = VS.search_vectors(spark, path, scoped, 2, scope="document", parts=PARTS)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    want = {r[0] for r in docs.select(VS.part_col(F.col("document_id"), PARTS)).collect()}
    assert 0 < len(want) < PARTS
    for p in (plan, some._jdf.queryExecution().executedPlan().toString()):  # the scan's folders are known before it runs
        pruned = re.findall(r"PartitionFilters: \[[^]]*part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", p)
        assert {int(x) for pair in pruned for x in ",".join(pair).split(",") if x} == want
    got = {}
    for h in sorted(hits.collect(), key=lambda h: h["rank"]):
        got.setdefault((h["document_id"], h["query_id"]), []).append((h["distance"], (h["document_id"], h["chunk_index"])))
    for d in ("d3", "hot"):
        for q, best in brute(chunks.where(F.col("document_id") == d), queries, 2).items():
            assert got[d, q] == best


def test_a_long_document_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(5_000).select(F.lit("hot").alias("document_id"), F.col("id").cast("int").alias("chunk_index"), F.lit("a b").alias("text"),
                                     F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    out = str(tmp_path / "t")
    VS.store_vectors(VS.dense_vectors(rows, DIM), out, parts=PARTS)
    stored = VS.open_vectors(spark, out)
    assert stored.count() == 5_000 and len(stored.inputFiles()) > 3
    assert stored.select("part").distinct().count() == 1


def test_empty_table_and_append(spark, chunks, queries, tmp_path):
    out = str(tmp_path / "t")
    VS.store_vectors(VS.dense_vectors(chunks.where("false"), DIM), out, parts=PARTS)
    q = VS.query_embeddings(queries, DIM)
    assert VS.search_vectors(spark, out, q, 2, parts=PARTS).collect() == []
    VS.store_vectors(VS.dense_vectors(chunks.where("document_id = 'd1'"), DIM), out, parts=PARTS)
    VS.store_vectors(VS.dense_vectors(chunks.where("document_id = 'd2'"), DIM), out, parts=PARTS)
    assert {r["document_id"] for r in VS.search_vectors(spark, out, q, 12, parts=PARTS).collect()} == {"d1", "d2"}
    with pytest.raises(ValueError):
        VS.store_vectors(VS.dense_vectors(chunks, DIM), out, mode="replace")


def test_l2_kernel_equals_plain_distances():
    rng = np.random.default_rng(2)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e3), (1e6, 0.0)):
        v, q = rng.normal(shift, scale, (700, 16)), rng.normal(shift, scale, (9, 16))
        v[50:90] = v[7]  # ties
        want = np.sqrt(((v[:, None] - q[None])**2).sum(axis=2))
        got = np.full(want.shape, np.nan)
        floor = np.full(len(q), -np.inf)
        for r, j, d in sparse.dense_slices(v, q, "l2", 5, lambda: floor):
            got[r, j] = d
        for j in range(len(q)):
            kth = np.sort(want[:, j])[4]
            near = want[:, j] <= kth
            assert (got[near, j] == want[near, j]).all()


def test_infinite_elements_are_rejected(spark):
    rows = [(1, [1.0, float("inf")]), (2, [1.0, 1e39]), (3, [1.0, 2.0]), (4, [-float("inf"), float("nan")])]
    got = {r["id"]: r["reason"] for r in V.vector_validate(spark.createDataFrame(rows, "id int, embedding array<double>"), 2).collect()}
    assert got == {1: "infinite element", 2: "infinite element", 3: None, 4: "nan element"}
