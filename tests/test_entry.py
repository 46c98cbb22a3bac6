"""Driver contract: entry(), queries() and oracle_sql() agree on a small scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docmetrics.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "confidence" in df.columns


def test_every_query_has_an_oracle():
    q, o = set(entry.queries()), set(entry.oracle_sql())
    assert o <= q and set(QUERIES) <= q
    assert set(QUERIES) <= o
    assert len(QUERIES) == 57


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else f"{round(v, 6):.6f}")
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, str(v))


@pytest.mark.parametrize("name", ["chunk_union", "knn_sparse", "extract_metrics", "result_rows",
                                  "validation_report", "knn_cosine", "table_cells", "chunk_lines",
                                  "hash_embed", "metric_context", "doc_summary", "response_rejects",
                                  "metric_trend", "table_verbalize", "knn_l2", "report_rollup",
                                  "knn_per_document", "document_answers", "stream_chunks", "validate_range", "value_normalize", "metric_prompt_plain",
                                  "vector_search", "vector_search_idf", "vector_search_document", "bucket_weights", "batch_alignment",
                                  "chunk_vector_join", "file_scan", "table_chunks", "chunk_words_blocks", "report_text", "ordered_results", "resent_chunks"])
def test_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in (f.removesuffix(".parquet") for f in os.listdir(SF)):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    drows = sorted(tuple(_norm(r[dcols.index(c)]) for c in cols) for r in rel.fetchall())
    assert srows == drows


def test_a_document_without_an_id_is_rejected_not_fatal(spark, tmp_path):
    from docmetrics.plans import queries as Q
    rows = [(1, "用水量：5 立方米 of the text", "en", "s", 5), (None, "用水量：9 立方米 without an id", "en", "s", 5)]
    spark.createDataFrame(rows, Q.DOCUMENT_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    assert {r["document_id"] for r in Q.q_extract_metrics(spark, sf).collect()} == {"1", "A", "B"}
    assert {r["document_id"] for r in Q.q_document_answers(spark, sf).collect()} == {"1", "A", "B"}
    assert [(r["document_id"], r["reason"]) for r in Q.corpus_rejects(spark, sf).collect()] == [(None, "document_id is null")]
