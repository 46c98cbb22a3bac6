"""End-to-end rule extraction and retrieval on the fixture reports (RAG-1..3, KNN-4)."""

from decimal import Decimal

from docmetrics.catalog import ESG_CATALOG
from docmetrics.operators import chunk as C
from docmetrics.operators import embed as E
from docmetrics.operators import extract as X
from docmetrics.operators import knn as K


def test_report_a_metrics(spark, reports):
    chunks = C.document_chunks(reports.filter("document_id = 'A'"))
    res = {r.metric_id: r for r in X.extract_metrics(chunks, ESG_CATALOG, k=3).collect()}
    assert (res["greenhouse_gas"].value, res["greenhouse_gas"].unit) == (12345.0, "公噸CO2e")
    assert (res["water_usage"].value, res["water_usage"].unit) == (45678.0, "立方米")
    assert (res["employee_training"].value, res["employee_training"].unit) == (Decimal("42.5"), "小時")
    assert res["employee_training"].keyword == "員工培訓時數"
    assert (res["compensation"].value, res["compensation"].unit) == (Decimal("85.6"), "%")
    assert res["compensation"].keyword == "整體薪酬水準"
    for r in res.values():
        assert 0 <= r.confidence <= 1 and r.source == f"A#{r.chunk_index}"
    docs = reports.filter("document_id = 'A'").select("document_id")
    gap = {r.metric_id for r in X.coverage_gap(X.metric_fanout(docs), X.extract_metrics(chunks)).collect()}
    assert gap == {"board_diversity", "risk_management"}


def _queries(spark, texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_retrieval_questions(spark, reports):
    chunks = C.partition_chunks(C.document_chunks(reports))
    for texts in (["公司的溫室氣體排放量是多少？", "員工平均培訓時數？", "用水量數據"],
                  ["公司的溫室氣體排放量是多少？", "員工培訓情況如何？", "能源使用情況是？"]):
        hits_df = K.knn_sparse(chunks, E.query_vectors(_queries(spark, texts)), k=2)
        hits = hits_df.collect()
        per_q = {}
        for h in hits:
            per_q.setdefault(h.query_id, []).append(h)
        assert set(per_q) == {"q0", "q1", "q2"}
        assert all(1 <= len(v) <= 2 for v in per_q.values())
    ctx = X.retrieval_context(hits_df, chunks).collect()
    assert all(c.context for c in ctx)


def test_prompt_contains_context(spark, reports):
    chunks = C.partition_chunks(C.document_chunks(reports))
    q = E.query_texts_from_catalog(spark, ESG_CATALOG)
    hits = K.knn_sparse(chunks, E.query_vectors(q), k=2)
    pr = {r.metric_id: r.prompt for r in X.prompts(X.retrieval_context(hits, chunks)).collect()}
    assert set(pr) <= {m.metric_id for m in ESG_CATALOG}
    assert "溫室氣體排放量" in pr["greenhouse_gas"]


def test_contexts_from_chunk_lists_equal_search_and_join(spark, monkeypatch):
    """A document's contexts from its own row equal search, join with the chunk table and grouping; long lists in pieces."""
    from docmetrics.functions import sparse
    rows = [(f"d{i}", "\n".join(f"word{(i * j) % 7} topic{j % 4} 排放量{j}" + (" x" * 900 if j % 5 == 0 else "") for j in range(i * 4)) or None) for i in range(9)]
    docs = spark.createDataFrame(rows + [("t", "| a | b |\n| --- | --- |\n| topic1 | word3 |"), (None, "topic1 word1")], "document_id string, text string")
    queries = _queries(spark, ["word1 topic1", "topic3", "排放量", "nothing shared qqq"])
    got = {(r.document_id, r.query_id): r.context for r in K.document_contexts(C.chunk_lists(docs), queries, 2).collect()}
    chunks = C.document_chunks(docs.where("document_id IS NOT NULL"))
    hits = K.knn_sparse_text(chunks, queries, 2, scope="document")
    want = {(r.document_id, r.query_id): r.context for r in X.retrieval_context(hits, chunks, group_cols=("document_id", "query_id")).collect()}
    assert {key: v for key, v in got.items() if key[0] is not None} == want and (None, "q0") in got
    lists = C.chunk_lists(docs).where("document_id = 'd8'").first()["chunks"]
    import pyarrow as pa
    payload = K._hashed_texts([("q0", "word1 topic1"), ("q1", "topic3")], 4096, True)
    qm, hasher = sparse.QueryMatrix.from_payload(payload), sparse.TokenHasher(4096, True)
    whole = [x for part in sparse.contexts_of_lists(pa.array([lists, [], lists[:3]]), qm, 2, hasher) for x in zip(*part)]
    monkeypatch.setattr(sparse, "LIST_ROWS", 3)
    pieces = [x for part in sparse.contexts_of_lists(pa.array([lists, [], lists[:3]]), qm, 2, hasher) for x in zip(*part)]
    assert whole == pieces and len(whole) == 4
