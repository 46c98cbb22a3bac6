"""Plan assertions for the shapes the scale design relies on."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled_chunk_texts(plan: str) -> list[str]:
    """Exchanges by chunk key, which would carry chunk texts."""
    return [line for line in plan.split("\n") if "hashpartitioning(document_id" in line and "REPARTITION_BY_NUM" in line]


def test_context_and_extraction_exchange_no_chunk_texts(spark):
    for name in ("metric_context", "metric_prompt", "extract_metrics", "doc_summary"):
        plan = _final_plan(entry.queries()[name](spark, SF))
        assert not _shuffled_chunk_texts(plan), name
        assert "CartesianProduct" not in plan, name


def test_answers_per_document_need_no_exchange(spark):
    plan = entry.queries()["document_answers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_only_documents_with_candidates_are_scored(spark):
    from docmetrics.operators import extract as X
    from docmetrics.operators import chunk as C
    from docmetrics.plans import queries as Q
    docs = Q.corpus(spark, SF).select("document_id", "text")
    cands = Q.materialized(X.catalog_candidates(C.document_chunks(docs), Q.ALL_CATALOG, ignore_case=True), "t")
    want = {r[0] for r in cands.select("document_id").distinct().collect()}
    scored = {r[0] for r in X.documents_with_candidates(docs, cands).select("document_id").collect()}
    assert want <= scored and len(scored - want) <= 1
    assert 0 < len(scored) < docs.count() / 2


def test_chunks_are_made_once_and_behind_the_filter(spark):
    """No filter on the chunk array is inferred, pushed below the join and the exchange, and so makes all chunks twice."""
    from docmetrics.operators import chunk as C
    from docmetrics.operators.idfilter import id_filter, may_be_in
    docs = C.spread(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("CAST(doc_id AS STRING) AS document_id", "text"))
    some = may_be_in(docs, id_filter(docs.where("document_id = '3'"), ["document_id"]), ["document_id"])
    plan = C.document_chunks(some)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [elements_and_chunks") == 1
    assert plan.index("ArrowEvalPython [elements_and_chunks") < plan.index("BroadcastHashJoin")
    assert C.document_chunks(some).select("document_id").distinct().count() == 1


def test_id_filter_holds_every_id_and_few_others(spark):
    from pyspark.sql import functions as F
    from docmetrics.operators.idfilter import id_filter, may_be_in
    ids = spark.range(0, 3000, 7).select(F.col("id").cast("string").alias("d")).unionByName(spark.createDataFrame([(None,)], "d string"))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("d"), F.lit("x").alias("_x")).unionByName(spark.createDataFrame([(None, "y")], "d string, _x string"))
    for bits, more in ((26, 0), (12, 3000)):
        kept = may_be_in(rows, id_filter(ids, ["d"], bits), ["d"], bits)
        got = {r[0] for r in kept.select("d").collect()}
        assert kept.columns == ["d", "_x"]
        assert {r[0] for r in ids.collect()} <= got and len(got) <= 430 + more
    assert may_be_in(rows, id_filter(ids.where("false"), ["d"]), ["d"]).count() == 0
    assert id_filter(ids, ["d"], 20).count() <= 32


def test_sparse_knn_partial_and_final_topk_without_join(spark):
    plan = _final_plan(entry.queries()["knn_sparse"](spark, SF))
    assert plan.count("WindowGroupLimit") >= 2          # partial before, final after the exchange
    assert "MapInArrow" in plan
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_fanout_and_catalogue_lookups_do_not_join(spark):
    for name in ("metric_fanout", "result_rows", "validate_range"):
        plan = _final_plan(entry.queries()[name](spark, SF))
        assert "Join" not in plan, name


def test_scans_prune_columns(spark):
    df = entry.queries()["chunk_words"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_spread_runs_no_job_on_shuffling_input(spark):
    from docmetrics.operators.chunk import spread
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    out = spread(df)
    assert set(tracker.getJobIdsForGroup(None)) == before     # nothing executed
    assert out is df


def test_spread_spreads_a_single_split_scan(spark):
    from docmetrics.operators.chunk import parallelism, spread
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert df.rdd.getNumPartitions() == 1
    assert spread(df).rdd.getNumPartitions() == parallelism(spark)


def test_map_only_work_does_not_shuffle_chunks(spark):
    for name in ("metric_candidates", "value_normalize", "hash_embed"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan, name


def test_arrow_batches_are_bounded_in_bytes(spark):
    import pyarrow as pa

    from docmetrics.operators.chunk import spread
    from docmetrics.session import BATCH_BYTES, BATCH_CONF

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["bytes"])

    def largest(rows: int, chars: int) -> int:
        docs = spark.range(rows).coalesce(1).selectExpr("id", f"repeat('a', {chars}) AS text")
        spread(docs)  # every operator on documents begins with it
        return max(r[0] for r in docs.mapInArrow(sizes, "bytes long").collect())

    own = spark.conf.get(BATCH_CONF, None)
    try:
        spark.conf.unset(BATCH_CONF)
        assert largest(4_000, 2_000) < 2 * BATCH_BYTES    # 8 MB of texts: was one batch
        assert largest(40, 200_000) < 2 * BATCH_BYTES
        spark.conf.set(BATCH_CONF, "4m")                  # the session's own setting stays
        assert 2 * BATCH_BYTES < largest(4_000, 2_000) < 5 * BATCH_BYTES
    finally:
        spark.conf.unset(BATCH_CONF) if own is None else spark.conf.set(BATCH_CONF, own)
