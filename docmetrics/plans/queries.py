"""Registered queries over the driver's tables.

Two worlds feed the operators:

* the **corpus**: every row of ``documents`` (document_id = doc_id as text)
  plus the two fixture reports, for chunking, tables, vectors, retrieval and
  rule extraction;
* **answers**: one JSON answer per row of ``events`` (document = user, metric
  by event type), with fixed kinds of damage on some rows, for parsing,
  result rows, confidence reports and validation.

Every query reads whole tables. Floating outputs are rounded to 6 digits so
the SQL oracle can compare them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.catalog import CORPUS_CATALOG, ESG_CATALOG
from docmetrics.operators import chunk as C
from docmetrics.operators import embed as E
from docmetrics.operators import extract as X
from docmetrics.operators import knn as K
from docmetrics.operators import report as R
from docmetrics.operators import validate as V
from docmetrics.operators import vector_store as VS
from docmetrics.operators.hooks import complete_with
from docmetrics.operators.long_text import chunk_long_words
from docmetrics.operators.candidates import metric_candidates, split_value_unit, value_normalize
from docmetrics.sources.documents import format_gate, identified, manifest, scan_parquet_files
from docmetrics.sources.fixtures import REPORTS
from docmetrics.session import materialized, scratch_dir

ALL_CATALOG = ESG_CATALOG + CORPUS_CATALOG
K_DEFAULT = 3
CANDIDATE_KEYWORDS = ("員工", "環境", "碳排", "能源", "培訓", "薪資", "安全", "事故",
                      "version", "license", "by", "the")
# Answers world: metric per event type, and the catalogue unit written after values.
EVENT_METRIC = {"view": "greenhouse_gas", "click": "water_usage", "signup": "employee_training",
                "purchase": "compensation", "error": "board_diversity"}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # Test tables are single files with one row group; spread them over the
    # cores (a no-op for inputs that already arrive in many splits).
    return C.spread(spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet"))


def _r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- corpus world ----------------------------------------------------------------------

def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an id, and the two reports; rows without one are in ``corpus_rejects``."""
    docs, _ = identified(_t(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), "text", "source", "lang"))
    # Fixture rows as literals: the same plan every time, so exchanges over it can be reused.
    fx = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("document_id"), F.lit(t).alias("text"),
                 F.lit("fixture").alias("source"), F.lit("zh").alias("lang"))
        for d, _, _, t in REPORTS])))
    return docs.unionByName(fx)


def corpus_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of documents that cannot be chunked, with the reason."""
    return identified(_t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", "lang"))[1]


def corpus_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.document_chunks(corpus(spark, sf), keep_cols=("source", "lang"))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """EMB-2 query texts: the catalogue's search sentences plus every benchmark item."""
    cat = E.query_texts_from_catalog(spark, ALL_CATALOG)
    bench = _t(spark, sf, "benchmark").select(
        F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("query_id"), "text")
    return cat.unionByName(bench)


def q_chunk_words(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return C.chunk_words(docs, ["doc_id"])


def q_chunk_words_blocks(spark, sf):
    """The same rows by blocks of 8,192 characters: a longer document is packed by several tasks."""
    return chunk_long_words(_t(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], block_chars=8_192)


def q_chunk_lines(spark, sf):
    return C.chunk_lines(_t(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


def q_section_split(spark, sf):
    return C.section_split(_t(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


def q_markdown_elements(spark, sf):
    return C.markdown_elements(corpus(spark, sf).select("document_id", "text"))


def event_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in documents with tables: one report per user and block of 5,000 event ids (so no group is larger
    than that), a heading and a pipe table of the events."""
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    line = F.format_string("| %d | %s | %.2f |", "event_id", "event_type", "value")
    block = F.expr("event_id div 5000")
    rows = e.groupBy("user_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"))
    text = F.concat(F.format_string("# user %d\n\n| event | type | value |\n| --- | --- | --- |\n", "user_id"),
                    F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return rows.select(F.format_string("u%d-%d", "user_id", "block").alias("document_id"), text.alias("text"))


def _with_event_reports(spark, sf):
    return corpus(spark, sf).select("document_id", "text").unionByName(event_reports(spark, sf))


def q_table_cells(spark, sf):
    return C.table_cells(_with_event_reports(spark, sf))


def q_table_verbalize(spark, sf):
    return C.table_verbalize(_with_event_reports(spark, sf))


def q_table_chunks(spark, sf):
    """Text blocks, then all tables of a document as one text, chunked and numbered on."""
    return C.document_chunks(event_reports(spark, sf))


def q_chunk_union(spark, sf):
    return corpus_chunks(spark, sf).select("document_id", "chunk_index", "source_kind", "text")


def q_chunk_metadata(spark, sf):
    """PRJ-2: document metadata repeated on every chunk, plus chunk_index."""
    return corpus_chunks(spark, sf).select(
        "document_id", "chunk_index", "source_kind", "source", "lang",
        "total_chunks", "tables_found", F.length("text").alias("n_chars"))


def q_metric_fanout(spark, sf):
    return X.metric_fanout(corpus(spark, sf).select("document_id"), ESG_CATALOG) \
        .drop("name")


def _candidates(spark, sf):
    # Per chunk, so it runs in the chunking stage: no exchange of chunk texts.
    return metric_candidates(corpus_chunks(spark, sf), CANDIDATE_KEYWORDS, ignore_case=True)


def q_metric_candidates(spark, sf):
    return _candidates(spark, sf)


def q_value_normalize(spark, sf):
    return value_normalize(_candidates(spark, sf))


def _chunk_terms(spark, sf):
    return E.hash_embed(corpus_chunks(spark, sf), ["document_id", "chunk_index"], prepartitioned=True)


def q_hash_embed(spark, sf):
    return _chunk_terms(spark, sf)


def q_metric_query_vectors(spark, sf):
    return E.query_vectors(benchmark_queries(spark, sf))


def _sparse_hits(spark, sf, queries: DataFrame, k: int = K_DEFAULT, chunks: DataFrame | None = None):
    return K.knn_sparse_text(chunks if chunks is not None else corpus_chunks(spark, sf), queries, k)


def q_knn_sparse(spark, sf):
    hits = _sparse_hits(spark, sf, benchmark_queries(spark, sf))
    return hits.select("query_id", "document_id", "chunk_index", "rank", _r6("score").alias("score"))


def _hits_with_text(spark, sf, queries: DataFrame) -> DataFrame:
    """Hits that carry their chunk's text from the scoring stage: k texts per query and task travel, no others."""
    return K.knn_sparse_text(corpus_chunks(spark, sf), queries, K_DEFAULT, carry_cols=("text",))


def q_metric_context(spark, sf):
    return X.context_of_hits(_hits_with_text(spark, sf, benchmark_queries(spark, sf)))


def q_metric_prompt(spark, sf):
    hits = _hits_with_text(spark, sf, E.query_texts_from_catalog(spark, ALL_CATALOG))
    return X.prompts(X.context_of_hits(hits), ALL_CATALOG)


def q_metric_prompt_plain(spark, sf):
    hits = _hits_with_text(spark, sf, E.query_texts_from_catalog(spark, ALL_CATALOG))
    return X.prompts(X.context_of_hits(hits), ALL_CATALOG, template=X.PLAIN_TEMPLATE)


def _first_number(prompts: list[str]) -> list[str]:
    """Stands in for a model: answers with the first number of the context, surer the longer the context."""
    contexts = [p.split("\n\n", 1)[1] for p in prompts]
    return [json.dumps({"value": m[0] if (m := re.search("[0-9]+", c)) else "", "source": "context",
                        "confidence": min(len(c), 2400) / 2400}) for c in contexts]


def q_document_answers(spark, sf):
    """Per document: retrieval, one prompt per metric, a completer, parsing, result rows."""
    lists = C.chunk_lists(corpus(spark, sf).select("document_id", "text"))
    ctx = K.document_contexts(lists, E.query_texts_from_catalog(spark, ALL_CATALOG), K_DEFAULT)
    answers = complete_with(X.prompts(ctx, ALL_CATALOG, keep_cols=("document_id",)), _first_number)
    return X.result_rows(X.parse_responses(answers), ALL_CATALOG).select(
        "document_id", "item", "value", "source", "category", "metric_id", _r6("confidence").alias("confidence"), "trend")


def _extracted(spark, sf):
    docs = corpus(spark, sf).select("document_id", "text")
    return X.extract_document_metrics(docs, C.document_chunks, ALL_CATALOG, k=K_DEFAULT, ignore_case=True)


def q_extract_metrics(spark, sf):
    return _extracted(spark, sf).withColumn("score", _r6("score"))


def q_doc_summary(spark, sf):
    return R.doc_summary(corpus(spark, sf), corpus_chunks(spark, sf), _extracted(spark, sf))


def q_report_text(spark, sf):
    finished = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return R.report_text(corpus(spark, sf), corpus_chunks(spark, sf), _extracted(spark, sf), finished)


# --- stored vectors -------------------------------------------------------------------

def _stored_vectors(spark, sf, idf: bool = False):
    """(path of a vector table written from all chunks, bucket weights or None)."""
    chunks = C.chunk_metadata_map(corpus_chunks(spark, sf), ("source", "lang", "total_chunks", "tables_found"))
    chunks = chunks.select("document_id", "chunk_index", "text", "metadata")
    weights = VS.weight_array(VS.bucket_weights(chunks)) if idf else None
    path = scratch_dir(spark, "vectors")
    VS.store_vectors(VS.dense_vectors(chunks, weights=weights), path)
    return path, weights


def _hits_out(hits: DataFrame) -> DataFrame:
    facts = [F.col("metadata")[c].alias(c) for c in ("source", "lang", "total_chunks")]
    return hits.select("query_id", "document_id", "chunk_index", "rank", _r6("distance").alias("distance"),
                       _r6("score").alias("score"), "text", *facts)


def q_vector_search(spark, sf):
    """Documents -> chunks -> dense hashed vectors -> stored table -> read again -> nearest chunks with text and metadata."""
    path, _ = _stored_vectors(spark, sf)
    return _hits_out(VS.search_vectors(spark, path, VS.query_embeddings(benchmark_queries(spark, sf)), K_DEFAULT))


def q_vector_search_idf(spark, sf):
    """The same with counts weighted by inverse document frequency, on both sides."""
    path, weights = _stored_vectors(spark, sf, idf=True)
    return _hits_out(VS.search_vectors(spark, path, VS.query_embeddings(benchmark_queries(spark, sf), weights=weights), K_DEFAULT))


def q_vector_search_document(spark, sf):
    """In every document labelled toxic, its nearest chunks to the catalogue's sentences: only their folders are read."""
    path, _ = _stored_vectors(spark, sf)
    toxic = _t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    queries = VS.query_embeddings(E.query_texts_from_catalog(spark, ALL_CATALOG))
    return _hits_out(VS.search_vectors(spark, path, toxic.crossJoin(F.broadcast(queries)), K_DEFAULT, scope="document"))


def q_bucket_weights(spark, sf):
    return VS.bucket_weights(corpus_chunks(spark, sf))


# --- vectors world -----------------------------------------------------------------------

def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _centroid_queries(spark, sf):
    c = K.centroids(_vectors(spark, sf), "label")
    return c.select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"),
                    "label", "qvec")


def _knn_dense(spark, sf, metric, scope=None):
    out = K.knn_dense(_vectors(spark, sf), _centroid_queries(spark, sf), K_DEFAULT, metric,
                      key_cols=("vec_id", "label") if scope is None else ("vec_id",),
                      scope_col=scope)
    return out.select("query_id", "label", "vec_id", "rank", _r6("distance").alias("distance"),
                      _r6("score").alias("score"))


def q_knn_cosine(spark, sf):
    return _knn_dense(spark, sf, "cosine")


def q_knn_l2(spark, sf):
    return _knn_dense(spark, sf, "l2")


def q_knn_per_document(spark, sf):
    return _knn_dense(spark, sf, "cosine", scope="label")


def q_vector_validate(spark, sf):
    return V.vector_validate(_vectors(spark, sf), 64).select(
        "vec_id", "label", "n_dims", "status", "reason")


def q_batch_alignment(spark, sf):
    """Chunks against the stored vectors: a text without tokens has no vector."""
    path, _ = _stored_vectors(spark, sf)
    return V.batch_alignment(corpus_chunks(spark, sf), VS.open_vectors(spark, path), VS.KEYS)


def q_chunk_vector_join(spark, sf):
    path, _ = _stored_vectors(spark, sf)
    texts = corpus_chunks(spark, sf).select(*VS.KEYS, F.length("text").cast("bigint").alias("n_chars"))
    vecs = VS.open_vectors(spark, path).select(*VS.KEYS, F.size("embedding").cast("bigint").alias("n_dims"), "norm")
    return texts.join(vecs, VS.KEYS).select(*VS.KEYS, "n_chars", "n_dims", _r6("norm").alias("norm"))


# --- files ------------------------------------------------------------------------------

def q_file_scan(spark, sf):
    """The files under the folder of the given tables, as the scan finds them."""
    files = scan_parquet_files(spark, sf)
    return files.select("file_name", "file_type", "n_rows", (F.col("n_bytes") > 0).alias("sized"), F.col("modified").isNotNull().alias("dated"))


def q_doc_manifest(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", "url", "html")
    return manifest(p, "url", F.lit(None).cast("timestamp")).select(
        "page_id", "url", "file_name", "file_type",
        F.length("html").cast("bigint").alias("n_chars"))


def q_format_gate(spark, sf):
    return format_gate(q_doc_manifest(spark, sf)).select("page_id", "file_type", "status", "reason")


# --- answers world ----------------------------------------------------------------------

def _case(col: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out


def event_answers(spark, sf) -> DataFrame:
    """(document_id, response_id, metric_id, response) — one JSON answer per event.

    Kinds by event_id mod 10: 0 not JSON, 1 missing keys, 2 value null,
    3 confidence as text with a trend, 4 fenced JSON, 5 literal null,
    6 empty value, 7 confidence 'high', 8 negative value, 9 value with a scale word.
    """
    e = _t(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    units = {m.metric_id: m.unit for m in ESG_CATALOG}
    metric = _case(F.col("event_type"), EVENT_METRIC)
    unit = _case(F.col("event_type"), {e: units[m] for e, m in EVENT_METRIC.items()})
    v = F.format_string("%.2f", F.col("value"))
    kind_no = F.col("event_id") % 10
    vtext = (F.when(kind_no == 8, F.concat(F.lit("-"), v, unit))
             .when(kind_no == 9, F.concat(v, F.lit("萬"), unit)).otherwise(F.concat(v, unit)))
    conf = F.format_string("%.4f", F.least(F.col("value") / F.lit(500.0), F.lit(1.0)))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k < 34, "table").when(k < 67, "text").otherwise("chart")
    src = F.concat(kind, F.lit(":e"), F.col("event_id").cast("string"))
    trend = F.when(F.col("value") < 100, "down").otherwise("up")
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    plain = F.concat(F.lit('{"value":'), q(vtext), F.lit(',"source":'), q(src),
                     F.lit(',"confidence":'), conf, F.lit("}"))
    resp = (F.when(kind_no == 0, F.concat(F.lit("not json: "), v))
            .when(kind_no == 1, F.concat(F.lit('{"value":'), q(vtext), F.lit("}")))
            .when(kind_no == 2, F.concat(F.lit('{"value":null,"source":'), q(src),
                                         F.lit(',"confidence":'), conf, F.lit("}")))
            .when(kind_no == 3, F.concat(F.lit('{"value":'), q(vtext), F.lit(',"source":'), q(src),
                                         F.lit(',"confidence":'), q(conf), F.lit(',"trend":'),
                                         q(trend), F.lit("}")))
            .when(kind_no == 4, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
            .when(kind_no == 5, F.lit("null"))
            .when(kind_no == 6, F.concat(F.lit('{"value":"","source":'), q(src),
                                         F.lit(',"confidence":'), conf, F.lit("}")))
            .when(kind_no == 7, F.concat(F.lit('{"value":'), q(vtext), F.lit(',"source":'), q(src),
                                         F.lit(',"confidence":"high"}')))
            .otherwise(plain))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("document_id"),
                    F.col("event_id").alias("response_id"), metric.alias("metric_id"),
                    resp.alias("response"))


def _parsed(spark, sf):
    # The answers table stands in for stored model output: it is written once
    # to the shared checkpoint folder, so parsing reads a materialised table
    # (and its filters are not pushed back into the generator's single input task).
    return X.parse_responses(materialized(event_answers(spark, sf)))


def _results(spark, sf):
    """Result rows plus the parsed number, unit and source kind of each value."""
    p = X.kept_answers(_parsed(spark, sf))
    rr = X.result_rows(p, ESG_CATALOG, keep_cols=("response_id",))
    num, unit = split_value_unit(F.col("value"))
    return rr.select("*", num.cast("double").alias("value_num"), unit.alias("unit"),
                     F.nullif(F.regexp_extract("source", r"^([a-z]+):", 1), F.lit("")).alias("source_kind"))


def q_response_parse(spark, sf):
    return X.kept_answers(_parsed(spark, sf)).select(
        "document_id", "response_id", "metric_id", "value", "source",
        _r6("confidence").alias("confidence"), "trend")


def q_response_rejects(spark, sf):
    return X.rejected_answers(_parsed(spark, sf), ESG_CATALOG).select(
        "document_id", "response_id", "metric_id", "reason")


def q_answers_with_value(spark, sf):
    return X.kept_answers(_parsed(spark, sf), require_value=True).select(
        "document_id", "response_id", "metric_id", "value", "source",
        _r6("confidence").alias("confidence"), "trend")


def q_result_rows(spark, sf):
    return _results(spark, sf).select(
        "document_id", "response_id", "item", "value", "source", "category", "metric_id",
        _r6("confidence").alias("confidence"), "trend")


def q_ordered_results(spark, sf):
    """ORD-1: documents in order, in each the catalogue's order, by Spark's sort."""
    rows = X.result_rows(_parsed(spark, sf), ESG_CATALOG, ordered=True, keep_cols=("response_id",))
    return rows.select("document_id", "position", "response_id", "item", "value", "category", "metric_id")


def q_confidence_buckets(spark, sf):
    return R.bucket_counts(_results(spark, sf))


def q_confidence_buckets_closed(spark, sf):
    return R.bucket_counts(_results(spark, sf), closed=True)


def q_confidence_share(spark, sf):
    return R.bucket_shares(R.bucket_counts(_results(spark, sf))).withColumn("share", _r6("share"))


def q_category_counts(spark, sf):
    return R.category_counts(_results(spark, sf))


def q_report_rollup(spark, sf):
    return R.report_rollup(_results(spark, sf)).withColumn("avg_confidence", _r6("avg_confidence"))


def q_metric_stats(spark, sf):
    out = R.metric_stats(_results(spark, sf))
    for c in ("avg_confidence", "min_confidence", "max_confidence", "avg_value", "min_value", "max_value"):
        out = out.withColumn(c, _r6(c))
    return out


def q_metric_coverage_gap(spark, sf):
    users = _t(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("document_id")).distinct()
    fan = X.metric_fanout(users, ESG_CATALOG)
    return X.coverage_gap(fan, _results(spark, sf)).select("document_id", "metric_id", "category")


def _obs(spark, sf):
    return _results(spark, sf).withColumnRenamed("value", "value_text") \
        .withColumnRenamed("value_num", "value")


def q_validate_range(spark, sf):
    return V.validate_range(_obs(spark, sf)).select(
        "document_id", "response_id", "metric_id", _r6("value").alias("value"), "vmin", "vmax", "status")


def q_validate_recommended(spark, sf):
    return V.validate_recommended(_obs(spark, sf)).select(
        "document_id", "response_id", "metric_id", _r6("value").alias("value"),
        "recommended_min", "severity")


def q_validate_type(spark, sf):
    return V.validate_type(_obs(spark, sf)).select(
        "document_id", "response_id", "metric_id", "type", "unit", _r6("value").alias("value"), "status")


def q_validate_source(spark, sf):
    return V.validate_source(_obs(spark, sf)).select(
        "document_id", "response_id", "metric_id", "source_kind", "allowed", "status")


def _event_series(spark, sf):
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id").alias("entity"), _case(F.col("event_type"), EVENT_METRIC).alias("metric_id"),
                    F.to_date("ts").alias("period"), "value")


def _trends(spark, sf):
    return V.metric_trend(_event_series(spark, sf), ["entity"])


def q_metric_trend(spark, sf):
    return _trends(spark, sf).select(
        F.col("entity").alias("user_id"), "metric_id", "period", _r6("value").alias("value"),
        _r6("prev_value").alias("prev_value"), "trend")


def q_validate_trend(spark, sf):
    return V.validate_trend(_trends(spark, sf)).select(
        F.col("entity").alias("user_id"), "metric_id", "period", "trend", "declared", "status")


def q_validation_report(spark, sf):
    obs = _obs(spark, sf).withColumn("rid", F.concat_ws("#", "document_id", F.col("response_id").cast("string")))
    return V.validation_report(obs, _trends(spark, sf), "rid")


# --- streaming --------------------------------------------------------------------------

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def q_stream_chunks(spark, sf):
    from docmetrics.streaming.intake import run_chunk_stream
    # The file source watches a folder or a glob; here the glob names the one file.
    out = run_chunk_stream(spark, f"{sf.rstrip('/')}/documents*.parquet", DOCUMENT_SCHEMA,
                           id_col="doc_id")
    return out.select("document_id", "chunk_index", "text")


def q_resent_chunks(spark, sf):
    """Documents streamed into the chunk table, a part of them re-sent (German ones with a word more, French ones empty), then compacted."""
    from docmetrics.streaming import table
    base = scratch_dir(spark, "resent")
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select("doc_id", "text", "lang")
    again = docs.where("lang IN ('de', 'fr')").withColumn("text", F.when(F.col("lang") == "de", F.concat(F.lit("again "), "text")).otherwise(""))
    for i, part in enumerate((docs, again)):
        part.select("doc_id", "text", F.lit(f"2024-01-0{i + 1}").cast("timestamp").alias("version")).write.parquet(f"{base}/in/{i}")
        table.start_upserts(spark, f"{base}/in/*", "doc_id long, text string, version timestamp", f"{base}/table", f"{base}/checkpoint",
                            id_col="doc_id", version_col="version").awaitTermination()
    table.compact(spark, f"{base}/table")
    return table.newest_chunks(spark, f"{base}/table").select("document_id", "chunk_index", "text")


QUERIES = {
    "file_scan": q_file_scan,
    "table_chunks": q_table_chunks,
    "chunk_words_blocks": q_chunk_words_blocks,
    "metric_prompt_plain": q_metric_prompt_plain,
    "report_text": q_report_text,
    "ordered_results": q_ordered_results,
    "resent_chunks": q_resent_chunks,
    "doc_manifest": q_doc_manifest,
    "format_gate": q_format_gate,
    "result_rows": q_result_rows,
    "chunk_metadata": q_chunk_metadata,
    "answers_with_value": q_answers_with_value,
    "confidence_buckets": q_confidence_buckets,
    "confidence_buckets_closed": q_confidence_buckets_closed,
    "response_rejects": q_response_rejects,
    "vector_validate": q_vector_validate,
    "batch_alignment": q_batch_alignment,
    "metric_fanout": q_metric_fanout,
    "knn_cosine": q_knn_cosine,
    "knn_l2": q_knn_l2,
    "chunk_vector_join": q_chunk_vector_join,
    "metric_coverage_gap": q_metric_coverage_gap,
    "knn_per_document": q_knn_per_document,
    "bucket_weights": q_bucket_weights,
    "vector_search": q_vector_search,
    "vector_search_idf": q_vector_search_idf,
    "vector_search_document": q_vector_search_document,
    "confidence_share": q_confidence_share,
    "category_counts": q_category_counts,
    "doc_summary": q_doc_summary,
    "report_rollup": q_report_rollup,
    "metric_stats": q_metric_stats,
    "chunk_union": q_chunk_union,
    "table_verbalize": q_table_verbalize,
    "metric_trend": q_metric_trend,
    "chunk_words": q_chunk_words,
    "chunk_lines": q_chunk_lines,
    "section_split": q_section_split,
    "markdown_elements": q_markdown_elements,
    "table_cells": q_table_cells,
    "metric_candidates": q_metric_candidates,
    "value_normalize": q_value_normalize,
    "hash_embed": q_hash_embed,
    "metric_query_vectors": q_metric_query_vectors,
    "knn_sparse": q_knn_sparse,
    "metric_context": q_metric_context,
    "metric_prompt": q_metric_prompt,
    "extract_metrics": q_extract_metrics,
    "document_answers": q_document_answers,
    "response_parse": q_response_parse,
    "validate_range": q_validate_range,
    "validate_recommended": q_validate_recommended,
    "validate_trend": q_validate_trend,
    "validate_type": q_validate_type,
    "validate_source": q_validate_source,
    "validation_report": q_validation_report,
    "stream_chunks": q_stream_chunks,
}
