"""Retrieval-to-result operators (JN-1, JN-4, JN-5, RAG-1..5, PRJ-1/2, FLT-1/3, ORD-1).

The catalogue is a literal: the fan-out over documents is an ``inline`` of a
literal array and attribute lookups are ``element_at`` on a literal map, so
neither is a join. Answers are parsed with ``from_json`` against a fixed
schema; a bad answer becomes a reject row with a reason and never fails a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmetrics.catalog import ESG_CATALOG, catalog_array, catalog_map_col
from docmetrics.operators.candidates import (
    BASE_UNITS,
    CATALOG_UNITS,
    metric_candidates,
    normalized_unit,
    normalized_value,
)
from docmetrics.operators.embed import DEFAULT_DIM, query_texts_from_catalog
from docmetrics.operators.idfilter import id_filter, may_be_in
from docmetrics.operators.knn import knn_sparse_text, top_k
from docmetrics.session import materialized

# --- Fixed values ------------------------------------------------------------------
# Confidence bands: high >= 0.8, mid in [0.5, 0.8), low < 0.5.
HIGH = 0.8
MID = 0.5
ANSWER_SCHEMA = "value STRING, source STRING, confidence STRING, trend STRING"
REQUIRED_KEYS = ("value", "source", "confidence")
# -----------------------------------------------------------------------------------

# Prompt sent with the retrieved context; the keys are those that ``parse_responses`` reads.
PROMPT_TEMPLATE = (
    "指標：%s\n只看下列段落，輸出一個 JSON 物件：value 寫數字連同單位，source 寫出處，"
    "confidence 寫 0 到 1 的把握，trend 寫歷年升降（段落沒提就不寫）。"
)
# The shorter question, without history: its answers hold no trend.
PLAIN_TEMPLATE = "指標：%s\n讀下列段落，回答一個 JSON 物件，只有三項：value（數值）、source（出處）、confidence（0 到 1）。"


def catalog_map(catalog=ESG_CATALOG) -> Column:
    """Literal MAP<metric_id, STRUCT<...>> for attribute lookups (JN-4).

    Built from literals only, so the optimizer folds it into one constant.
    """
    return catalog_map_col(catalog)


def metric_fanout(docs: DataFrame, catalog=ESG_CATALOG, key_cols=("document_id",)) -> DataFrame:
    """JN-1: every document x every metric, as a per-row Generate."""
    keys = list(key_cols)
    return docs.select(*keys, F.inline(catalog_array(catalog))) \
        .select(*keys, "cat_ord", "metric_ord", "category", "metric_id", "name")


def coverage_gap(fanout: DataFrame, results: DataFrame,
                 key_cols=("document_id", "metric_id")) -> DataFrame:
    """JN-5: (document, metric) pairs with no result row."""
    return fanout.join(results.select(*key_cols).distinct(), list(key_cols), "left_anti")


# --- answers -------------------------------------------------------------------------

def parse_responses(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """RAG-4: adds value, source, confidence DOUBLE, trend ('' if absent), reason.

    ``reason`` is NULL for a kept answer, 'not an object' for text that is not a
    JSON object (including fenced JSON and ``null``), 'missing key' when value,
    source or confidence is absent. An explicit JSON null is kept as NULL. A
    confidence that does not read as a number becomes NULL.
    """
    r = F.col(response_col)
    keys = F.json_object_keys(r)
    has_all = F.lit(True)
    for k in REQUIRED_KEYS:
        has_all = has_all & F.array_contains(keys, F.lit(k))
    reason = (F.when(keys.isNull(), F.lit("not an object"))
              .when(~has_all, F.lit("missing key")))
    # One parse per answer: the struct is a column of its own, fields are read from it.
    staged = responses.select("*", F.from_json(r, ANSWER_SCHEMA).alias("_p"), reason.alias("reason"))
    return staged.select(
        *[c for c in responses.columns],
        F.col("_p.value").alias("value"), F.col("_p.source").alias("source"),
        F.col("_p.confidence").try_cast("double").alias("confidence"),
        F.coalesce(F.col("_p.trend"), F.lit("")).alias("trend"),
        "reason",
    )


def kept_answers(parsed: DataFrame, require_value: bool = False) -> DataFrame:
    """FLT-3 (+ FLT-1 with ``require_value``)."""
    out = parsed.filter(F.col("reason").isNull())
    if require_value:
        out = out.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    return out


def rejected_answers(parsed: DataFrame, catalog=None) -> DataFrame:
    """Answers that were skipped, with the reason; with a ``catalog`` also those of a metric that it does not hold, which
    ``result_rows`` leaves out."""
    if catalog is not None:
        known = F.element_at(catalog_map(catalog), F.col("metric_id")).isNotNull()
        parsed = parsed.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown metric"))))
    return parsed.filter(F.col("reason").isNotNull())


def result_rows(parsed: DataFrame, catalog=ESG_CATALOG, ordered: bool = False,
                keep_cols=()) -> DataFrame:
    """PRJ-1: document_id, item, value, source, category, metric_id, confidence, trend.

    ``metric_id`` is the catalogue key (not the code). ``ordered`` (ORD-1, for final output) sorts by document and
    catalogue order, then by ``keep_cols``, and adds ``position``, from 1 within the document, which keeps the
    order where a later step does not.
    """
    m = F.element_at(catalog_map(catalog), F.col("metric_id"))
    out = (kept_answers(parsed)
           .withColumn("_m", m).filter(F.col("_m").isNotNull())
           .select("document_id", F.col("_m.name").alias("item"), "value", "source",
                   F.col("_m.category").alias("category"), "metric_id", "confidence", "trend",
                   F.col("_m.cat_ord").alias("cat_ord"), F.col("_m.metric_ord").alias("metric_ord"),
                   *keep_cols))
    if ordered:
        w = Window.partitionBy("document_id").orderBy("cat_ord", "metric_ord", *keep_cols)
        out = out.withColumn("position", F.row_number().over(w)).orderBy("document_id", "position")
    return out


# --- retrieval context and prompts -----------------------------------------------------

def retrieval_context(hits: DataFrame, chunks: DataFrame, key_cols=("document_id", "chunk_index"),
                      group_cols=("query_id",), text_col: str = "text",
                      max_hits: int | None = None, max_broadcast: int = 1_000_000) -> DataFrame:
    """RAG-1: top-k chunk texts per group joined by newlines, best first.

    The hit list (k rows per group) joins the chunk table on its key; adaptive execution broadcasts the
    hits if they turn out small. ``max_hits``, a bound that the caller can prove (k x number of queries),
    asks for the broadcast up front. Each group collects at most k texts. For one context per document,
    group by ("document_id", "query_id").
    """
    keys = list(key_cols)
    groups = list(group_cols)
    h = hits.select(*dict.fromkeys([*groups, *keys]), "rank")
    if max_hits is not None and max_hits <= max_broadcast:
        h = F.broadcast(h)
    j = chunks.select(*keys, text_col).join(h, keys)
    return (j.groupBy(*groups)
            .agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("_s"))
            .select(*groups,
                    F.array_join(F.transform("_s", lambda e: e[text_col]), "\n").alias("context")))


def context_of_hits(hits: DataFrame, group_cols=("query_id",), text_col: str = "text") -> DataFrame:
    """RAG-1 from hits that carry their text (``carry_cols`` of the search): at most k texts per group, best first.
    The chunk table is neither exchanged nor read again."""
    groups = list(group_cols)
    return (hits.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("_s"))
            .select(*groups, F.array_join(F.transform("_s", lambda e: e[text_col]), "\n").alias("context")))


def prompts(contexts: DataFrame, catalog=ESG_CATALOG, id_col: str = "query_id", keep_cols=(), template: str = PROMPT_TEMPLATE) -> DataFrame:
    """RAG-2: (keep_cols, metric_id, prompt) = instruction + retrieved context. ``keep_cols``, such as
    document_id, are the rest of the context's group, which the answers are filed under. ``template``, with one place
    for the metric's name, is PROMPT_TEMPLATE or PLAIN_TEMPLATE (no trend asked for)."""
    m = F.element_at(catalog_map(catalog), F.col(id_col))
    return contexts.withColumn("_m", m).filter(F.col("_m").isNotNull()).select(
        *keep_cols, F.col(id_col).alias("metric_id"),
        F.concat(F.format_string(template, F.col("_m.name")), F.lit("\n\n"),
                 F.col("context")).alias("prompt"))


# --- rule extraction (RAG-3) -----------------------------------------------------------

def _keyword_map(spark, catalog) -> DataFrame:
    pairs = [(m.metric_id, kw) for m in catalog for kw in m.keywords]
    arr = F.array(*[F.struct(F.lit(a).alias("metric_id"), F.lit(b).alias("keyword"))
                    for a, b in pairs])
    return spark.range(1).select(F.inline(arr))


def catalog_candidates(chunks: DataFrame, catalog=ESG_CATALOG, ignore_case: bool = False) -> DataFrame:
    """Candidates of all keywords of the catalogue, with the metric they belong to: one pass over the chunks, no
    exchange of texts. ``chunks``: (document_id, chunk_index, source_kind, text)."""
    keywords = [kw for m in catalog for kw in m.keywords]
    units = BASE_UNITS + CATALOG_UNITS + tuple(m.unit for m in catalog if m.unit)
    cands = metric_candidates(chunks, keywords, ["document_id", "chunk_index"], "text", units=units,
                              ignore_case=ignore_case, keep_cols=("source_kind",))
    return cands.join(F.broadcast(_keyword_map(chunks.sparkSession, catalog)), "keyword")


def extract_metrics(chunks: DataFrame, catalog=ESG_CATALOG, k: int = 3, dim: int = DEFAULT_DIM,
                    char_ngrams: bool = True, ignore_case: bool = False) -> DataFrame:
    """Rule extraction per (document, metric) over the document's top-k chunks.

    ``chunks``: (document_id, chunk_index, source_kind, text). A candidate is a metric keyword (name or alias)
    with a number after it in one of the metric's k nearest chunks of that document. The best candidate wins
    by unit match, shortest gap, chunk rank, chunk index, keyword and match ordinal.

    Candidates come first: they are found in one pass and written (small: a row per match), and only the chunks
    of documents that hold one are tokenised and scored (``idfilter``). Only candidates, hits and the
    filter are exchanged. ``extract_document_metrics`` also chunks those documents only.
    """
    cands = materialized(catalog_candidates(chunks, catalog, ignore_case), "candidates")
    some = may_be_in(chunks, id_filter(cands, ["document_id"]), ["document_id"])
    return _best_candidates(cands, some, catalog, k, dim, char_ngrams)


def extract_document_metrics(docs: DataFrame, chunker, catalog=ESG_CATALOG, k: int = 3, dim: int = DEFAULT_DIM,
                             char_ngrams: bool = True, ignore_case: bool = False) -> DataFrame:
    """``extract_metrics`` from documents (document_id, ...): ``chunker(docs)`` gives their chunks. All documents are
    chunked for the candidates, and those with a candidate again for the scores, so chunk texts are never exchanged."""
    cands = materialized(catalog_candidates(chunker(docs), catalog, ignore_case), "candidates")
    return _best_candidates(cands, chunker(documents_with_candidates(docs, cands)), catalog, k, dim, char_ngrams)


def documents_with_candidates(docs: DataFrame, cands: DataFrame) -> DataFrame:
    """The documents that hold a candidate, and a few others (``idfilter``), whose scores then meet no candidate."""
    return may_be_in(docs, id_filter(cands, ["document_id"]), ["document_id"])


def _best_candidates(cands: DataFrame, chunks: DataFrame, catalog, k: int, dim: int, char_ngrams: bool) -> DataFrame:
    keys = ["document_id", "chunk_index"]
    hits = knn_sparse_text(chunks, query_texts_from_catalog(chunks.sparkSession, catalog), k, keys,
                           scope="document", dim=dim, char_ngrams=char_ngrams) \
        .select(F.col("query_id").alias("metric_id"), *keys, F.col("rank").alias("chunk_rank"), "score")
    j = cands.join(hits, ["metric_id", *keys])
    m = F.element_at(catalog_map(catalog), F.col("metric_id"))
    unit_norm = normalized_unit(F.col("unit"))
    cat_unit = normalized_unit(m["unit"])
    unit_match = (F.when(unit_norm.isNull(), F.lit(0.5))
                  .when(unit_norm == cat_unit, F.lit(1.0)).otherwise(F.lit(0.0)))
    j = j.withColumn("unit_match", unit_match)
    best = top_k(j, ["document_id", "metric_id"],
                 [F.col("unit_match").desc(), F.col("gap"), F.col("chunk_rank"), F.col("chunk_index"),
                  F.col("keyword"), F.col("ordinal")], 1, name="_best")
    conf = F.round(F.lit(0.5) * F.col("unit_match")
                   + F.lit(0.3) / (F.lit(1.0) + F.col("gap") / F.lit(10.0))
                   + F.lit(0.2) * F.greatest(F.col("score"), F.lit(0.0)), 4)
    return best.select(
        "document_id", "metric_id", m["category"].alias("category"), m["name"].alias("item"),
        "keyword", "value_raw", normalized_value(F.col("value_raw"), F.col("scale"), F.col("negative")).alias("value"),
        unit_norm.alias("unit"), "chunk_index", F.col("chunk_rank").alias("rank"), "source_kind",
        F.concat_ws("#", F.col("document_id"), F.col("chunk_index").cast("string")).alias("source"),
        "gap", "score", conf.alias("confidence"),
    )
