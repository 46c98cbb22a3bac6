"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.llm import attention_lm, chat, clustering, decontaminate, line_dedup, ngram_join, packing, quality, secret_scan, spelling, url_filter, vector_search, warc
from docmetrics.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, similarity=(85, 100))
    return out.select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page.page_id", "host", "path", "rule", "verdict")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda f: f["kind"].isin("assign", "access", "hex"))
    listed = lambda found: F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    of_kind = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc.doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, machine)
    return out.select("doc.doc_id", quality.held_out(F.col("id")).alias("held_out"), "score",
                      (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_line_dedup, op3_vector_search, op4_url_filter, op5_secret_scan, op6_quality_classifier,
    op7_chat_perspectives, op8_decontamination, op9_warc, op10_best_fit_packing,
    op11_spelling_variants, op12_centroid_clustering, op13_lm_score)}
