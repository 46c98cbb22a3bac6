"""Reports over result rows (FLT-2, AGG-1..6).

All are grouped aggregations with map-side partial aggregation; the only
window (shares) runs over the already aggregated three rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmetrics.catalog import CATEGORY_LABELS
from docmetrics.operators.extract import HIGH, MID


def bucket_counts(results: DataFrame, group_cols=("document_id",), closed: bool = False,
                  conf_col: str = "confidence") -> DataFrame:
    """FLT-2 + AGG-1: n_high, n_mid, n_low per group in one pass.

    Default bands are disjoint: [0.8, ..), [0.5, 0.8), (.., 0.5). ``closed``
    makes the middle band [0.5, 0.8] inclusive, so 0.8 counts twice.
    """
    c = F.col(conf_col)
    mid = c.between(MID, HIGH) if closed else (c >= MID) & (c < HIGH)
    return results.groupBy(*group_cols).agg(
        F.count_if(c >= HIGH).alias("n_high"),
        F.count_if(mid).alias("n_mid"),
        F.count_if(c < MID).alias("n_low"))


def bucket_shares(buckets: DataFrame, group_cols=("document_id",)) -> DataFrame:
    """AGG-2: long form (group, bucket, n, share of the group's total)."""
    long = buckets.select(*group_cols, F.expr(
        "stack(3, 'high', n_high, 'mid', n_mid, 'low', n_low) as (bucket, n)"))
    w = Window.partitionBy(*group_cols)
    total = F.sum("n").over(w)
    return long.withColumn("share", F.when(total > 0, F.col("n") / total))


def category_counts(results: DataFrame) -> DataFrame:
    """AGG-3: rows per category plus its display label."""
    labels = F.create_map(*[x for kv in CATEGORY_LABELS.items() for x in map(F.lit, kv)])
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("label", F.element_at(labels, F.col("category")))


def report_rollup(results: DataFrame) -> DataFrame:
    """AGG-5: totals per metric, per category and overall (ROLLUP)."""
    c = F.col("confidence")
    return results.rollup("category", "metric_id").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n_results"),
        F.count_if(c >= HIGH).alias("n_high"),
        F.avg(c).alias("avg_confidence"))


def metric_stats(results: DataFrame, value_col: str = "value_num") -> DataFrame:
    """AGG-6: count, mean/min/max confidence and value per metric."""
    c = F.col("confidence")
    v = F.col(value_col)
    return results.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
        F.avg(v).alias("avg_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def doc_summary(documents: DataFrame, chunks: DataFrame, results: DataFrame) -> DataFrame:
    """AGG-4: chunks, tables and results per document; a document without any has zero counts.

    ``chunks`` carries total_chunks / tables_found per row (from the chunker),
    so the per-document numbers need no count over chunks; results are counted
    per document and joined back.
    """
    per_doc = chunks.groupBy("document_id").agg(
        F.max("total_chunks").alias("n_chunks"), F.max("tables_found").alias("n_tables"),
        F.count_if(F.col("source_kind") == "table").alias("n_table_chunks"))
    res = results.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_results"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (documents.select("document_id").distinct().join(per_doc, "document_id", "left").join(res, "document_id", "left")
            .select("document_id", none("n_chunks"), none("n_tables"), none("n_table_chunks"), none("n_results")))


def report_text(documents: DataFrame, chunks: DataFrame, results: DataFrame, finished: Column, name_col: str = "document_id",
                text_col: str = "text") -> DataFrame:
    """D14: (document_id, report): name, size, chunks, tables, metrics found, confidence bands, categories and time of finishing of
    every document, as markdown. Counts are made per document before the join; a document without any has zeros."""
    per_doc = chunks.groupBy("document_id").agg(F.max("total_chunks").alias("n_chunks"), F.max("tables_found").alias("n_tables"))
    c = F.col("confidence")
    found = results.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c >= HIGH).alias("hi"), F.count_if((c >= MID) & (c < HIGH)).alias("mid"), F.count_if(c < MID).alias("lo"),
        *(F.count_if(F.col("category") == k).alias(f"c_{k}") for k in CATEGORY_LABELS))
    n = lambda col: F.coalesce(F.col(col), F.lit(0)).cast("string")
    size = F.format_string("%.2f", F.coalesce(F.octet_length(text_col), F.lit(0)) / 1048576.0)
    lines = [F.concat(F.lit("# "), F.col(name_col)), F.concat(F.lit("- 大小："), size, F.lit(" MB")),
             F.concat(F.lit("- 文字段："), n("n_chunks")), F.concat(F.lit("- 表格："), n("n_tables")), F.concat(F.lit("- 指標："), n("n")),
             F.concat(F.lit("- 把握高／中／低："), n("hi"), F.lit("／"), n("mid"), F.lit("／"), n("lo")),
             *(F.concat(F.lit(f"- {label}："), n(f"c_{k}")) for k, label in CATEGORY_LABELS.items()),
             F.concat(F.lit("- 完成："), F.date_format(finished, "yyyy-MM-dd HH:mm:ss"))]
    joined = documents.join(per_doc, "document_id", "left").join(found, "document_id", "left")
    return joined.select("document_id", F.concat_ws("\n", *lines).alias("report"))
