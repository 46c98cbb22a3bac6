"""A corpus pipeline: documents -> quality filter -> line dedup -> near-duplicate removal ->
benchmark decontamination -> packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.llm import decontaminate, line_dedup, ngram_join, packing, quality
from docmetrics.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them if there is no label of class 0 to learn from
    (no usable label at all, or class 1 only). With labels of class 0 only no document is accepted. Null and empty
    texts and rows without an id are scored like others; an empty table stays empty; further columns are kept."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    if isinstance(machine, float) and machine >= 0.5:  # a constant: 0.5 without labels, more with class 1 only
        return docs
    return quality.score(docs, machine).where(F.col("score") >= quality.THRESHOLD).select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first one only; the others' texts and lengths change. Null text
    becomes empty; rows without an id keep all lines; an empty table stays empty; further columns are kept."""
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"),
           "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))}
    return out.select(*((new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Repeated rows of one id are one document, of which one row stays. Texts without words (null, empty) are no
    duplicates of one another; rows without an id all stay; an empty table stays empty; further columns are kept."""
    groups = ngram_join.ngram_jaccard_join(docs)
    others = groups.where("component_id != doc_id").select("doc_id")
    kept = docs.join(others, "doc_id", "left_anti")
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    if not ids.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows are one document
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A leak in a row without an id goes by its text; items without words are
    in nothing; null and empty texts stay; without documents or items nothing changes; further columns are kept."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences: packing's columns, not those of documents. Null and empty
    texts are the end token alone; a null id stays null; an empty table has no pieces."""
    return packing.pack_best_fit(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack),
]

#: A fitted classifier, the tokenizer and the packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
