"""Incremental intake (STR-1, STR-2) with Structured Streaming.

Chunking is per document and stateless, so the stream needs no watermark or
state store: new files are read with a fixed schema, chunked, and appended
with exactly-once file-sink semantics (checkpoint in the shared folder).
``availableNow`` processes everything present and stops, so the same job runs
as a scheduled batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.functions.text import word_chunks_col
from docmetrics.operators.chunk import chunk_words, document_chunks
from docmetrics.session import scratch_dir


def start_chunk_stream(spark: SparkSession, source_path: str, schema, sink_path: str,
                       checkpoint: str, id_col: str = "document_id", text_col: str = "text",
                       by_elements: bool = False, max_files_per_trigger: int | None = None):
    """STR-1: documents folder -> chunks folder. Returns the StreamingQuery."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_path)
    src = src.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text"))
    if by_elements:
        chunks = document_chunks(src)
    else:
        chunks = chunk_words(src)
    chunks = chunks.withColumn("ingest_time", F.current_timestamp())
    return (chunks.writeStream.format("parquet").option("path", sink_path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def run_chunk_stream(spark: SparkSession, source_path: str, schema, **kw) -> DataFrame:
    """Run STR-1 to completion into a fresh folder and return the chunks read back."""
    base = scratch_dir(spark, "stream_chunks")
    q = start_chunk_stream(spark, source_path, schema, f"{base}/out", f"{base}/checkpoint", **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(f"{base}/out")


def upsert_batches(spark: SparkSession, source_path: str, schema, table_path: str,
                   checkpoint: str, id_col: str = "document_id", text_col: str = "text",
                   version_col: str | None = None):
    """STR-2: a re-sent document replaces its earlier chunks.

    Of the copies of a document in one micro-batch the one with the largest ``version_col`` counts
    (default: modification time of its file; ties go by the text's hash). Its chunks are written with
    version and batch id; a copy without chunks leaves one row without a chunk, so that it replaces too.
    A batch overwrites its own folder only, so a replayed one writes the same rows again. Readers take
    the newest copy per document (``latest_chunks``); write those to a new table to drop old copies.
    """
    version = F.col(version_col) if version_col else F.col("_metadata.file_modification_time")
    docs = spark.readStream.schema(schema).parquet(source_path).select(
        F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text"), version.alias("version"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("document_id").agg(
            F.max_by("text", F.struct("version", F.xxhash64("text"))).alias("text"), F.max("version").alias("version"))
        chunks = newest.select("document_id", "version", F.posexplode_outer(
            word_chunks_col(F.array("text"))).alias("chunk_index", "text"))
        chunks.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")

    return (docs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_chunks(spark: SparkSession, table_path: str) -> DataFrame:
    """Chunks of each document's newest copy: largest version, then latest batch."""
    t = spark.read.parquet(table_path)
    newest = t.groupBy("document_id").agg(F.max(F.struct("version", "batch_id")).alias("n")).select(
        F.col("document_id").alias("_d"), F.col("n.version").alias("_v"), F.col("n.batch_id").alias("_b"))
    same = (F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("batch_id") == F.col("_b")))
    return t.join(newest, same).where(F.col("chunk_index").isNotNull()).select(*t.columns)
