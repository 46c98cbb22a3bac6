"""A table of chunks that takes re-sent documents and is compacted (STR-2, SINK-1).

Layout under one folder: ``data/<name>`` holds the rows of one batch (or of one compaction) and ``_manifest/v=<number>``
one row that lists the live folders. A manifest is written once, by Spark's committer, and the one with the largest
number counts: it is the only point at which a batch or a compaction takes effect. Folders that no live manifest
names (of a job that broke off, or replaced ones) are never read.

* A batch of documents adds its folder. A batch id that is already in is not taken again, so a replay after a
  failure changes nothing; a half-written folder of it is overwritten.
* Readers take each document's newest copy among the live folders (``newest_chunks``).
* ``compact`` writes the newest copies to one folder, sorted by document, and switches the manifest to it alone.
  Queries that opened the table before keep reading the old folders, which stay until ``dead_folders`` are removed.

One writer at a time: a manifest number that another writer has taken meanwhile makes the write fail, and the
loser's folder stays dead.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.functions.text import word_chunks_col

DATA = "document_id string, version timestamp, batch_id long, chunk_index int, text string"
MANIFEST = "number long, live array<string>, batches array<long>, compacted_to long"


def _base(path: str) -> str:
    return path.rstrip("/")


def manifest(spark: SparkSession, path: str) -> dict:
    """The live manifest: number, live folders, ids of the batches that are in beyond ``compacted_to``."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{_base(path)}/_manifest/v=*").orderBy(F.desc("number")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    return rows[0].asDict() if rows else {"number": 0, "live": [], "batches": [], "compacted_to": -1}


def _switch(spark: SparkSession, path: str, old: dict, live: list[str], batches: list[int], compacted_to: int) -> None:
    number = old["number"] + 1
    row = spark.createDataFrame([(number, live, batches, compacted_to)], MANIFEST).coalesce(1)
    row.write.mode("error").json(f"{_base(path)}/_manifest/v={number:09d}")


def has_batch(state: dict, batch_id: int) -> bool:
    return batch_id <= state["compacted_to"] or batch_id in state["batches"]


def add_batch(docs: DataFrame, batch_id: int, path: str) -> bool:
    """Chunk the newest copy per document of (document_id, text, version) and make it live; False if the batch is in.

    A copy without chunks leaves one row without a chunk, so that it replaces an older copy too. Batch ids must
    grow, as those of a stream do."""
    spark = docs.sparkSession
    state = manifest(spark, path)
    if has_batch(state, batch_id):
        return False
    newest = docs.groupBy("document_id").agg(
        F.max_by("text", F.struct("version", F.xxhash64("text"))).alias("text"), F.max("version").alias("version"))
    chunks = newest.select("document_id", F.col("version").cast("timestamp").alias("version"), F.lit(batch_id).cast("long").alias("batch_id"),
                           F.posexplode_outer(word_chunks_col(F.array("text"))).alias("chunk_index", "text"))
    name = f"batch-{batch_id:012d}"
    chunks.write.mode("overwrite").parquet(f"{_base(path)}/data/{name}")
    _switch(spark, path, state, [*state["live"], name], [*state["batches"], batch_id], state["compacted_to"])
    return True


def live_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the live folders; dead folders are not listed."""
    live = manifest(spark, path)["live"]
    if not live:
        return spark.createDataFrame([], DATA)
    return spark.read.schema(DATA).parquet(*(f"{_base(path)}/data/{name}" for name in live))


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each document's newest copy: largest version, then latest batch. Partial aggregation finds it; a
    document sent a million times costs a row per task."""
    rows = live_rows(spark, path)
    newest = rows.groupBy("document_id").agg(F.max(F.struct("version", "batch_id")).alias("n")).select(
        F.col("document_id").alias("_d"), F.col("n.version").alias("_v"), F.col("n.batch_id").alias("_b"))
    same: Column = (F.col("document_id").eqNullSafe(F.col("_d")) & F.col("version").eqNullSafe(F.col("_v")) & (F.col("batch_id") == F.col("_b")))
    return rows.join(newest, same).select(*rows.columns)


def newest_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, version, batch_id, chunk_index, text) of every document's newest copy."""
    return newest_rows(spark, path).where("chunk_index IS NOT NULL")


def compact(spark: SparkSession, path: str) -> str | None:
    """Rewrite the newest copies to one folder and make it the only live one; returns its name (None: nothing to do).

    Emptied copies keep their row, so that a late older copy does not come back. If it breaks off before the
    switch, readers and later batches see nothing of it."""
    state = manifest(spark, path)
    if len(state["live"]) < 2:
        return None
    name = f"compact-{state['number']:09d}-{uuid.uuid4().hex[:8]}"
    newest_rows(spark, path).sortWithinPartitions("document_id", "chunk_index").write.parquet(f"{_base(path)}/data/{name}")
    _switch(spark, path, state, [name], [], max([state["compacted_to"], *state["batches"]]))
    return name


def dead_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders under ``data`` that the live manifest does not name: replaced ones and leavings of broken-off jobs. Remove them when no
    query that opened the table earlier still runs, and no writer either."""
    state = manifest(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{_base(path)}/data").select("path")
    names = files.select(F.regexp_extract("path", r"/data/([^/]+)/[^/]+$", 1).alias("name")).distinct().collect()  # one per batch
    return sorted({r["name"] for r in names} - set(state["live"]))


def start_upserts(spark: SparkSession, source_path: str, schema, path: str, checkpoint: str, id_col: str = "document_id",
                  text_col: str = "text", version_col: str | None = None, max_files_per_trigger: int | None = None):
    """Stream documents into the table: every micro-batch is one ``add_batch``. Returns the StreamingQuery.

    Of the copies of a document the one with the largest ``version_col`` counts (default: modification time of its file)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    version = F.col(version_col) if version_col else F.col("_metadata.file_modification_time")
    docs = reader.parquet(source_path).select(
        F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text"), version.cast("timestamp").alias("version"))
    return (docs.writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, path) and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
