"""Document sources (SRC-1..3).

Input is already-parsed text: a parquet/table of (document_id, text) rows or a
folder of .md/.txt files. File metadata comes from the scan itself
(``_metadata``), not from per-file driver calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values ----------------------------------------------------------------
# Formats the original service accepted, and the text formats this engine reads.
SERVICE_FORMATS = (".pdf", ".docx", ".xlsx")
TEXT_FORMATS = (".md", ".txt")
# ---------------------------------------------------------------------------------


def file_name_col(path: Column, url: bool = True) -> Column:
    """Last path segment. Of a URL, query string and fragment are dropped first; in a plain path
    (``url=False``) ``?`` and ``#`` are letters like others."""
    p = F.regexp_replace(path, r"[?#].*$", "") if url else path
    return F.regexp_extract(p, r"([^/]*)$", 1)


def scanned_path() -> Column:
    """Plain path of a scanned row's file: the scan gives it as a URI, with %-escapes (but a bare ``+``)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_type_col(name: Column) -> Column:
    """Lower-cased suffix with its dot ('' if none; a leading dot is not a suffix)."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def manifest(df: DataFrame, path_col: str, process_time: Column | None = None, url: bool = True) -> DataFrame:
    """SRC-1: adds file_name, file_type and process_time to rows that carry a URL or (``url=False``) a path."""
    name = file_name_col(F.col(path_col), url)
    out = df.withColumn("file_name", name).withColumn("file_type", file_type_col(F.col("file_name")))
    return out.withColumn("process_time",
                          process_time if process_time is not None else F.current_timestamp())


def scan_documents(spark: SparkSession, path: str, fmt: str = "text",
                   process_time: Column | None = None, recursive: bool = False) -> DataFrame:
    """Read parsed documents from files (of folders below too, with ``recursive``).

    ``fmt='text'``: each .md/.txt file is one document (whole text).
    ``fmt='parquet'``: rows already hold document_id and text.
    ``fmt='binary'``: any files (PDF, Word, ...) as bytes with size and
    modification time, for the manifest and the format gate; their text must
    come from a parser upstream, so ``text`` is NULL.
    Returns (document_id, file_name, file_type, process_time, [modified,] text).
    """
    if fmt == "binary":
        df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select(
            scanned_path().alias("_p"), F.col("modificationTime").alias("modified"),
            F.col("length").alias("n_bytes"))
        df = manifest(df, "_p", process_time, url=False)
        return df.select(F.col("_p").alias("document_id"), "file_name", "file_type", "process_time",
                         "modified", "n_bytes", F.lit(None).cast("string").alias("text"))
    if fmt == "parquet":
        df = spark.read.parquet(path).select("document_id", "text", scanned_path().alias("_p"))
        df = manifest(df, "_p", process_time, url=False)
        return df.select("document_id", "file_name", "file_type", "process_time", "text")
    if fmt != "text":
        raise ValueError(f"unsupported format {fmt!r}")
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).text(path) \
        .select(F.col("value").alias("text"), scanned_path().alias("_p"),
                F.col("_metadata.file_modification_time").alias("modified"))
    df = manifest(df, "_p", process_time, url=False)
    return df.select(F.col("_p").alias("document_id"), "file_name", "file_type",
                     "process_time", "modified", "text")


def scan_parquet_files(spark: SparkSession, path: str, process_time: Column | None = None) -> DataFrame:
    """SRC-1 over a folder of parquet files of any schemas, folders below included: document_id (the file's path),
    file_name, file_type, process_time, modified, n_bytes, n_rows. The rows are counted by scanning the files without a column
    of theirs, so only their footers are read."""
    files = scan_documents(spark, path, "binary", process_time, recursive=True).where("file_type = '.parquet'").drop("text")
    rows = spark.read.schema("_none int").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    counts = rows.groupBy(scanned_path().alias("document_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return files.join(counts, "document_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def format_gate(df: DataFrame, allowed=SERVICE_FORMATS + TEXT_FORMATS,
                type_col: str = "file_type") -> DataFrame:
    """SRC-2: status 'accepted' / 'rejected' with a reason, no exception per row."""
    t = F.col(type_col)
    ok = t.isin(*allowed)
    return df.withColumn("status", F.when(ok, "accepted").otherwise("rejected")) \
        .withColumn("reason", F.when(ok, F.lit(None).cast("string"))
                    .when(t == "", F.lit("no file type"))
                    .otherwise(F.concat(F.lit("unsupported file type "), t)))


def identified(df: DataFrame, id_col: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(documents with an id, rejected rows with a ``reason``): a row without an id cannot be chunked, and
    ``partition_chunks`` raises on one."""
    missing = F.col(id_col).isNull()
    return df.where(~missing), df.where(missing).withColumn("reason", F.lit(f"{id_col} is null"))
