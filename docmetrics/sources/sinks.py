"""Sinks (SINK-1..4): vector and result tables as files.

Writes are set-wise (one job per table, not a call per row). Vectors are
sorted by document inside files so a document's rows sit together and parquet
min/max statistics can skip files on a document filter; they are not
partitioned by document (far too many folders).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """SINK-1/2: append to, or replace, a vector table."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    (vectors.sortWithinPartitions("document_id", "chunk_index")
     .write.mode(mode).parquet(path))


def write_vectors_table(vectors: DataFrame, name: str, mode: str = "append") -> None:
    """SINK-2 for catalogued tables: reuse (append) or recreate (overwrite) ``name``."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    (vectors.sortWithinPartitions("document_id", "chunk_index")
     .write.mode(mode).format("parquet").saveAsTable(name))


def clear_vectors(spark: SparkSession, path: str, schema) -> None:
    """SINK-3: replace the table with an empty one of the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def drop_table(spark: SparkSession, name: str) -> None:
    """SINK-3 for catalogued tables."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SINK-4: result rows as parquet or CSV with a header.

    Arrays, maps and structs are not CSV-able: they are written as JSON text.
    """
    cols = []
    for f in results.schema.fields:
        name = f.dataType.typeName()
        if fmt == "csv" and name in ("array", "map", "struct"):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    w = results.select(*cols).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def dedup_latest(df: DataFrame, key_cols=("document_id", "chunk_index"),
                 order_col: str = "ingest_time", entity_cols=("document_id",)) -> DataFrame:
    """STR-2 on read: the chunks of each document's newest copy (largest ``order_col``), one row per chunk.

    The newest copy is decided per document, so a copy with fewer chunks leaves none of an older one
    behind. Both steps aggregate partially before the shuffle; a chunk sent a million times costs one row
    per task.
    """
    keys = list(key_cols)
    newest = df.groupBy(*(F.col(c).alias(f"_{c}") for c in entity_cols)).agg(F.max(order_col).alias("_newest"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in entity_cols))
    rows = df.join(newest, same & F.col(order_col).eqNullSafe(F.col("_newest"))).select(*df.columns)
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order_col))).alias("_n")) \
        .select(*keys, *[F.col(f"_n.{c}").alias(c) for c in rest])
