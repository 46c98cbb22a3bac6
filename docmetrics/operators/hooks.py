"""Model hooks (UDF-1, UDF-2): user-supplied batch functions run per Arrow batch.

``embedder(list[str]) -> list[list[float]]`` and ``completer(list[str]) ->
list[str]`` are called on batches of ``batch_size`` rows inside tasks
(``mapInArrow``), so a model is loaded once per task, not per row, and the
work scales with the number of partitions. A failing batch fails its task
(and is retried by Spark); a bad answer string is handled later by
``parse_responses``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------------
DEFAULT_BATCH = 32   # rows per model call
# ------------------------------------------------------------------------------------


def _batches(batches, size: int):
    """The rows of Arrow batches in parts of ``size``: no more texts than one call takes are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def _with(part: pa.RecordBatch, values: list, schema: T.StructType, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(values, kind)], names=schema.names)


def embed_with(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]],
               text_col: str = "text", out_col: str = "embedding",
               batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """Adds ``out_col`` ARRAY<FLOAT> from the embedder; other columns pass through."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        for part in _batches(batches, batch_size):
            vecs = embedder([t if t is not None else "" for t in part.column(text_col).to_pylist()])
            if len(vecs) != part.num_rows:
                raise ValueError("embedder returned a different number of vectors")
            yield _with(part, [list(map(float, v)) for v in vecs], schema, pa.list_(pa.float32()))

    return df.mapInArrow(run, schema)


def complete_with(df: DataFrame, completer: Callable[[list[str]], list[str]],
                  prompt_col: str = "prompt", out_col: str = "response",
                  batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """Adds ``out_col`` STRING with the completer's answer to each prompt."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        for part in _batches(batches, batch_size):
            out = completer(part.column(prompt_col).to_pylist())
            if len(out) != part.num_rows:
                raise ValueError("completer returned a different number of answers")
            yield _with(part, [None if x is None else str(x) for x in out], schema, pa.string())

    return df.mapInArrow(run, schema)
