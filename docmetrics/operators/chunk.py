"""Chunking operators (TXT-1, TXT-2, TXT-3..5, WIN-1, WIN-2, SET-1).

Everything here is per document row: elements, tables, their text and the
chunk lists are computed inside the row (array functions plus one Arrow UDF
call), so no step shuffles the corpus. Chunk numbers come from ``posexplode``
over the ordered chunk array instead of a window over the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.functions.text import (
    CHUNK_LIMIT,
    TABLE_SEPARATOR,
    elements_col,
    line_chunks_col,
    sections_col,
    elements_and_chunks_col,
    word_chunks_col,
)
from docmetrics.session import bound_batches


def _keys(key_cols) -> list[str]:
    return [key_cols] if isinstance(key_cols, str) else list(key_cols)


def parallelism(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def spread(docs: DataFrame) -> DataFrame:
    """Round-robin the input when it has fewer partitions than the cluster has cores.

    A large corpus arrives in many file splits and is left alone; a few big
    row groups (one file per table in tests) would otherwise run the
    per-document Python work on a handful of tasks. Whatever the input, the
    session's Arrow batches are bounded in bytes (``bound_batches``).
    """
    bound_batches(docs.sparkSession)
    if docs.isStreaming:
        return docs
    # An input that already shuffles has its parallelism set; asking such a
    # plan for its partition count would run its shuffle stages (adaptive
    # execution plans them eagerly), so only plain scans are counted.
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        return docs
    n = parallelism(docs.sparkSession)
    if docs.rdd.getNumPartitions() < n:
        return docs.repartition(n)
    return docs


def numbered(rows: DataFrame, kept, array: Column, index: str = "chunk_index", value: str = "text") -> DataFrame:
    """(kept, index, value): the array's elements with their positions. For the inner explode Spark infers a filter on
    the array, which it pushes below joins and exchanges: an array that Python makes would be made twice, once on all
    rows. The outer one with a filter behind it gives the same rows."""
    return rows.select(*kept, F.posexplode_outer(array).alias(index, value)).where(F.col(index).isNotNull())


def _inlined(rows: DataFrame, kept, structs: Column, first: str) -> DataFrame:
    """``inline`` in the same way; ``first`` is a field that is never null."""
    return rows.select(*kept, F.inline_outer(structs)).where(F.col(first).isNotNull())


def partition_chunks(chunks: DataFrame, key_cols=("document_id", "chunk_index")) -> DataFrame:
    """Hash-partition chunk rows on their key with a fixed partition count.

    Downstream token explosion, per-bucket counts, norms and per-chunk scores
    are grouped on keys that contain this one, so they need no further
    exchange; a long document's chunks spread over all partitions. The count
    is explicit so adaptive execution does not merge these small-in-bytes but
    CPU-heavy partitions; every branch that reads the result reuses the one
    exchange.
    """
    keys = _keys(key_cols)
    # A NULL key raises (``identified`` sorts such rows out at the source). Stating then that keys are not
    # NULL keeps joins from pushing an inferred filter into one consumer only, which would make the
    # branches differ and defeat exchange reuse.
    types = {f.name: f.dataType for f in chunks.schema.fields}
    checked = chunks.select(*(
        F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} of a chunk is null")).cast(types[c])).alias(c) if c in keys else F.col(c)
        for c in chunks.columns))
    not_null = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return checked.filter(not_null).repartition(parallelism(chunks.sparkSession), *keys)


def chunk_words(docs: DataFrame, key_cols=("document_id",), text_col: str = "text",
                limit: int = CHUNK_LIMIT, max_word: int | None = None) -> DataFrame:
    """TXT-1: whole text -> (keys, chunk_index INT, text)."""
    keys = _keys(key_cols)
    return numbered(spread(docs.select(*keys, text_col)), keys, word_chunks_col(F.array(F.col(text_col)), limit, max_word))


def chunk_lines(docs: DataFrame, key_cols=("document_id",), text_col: str = "text",
                limit: int = CHUNK_LIMIT) -> DataFrame:
    """TXT-2: line packing with section heads as hard breaks."""
    keys = _keys(key_cols)
    return numbered(spread(docs.select(*keys, text_col)), keys, line_chunks_col(F.col(text_col), limit))


def section_split(docs: DataFrame, key_cols=("document_id",), text_col: str = "text") -> DataFrame:
    """TXT-2 heads: every line with the number of section heads up to it."""
    keys = _keys(key_cols)
    return _inlined(spread(docs.select(*keys, text_col)), keys, sections_col(F.col(text_col)), "line_no")


# --- markdown elements and tables -----------------------------------------------------

def with_elements(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``elements`` ARRAY<STRUCT<element_index, kind, text>> (TXT-3)."""
    return spread(docs).withColumn("elements", elements_col(F.col(text_col)))


def markdown_elements(docs: DataFrame, key_cols=("document_id",), text_col: str = "text") -> DataFrame:
    keys = _keys(key_cols)
    return _inlined(with_elements(docs, text_col), keys, F.col("elements"), "element_index")


def _lines(t: Column) -> Column:
    return F.split(t, "\n")


def row_cells(line: Column) -> Column:
    """Cells of one table line: outer pipes dropped, split on pipes, blanks trimmed."""
    inner = F.regexp_replace(line, r"^[ \t]*\|?|\|?[ \t]*\z", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def _is_parsed_table(e: Column) -> Column:
    lines = _lines(e["text"])
    return (e["kind"] == "table") & (F.size(lines) >= 2) & \
        F.element_at(lines, 2).rlike(TABLE_SEPARATOR)


def parsed_tables_col(elements: Column) -> Column:
    """Table elements that parse (header plus separator line), in document order."""
    return F.filter(elements, _is_parsed_table)


def verbalize_table(table_text: Column, table_no: Column) -> Column:
    """TXT-5: '\\n表格 i:\\n欄位: a, b\\n' + header and body rows, cells blank-joined."""
    lines = _lines(table_text)
    rows = F.filter(lines, lambda l, i: i != 1)
    body = F.array_join(F.transform(rows, lambda r: F.array_join(row_cells(r), " ")), "\n")
    return F.concat(
        F.lit("\n表格 "), table_no.cast("string"), F.lit(":\n欄位: "),
        F.array_join(row_cells(F.element_at(lines, 1)), ", "), F.lit("\n"), body, F.lit("\n"),
    )


def verbalize_sheet(table_text: Column, sheet_name: Column) -> Column:
    """TXT-6: '\n工作表: name\n' + header and body rows, cells blank-joined."""
    lines = _lines(table_text)
    rows = F.filter(lines, lambda l, i: i != 1)
    body = F.array_join(F.transform(rows, lambda r: F.array_join(row_cells(r), " ")), "\n")
    return F.concat(F.lit("\n工作表: "), sheet_name, F.lit("\n"), body, F.lit("\n"))


def tables_text_col(elements: Column) -> Column:
    """All parsed tables of a document as one text, table numbers from 1 (WIN-2)."""
    tables = parsed_tables_col(elements)
    return F.array_join(
        F.transform(tables, lambda t, i: verbalize_table(t["text"], i + 1)), "")


def parsed_tables(docs: DataFrame, key_cols=("document_id",), text_col: str = "text") -> DataFrame:
    """(keys, table_no INT from 1, element_index, text) for tables that parse."""
    keys = _keys(key_cols)
    return (numbered(with_elements(docs, text_col), keys, parsed_tables_col(F.col("elements")), "pos", "t")
            .select(*keys, (F.col("pos") + 1).alias("table_no"),
                    F.col("t.element_index").alias("element_index"),
                    F.col("t.text").alias("text")))


def table_verbalize(docs: DataFrame, key_cols=("document_id",), text_col: str = "text") -> DataFrame:
    keys = _keys(key_cols)
    return parsed_tables(docs, keys, text_col).select(
        *keys, "table_no", verbalize_table(F.col("text"), F.col("table_no")).alias("text"))


def table_cells(docs: DataFrame, key_cols=("document_id",), text_col: str = "text") -> DataFrame:
    """TXT-4: long-form cells; first line is the header, the separator is dropped.

    Ragged rows: a missing cell is NULL, an extra cell has a NULL header.
    """
    keys = _keys(key_cols)
    t = parsed_tables(docs, keys, text_col)
    rows = t.select(*keys, "table_no",
                    row_cells(F.element_at(_lines(F.col("text")), 1)).alias("header"),
                    F.posexplode(_lines(F.col("text"))).alias("line_pos", "line"))
    rows = rows.filter(F.col("line_pos") >= 2).select(
        *keys, "table_no", "header", (F.col("line_pos") - 1).alias("row_no"),
        row_cells(F.col("line")).alias("cells"))
    n = F.greatest(F.size("header"), F.size("cells"))
    return rows.select(
        *keys, "table_no", "row_no", "header", "cells",
        F.posexplode(F.sequence(F.lit(1), n)).alias("_p", "col_no"),
    ).select(
        *keys, "table_no", "row_no", "col_no",
        F.get(F.col("header"), F.col("col_no") - 1).alias("header"),
        F.get(F.col("cells"), F.col("col_no") - 1).alias("value"),
    )


def chunk_lists(docs: DataFrame, key_cols=("document_id",), text_col: str = "text",
                limit: int = CHUNK_LIMIT, max_word: int | None = None, keep_cols=()) -> DataFrame:
    """WIN-1 + SET-1 with a document's chunks in its row: (keys, *keep_cols, tables_found INT, n_text INT, chunks ARRAY<STRING>),
    where the first ``n_text`` chunks are text and the others table chunks."""
    keys = _keys(key_cols)
    keep = list(keep_cols)
    # One Python pass: table elements and the chunks of the text elements. Tables are
    # verbalised in the JVM; only that (usually empty) text
    # goes back to Python for chunking.
    el = spread(docs.select(*keys, *keep, text_col)).select(
        *keys, *keep, elements_and_chunks_col(F.col(text_col), limit, max_word).alias("_d"))
    elements = F.col("_d.tables")
    staged = el.select(
        *keys, *keep,
        F.col("_d.text_chunks").alias("text_chunks"),
        word_chunks_col(F.array(tables_text_col(elements)), limit, max_word).alias("table_chunks"),
        F.size(parsed_tables_col(elements)).alias("tables_found"),
    )
    return staged.select(*keys, *keep, "tables_found", F.size("text_chunks").alias("n_text"),
                         F.concat("text_chunks", "table_chunks").alias("chunks"))


def document_chunks(docs: DataFrame, key_cols=("document_id",), text_col: str = "text",
                    limit: int = CHUNK_LIMIT, max_word: int | None = None,
                    keep_cols=()) -> DataFrame:
    """WIN-1 + SET-1: text elements chunked one by one, then all tables chunked as one text.

    Output (keys, chunk_index INT from 0, source_kind 'text'|'table', text,
    total_chunks INT, tables_found INT, *keep_cols).
    """
    keys = _keys(key_cols)
    keep = list(keep_cols)
    lists = chunk_lists(docs, keys, text_col, limit, max_word, keep)
    total = F.size("chunks").alias("total_chunks")
    return numbered(lists, [*keys, *keep, "tables_found", "n_text", total], F.col("chunks")).select(
        *keys, "chunk_index",
        F.when(F.col("chunk_index") < F.col("n_text"), F.lit("text"))
        .otherwise(F.lit("table")).alias("source_kind"),
        "text", "total_chunks", "tables_found", *keep,
    )


def chunk_metadata_map(chunks: DataFrame, doc_cols=("total_chunks", "tables_found"),
                       key_cols=("document_id", "chunk_index")) -> DataFrame:
    """PRJ-2: a MAP<STRING,STRING> per chunk: the document's metadata, then
    ``chunk_index`` and ``document_id`` — later keys win, as in a dict merge."""
    keys = _keys(key_cols)
    doc = F.create_map(*[x for c in doc_cols for x in (F.lit(c), F.col(c).cast("string"))])
    own = F.create_map(*[x for c in reversed(keys) for x in (F.lit(c), F.col(c).cast("string"))])
    return chunks.withColumn("metadata", F.map_concat(doc, own))
