"""Per-document text helpers that run inside Arrow UDFs.

Greedy chunking and markdown element splitting are sequential inside one
document, so they run per row in Python (Arrow batches); Spark scales them
across documents. Each helper is linear in the length of its text and never
truncates it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values --------------------------------------------------------------
# Chunk limit: chunk size 1000 minus overlap 200; the overlap is only subtracted.
CHUNK_LIMIT = 800
# A markdown table line starts and ends with a pipe.
TABLE_LINE = r"^[ \t]*\|.*\|[ \t]*$"
# A separator line holds only pipes, colons, dashes and blanks, with a dash.
TABLE_SEPARATOR = r"^[ \t|:-]*-[ \t|:-]*$"
# Section heads for the line chunker: 一、 / 1. / 第一章.
SECTION_HEAD = r"^(?:[一二三四五六七八九十]+、|[0-9]+\.|第[一二三四五六七八九十]+章)"
# -------------------------------------------------------------------------------

_TABLE_LINE_RE = re.compile(TABLE_LINE)
_SECTION_RE = re.compile(SECTION_HEAD)


def greedy_word_chunks(text: str | None, limit: int = CHUNK_LIMIT,
                       max_word: int | None = None) -> list[str]:
    """Pack whitespace-separated words into chunks.

    A word that would push the running size (each word costs its length plus
    one) over ``limit`` starts a new chunk; so the first chunk is at most
    ``limit - 1`` characters and a word longer than the limit is a chunk of its
    own. ``max_word`` (off by default) cuts longer words into pieces first.
    """
    if not text:
        return []
    words = text.split()
    if max_word:
        words = [w[i:i + max_word] for w in words for i in range(0, len(w), max_word)]
    # cost[i]: size of the first i words, each with its blank
    cost = list(accumulate((len(w) + 1 for w in words), initial=0))
    at, to, out = 0, bisect_right(cost, limit) - 1, []
    while at < len(words):
        if to <= at:  # the later chunks' last blank is free; a word over the limit stands alone
            to = max(at + 1, bisect_right(cost, cost[at] + limit + 1) - 1)
        out.append(" ".join(words[at:to]))
        at = to
    return out


def line_chunks(text: str | None, limit: int = CHUNK_LIMIT) -> list[str]:
    """Pack lines into chunks; a section head always opens a new chunk.

    A line joins the current chunk (with a newline) unless the chunk's length
    plus the line's length passes ``limit``. Chunks are stripped; empty ones
    are dropped.
    """
    if text is None:
        return []
    lines = text.split("\n")
    starts, size = [0], 0
    for i, n in enumerate(map(len, lines)):
        if size + n > limit or size and _SECTION_RE.match(lines[i]):
            starts.append(i)
            size = n
        else:
            size += n + 1
    whole = ("\n".join(lines[a:b]).strip() for a, b in pairwise([*starts, len(lines)]))
    return [c for c in whole if c]


def section_numbers(text: str | None) -> list[tuple[int, int, str]]:
    """(line_no, section_no, line) per line; section_no counts heads so far."""
    if text is None:
        return []
    res = []
    sec = 0
    for i, line in enumerate(text.split("\n")):
        if _SECTION_RE.match(line):
            sec += 1
        res.append((i, sec, line))
    return res


def markdown_elements(text: str | None) -> list[tuple[int, str, str]]:
    """Split markdown into blocks (element_index, kind, text): runs of lines of equal kind, joined by newlines.

    A block is a run of table lines or of other lines. Blank lines are dropped; they end a table, but not a
    text, so paragraphs that follow one another are one block.
    """
    if text is None:
        return []
    out: list[tuple[int, str, str]] = []
    kind, run = "", []
    for line in text.split("\n"):
        own = "table" if _TABLE_LINE_RE.match(line) else "text" if line.strip() else ""
        if own == kind or not own and kind == "text":
            run += [line] if own else []
            continue
        if kind:
            out.append((len(out), kind, "\n".join(run)))
        kind, run = own, [line]
    if kind:
        out.append((len(out), kind, "\n".join(run)))
    return out


# --- Arrow UDFs ------------------------------------------------------------------

# Bytes of text that are Python objects at a time: a batch may hold 10,000 texts, whose words, counts and copies
# are many times their size.
SLICE_BYTES = 1 << 18


def text_runs(column: pa.Array, limit: int | None = None):
    """(first, to) of consecutive runs of about ``limit`` bytes of a column of texts or of lists of texts; a longer
    row is a run of its own."""
    limit = limit or SLICE_BYTES
    if pa.types.is_list(column.type):
        lens = pc.fill_null(pc.binary_length(column.flatten()), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        size = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])[ends]
    else:
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield at, to
        at, before = to, int(size[to - 1])


def by_runs(make, column: pa.Array, kind: pa.DataType, *others: pa.Array) -> pa.Array:
    """The array of ``make(values, ...)``, a list per call, for the rows of ``column`` (and ``others``), made run by run."""
    parts = [pa.array(make(*(c.slice(a, b - a).to_pylist() for c in (column, *others))), type=kind) for a, b in text_runs(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


_STR_LIST = pa.list_(pa.string())


@lru_cache(maxsize=None)
def _chunks_of(limit, max_word):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunk_texts(texts: pa.Array) -> pa.Array:
        # texts: array<string> per row; chunk each text, keep order, concatenate.
        return by_runs(lambda items: [[c for t in item or () for c in greedy_word_chunks(t, limit, max_word)] for item in items],
                       texts, _STR_LIST)

    return chunk_texts


def word_chunks_col(texts: Column, limit: int = CHUNK_LIMIT, max_word: int | None = None) -> Column:
    """ARRAY<STRING> of texts -> ARRAY<STRING> of chunks (each text chunked alone)."""
    return _chunks_of(limit, max_word)(texts)


@lru_cache(maxsize=None)
def _lines_of(limit):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunk_lines(texts: pa.Array) -> pa.Array:
        return by_runs(lambda items: [line_chunks(t, limit) for t in items], texts, _STR_LIST)

    return chunk_lines


def line_chunks_col(text: Column, limit: int = CHUNK_LIMIT) -> Column:
    return _lines_of(limit)(text)


_SECTION_TYPE = T.ArrayType(T.StructType([
    T.StructField("line_no", T.IntegerType()),
    T.StructField("section_no", T.IntegerType()),
    T.StructField("line", T.StringType()),
]))
_SECTION_PA = pa.list_(pa.struct([("line_no", pa.int32()), ("section_no", pa.int32()),
                                  ("line", pa.string())]))


@F.arrow_udf(_SECTION_TYPE)
def _sections(texts: pa.Array) -> pa.Array:
    return by_runs(lambda items: [[{"line_no": a, "section_no": b, "line": c} for a, b, c in section_numbers(t)] for t in items],
                   texts, _SECTION_PA)


def sections_col(text: Column) -> Column:
    return _sections(text)


ELEMENT_TYPE = T.ArrayType(T.StructType([
    T.StructField("element_index", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
]))
_ELEMENT_PA = pa.list_(pa.struct([("element_index", pa.int32()), ("kind", pa.string()),
                                  ("text", pa.string())]))


@F.arrow_udf(ELEMENT_TYPE)
def _elements(texts: pa.Array) -> pa.Array:
    return by_runs(lambda items: [[{"element_index": i, "kind": k, "text": s} for i, k, s in markdown_elements(t)] for t in items],
                   texts, _ELEMENT_PA)


def elements_col(text: Column) -> Column:
    return _elements(text)


_DOC_TYPE = T.StructType([
    T.StructField("tables", ELEMENT_TYPE),
    T.StructField("text_chunks", T.ArrayType(T.StringType())),
])
_DOC_PA = pa.struct([("tables", _ELEMENT_PA), ("text_chunks", _STR_LIST)])


@lru_cache(maxsize=None)
def _doc_of(limit, max_word):
    def split(items):
        rows = []
        for t in items:
            el = markdown_elements(t)
            chunks: list[str] = []
            for _, kind, body in el:
                if kind == "text":
                    chunks.extend(greedy_word_chunks(body, limit, max_word))
            rows.append({"tables": [{"element_index": i, "kind": k, "text": b} for i, k, b in el if k == "table"],
                         "text_chunks": chunks})
        return rows

    @F.arrow_udf(_DOC_TYPE)
    def elements_and_chunks(texts: pa.Array) -> pa.Array:
        return by_runs(split, texts, _DOC_PA)

    return elements_and_chunks


def elements_and_chunks_col(text: Column, limit: int = CHUNK_LIMIT,
                          max_word: int | None = None) -> Column:
    """STRUCT<tables, text_chunks>: one Python pass gives the table elements and the chunks of every text element
    (in element order), whose text is not sent back a second time."""
    return _doc_of(limit, max_word)(text)
