"""Greedy word chunking of long texts over several tasks (TXT-1, WIN-1).

The greedy packer is sequential: where a chunk starts depends on all words before it. What a block of text does to it does not:
it turns the size of the chunk that is open when the block begins into the size of the one that is open when it ends,
and closes some chunks on the way. There are ``limit + 1`` sizes, so a block's effect is a small table, made from
the block alone. So

1. a long text is cut at blanks into blocks, which are written (a file is split over tasks) and read in parallel;
2. each block gives its table (``limit + 1`` entries, whatever its length);
3. the tables of one text are composed in order, which gives every block's entry: open size and chunk number;
4. every block emits its words from that entry, again in parallel; a chunk that runs over the end of a block is put
   together from its pieces.

Only step 3 sees a text as a whole, and it sees tables, not words: some 6 KB for a block of a million characters.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.functions.text import CHUNK_LIMIT, by_runs, text_runs, word_chunks_col
from docmetrics.operators.chunk import _keys, numbered, spread
from docmetrics.session import materialized

BLOCK_CHARS = 1 << 20


# --- one block -----------------------------------------------------------------------------

def cut_blocks(text: str | None, size: int = BLOCK_CHARS) -> list[str]:
    """``text`` in blocks of about ``size`` characters, cut at blanks (a longer word stays whole)."""
    out, at = [], 0
    while text and len(text) - at > size:
        cut = at + size
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        out.append(text[at:cut])
        at = cut
    if text and at < len(text):
        out.append(text[at:])
    return out


def _next(cost: list[int], at: int, limit: int) -> int:
    """Where the chunk that starts with word ``at`` ends: its words cost their length plus one, but for the last blank."""
    return max(at + 1, bisect_right(cost, cost[at] + limit + 1) - 1)


def block_table(text: str, limit: int = CHUNK_LIMIT) -> tuple[list[int], list[int]]:
    """(size at the end, chunks closed) for every size 0..limit of the chunk open at the start; size 0 is no open chunk,
    and ``limit`` stands for any size that no word fits behind."""
    cost = list(accumulate((len(w) + 1 for w in text.split()), initial=0))
    words = len(cost) - 1
    if not words:
        return list(range(limit + 1)), [0] * (limit + 1)
    known: dict[int, tuple[int, int]] = {}  # first word of a chunk -> (size at the end, chunks closed behind it)

    def from_word(at: int) -> tuple[int, int]:
        path = []
        while at not in known:
            to = _next(cost, at, limit)
            if to >= words:
                known[at] = (min(limit, cost[words] - cost[at] - 1), 0)
            else:
                path.append(at)
                at = to
        size, closed = known[at]
        for at in reversed(path):
            closed += 1
            known[at] = (size, closed)
        return size, closed

    ends, closes = [], []
    for open_ in range(limit + 1):
        to = bisect_right(cost, limit - open_) - 1  # words that still fit, each with its blank
        if to >= words:
            ends.append(open_ + cost[words])
            closes.append(0)
        else:
            size, closed = from_word(to)
            ends.append(size)
            closes.append(closed + (open_ > 0 or to > 0))
    return ends, closes


def block_pieces(text: str, open_size: int, limit: int = CHUNK_LIMIT) -> list[str]:
    """The block's words, cut where chunks end; the first piece belongs to the chunk open at the start, if one is (it
    is empty if that chunk takes no word of the block)."""
    words = text.split()
    cost = list(accumulate((len(w) + 1 for w in words), initial=0))
    at = bisect_right(cost, limit - open_size) - 1
    out = [" ".join(words[:at])] if at or open_size else []
    while at < len(words):
        to = _next(cost, at, limit)
        out.append(" ".join(words[at:to]))
        at = to
    return out


# --- columns and operator --------------------------------------------------------------------

def _blocks_col(text: Column, size: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        return by_runs(lambda items: [cut_blocks(t, size) for t in items], texts, pa.list_(pa.string()))
    return cut(text)


def block_tables(blocks: DataFrame, keys: list[str], limit: int = CHUNK_LIMIT) -> DataFrame:
    """(keys, _block, text) -> (keys, _block, _ends, _closes). A table may be as large as its block, so a batch's tables
    are made and given out for runs of blocks."""
    kept = [*keys, "_block"]
    schema = T.StructType([*(blocks.schema[c] for c in kept), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("_ends", "_closes"))])

    def table(batches):
        for batch in batches:
            for at, to in text_runs(batch.column("text")):
                run = batch.slice(at, to - at)
                ends, closes = zip(*(block_table(t, limit) for t in run.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in kept), pa.array(ends, pa.list_(pa.int32())), pa.array(closes, pa.list_(pa.int32()))],
                                                 names=[f.name for f in schema])

    return blocks.select(*kept, "text").mapInArrow(table, schema)


def _pieces_col(text: Column, open_size: Column, limit: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        return by_runs(lambda items, open_: [block_pieces(t, n, limit) for t, n in zip(items, open_)], texts, pa.list_(pa.string()), sizes)
    return pieces(text, open_size)


def compose(tables: DataFrame, keys: list[str], limit: int = CHUNK_LIMIT) -> DataFrame:
    """(keys, _block, _ends, _closes) -> (keys, _block, _open, _no): every block's entry. One text's tables
    meet in one group; their number is the text's length over the block size."""
    kept = [tables.schema[k] for k in keys]
    schema = T.StructType([*kept, T.StructField("_block", T.IntegerType()), T.StructField("_open", T.IntegerType()), T.StructField("_no", T.IntegerType())])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        ends = np.array(table["_ends"].combine_chunks().flatten()).reshape(-1, limit + 1)
        closes = np.array(table["_closes"].combine_chunks().flatten()).reshape(-1, limit + 1)
        size, no, sizes, numbers = 0, 0, [], []
        for e, c in zip(ends, closes):
            sizes.append(size)
            numbers.append(no)
            no += int(c[size])
            size = int(e[size])
        return pa.table([*(table[k] for k in keys), table["_block"], pa.array(sizes, pa.int32()), pa.array(numbers, pa.int32())],
                        names=[*keys, "_block", "_open", "_no"])

    return tables.groupBy(*keys).applyInArrow(walk, schema)


def chunk_long_words(docs: DataFrame, key_cols=("document_id",), text_col: str = "text", limit: int = CHUNK_LIMIT,
                     block_chars: int = BLOCK_CHARS) -> DataFrame:
    """TXT-1 for texts of any length: (keys, chunk_index INT, text), the same rows as ``chunk_words``.

    Texts up to ``block_chars`` are chunked in their row; longer ones by blocks, over as many tasks as they have
    blocks. The keys must identify a row (a null key is a key like others). Null and empty texts have no chunks."""
    keys = _keys(key_cols)
    rows = spread(docs.select(*keys, F.col(text_col).alias("text")))
    long = F.coalesce(F.length("text") > block_chars, F.lit(False))
    short = numbered(rows.where(~long), keys, word_chunks_col(F.array("text"), limit))
    blocks = materialized(numbered(rows.where(long), keys, _blocks_col(F.col("text"), block_chars), "_block"), "blocks")
    blocks = blocks.repartition(*keys, "_block")  # a file's blocks may be one split
    entries = compose(block_tables(blocks, keys, limit), keys, limit).select(*(F.col(k).alias(f"of {k}") for k in (*keys, "_block")), "_open", "_no")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"of {k}")) for k in (*keys, "_block")))
    opened = (blocks.join(entries, same)
              .select(*keys, "_block", "_no", _pieces_col(F.col("text"), F.col("_open"), limit).alias("_pieces"))
              .select(*keys, "_block", "_no", F.size("_pieces").alias("_n"), F.posexplode_outer("_pieces").alias("_i", "_piece"))
              .where("_i IS NOT NULL")
              .withColumn("chunk_index", F.col("_no") + F.col("_i")))
    inner = (F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1)
    whole = opened.where(inner).select(*keys, "chunk_index", F.col("_piece").alias("text"))
    joined = (opened.where(~inner & (F.col("_piece") != "")).groupBy(*keys, "chunk_index")
              .agg(F.array_sort(F.collect_list(F.struct("_block", "_piece"))).alias("_s"))
              .select(*keys, "chunk_index", F.array_join(F.transform("_s", lambda x: x["_piece"]), " ").alias("text")))
    return short.unionByName(whole).unionByName(joined)
