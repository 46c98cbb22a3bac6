"""Benchmark decontamination: which documents contain a test item (or at least ``threshold`` of its shingles).

Method: size-partitioned MinHash containment search. A MinHash of a whole long document says next to
nothing about a short item inside it, so sets are compared only with sets of their size class: items are
partitioned by shingle count (1, 2, up to 4, 8, 16, ...), and for each class with upper size u every document is
taken as overlapping windows of 2u shingles, starting every u, so that u consecutive shingles always lie
whole in some window and the containment threshold becomes a Jaccard similarity of at least
``threshold / 2`` or so. Windows and items are compared on ``HASHES`` MinHash values with one row per band:
an equal value is a candidate. At worst an item of just over u/2 shingles has 0.8 of them in a window of 2u:
a Jaccard similarity of 0.4u / 2.1u = 0.19, missed with a probability of 0.81**64, about 1.4e-6. An item of one
shingle is looked up among the document's shingles, which misses none. Window minima are minima of two neighbouring
blocks, and a class's blocks are pairs of the smaller class's, from the smallest class that has items. A candidate is verified by exact containment of
the item's shingles in the whole document's.

Scale: one pass over the documents, without a shuffle; each document is searched where it is read. The
items are the stated query set: they are taken in blocks of at most ``BLOCK_BYTES`` of text (checked by
size before anything is collected), each block a broadcast and a pass; block by block this ends for any
number of items.

Defined results: words are as in ``common``; an item of fewer than k words has its whole sequence as its
one shingle, which equals the shingle of a document only if that is the same short sequence; items or
documents that are null, empty or without words match nothing; null ids are carried as null, and such rows are told apart by their
text where leaks are dropped; repeated
documents are returned each for itself; repeated items (equal texts) are all reported; an empty table on
either side gives an empty result. Sets are of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import Slice, mix64, seeds, text_slices
from docmetrics.session import bound_batches

HASHES = 64
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 20_000
_MULT = seeds(HASHES, salt=0xA11CE)


def _values(shingles: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash function, 32 bits."""
    return ((shingles * _MULT[j]) >> np.uint64(32)).astype(np.uint32)


class Index:
    """A block of items: their shingle sets, and per size class the values of each hash function."""

    def __init__(self, items: list[tuple[int | None, str]], k: int):
        self.k, self.sets, self.ids = k, [], []
        classes: dict[int, list[int]] = defaultdict(list)
        texts = pa.array([t for _, t in items], pa.string())
        for s in text_slices(texts):
            h, bounds = s.shingles(k)
            for d in range(s.n):
                u = np.unique(h[bounds[d]:bounds[d + 1]])
                if len(u):
                    width = 1 << (len(u) - 1).bit_length()
                    classes[width].append(len(self.sets))
                    self.sets.append(u)
                    self.ids.append(items[s.first + d][0])
        self.widths = sorted(classes)
        # (class, hash function) -> sorted values and the items that have them; a bitmap on 16 bits first
        self.tables = {}
        for width, own in classes.items():
            for j in range(HASHES if width > 1 else 1):
                v = np.array([_values(self.sets[i], j).min() for i in own], np.uint32)
                order = np.argsort(v)
                seen = np.zeros(1 << 16, bool)
                seen[v >> np.uint32(16)] = True
                self.tables[width, j] = v[order], np.array(own)[order], seen

    def candidates(self, s: Slice, h: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(text of the slice, item) with an equal MinHash value in some window."""
        out: set[tuple[int, int]] = set()
        n = np.diff(bounds)
        if not self.widths or not len(h):
            return out

        def meet(width: int, j: int, text: np.ndarray, window: np.ndarray) -> None:
            v, item, seen = self.tables[width, j]
            some = np.flatnonzero(seen[window >> np.uint32(16)])
            if len(some):
                lo, hi = np.searchsorted(v, window[some]), np.searchsorted(v, window[some], side="right")
                for w, a, b in zip(some[hi > lo], lo[hi > lo], hi[hi > lo]):
                    out.update((int(text[w]), int(i)) for i in item[a:b])

        if self.widths[0] == 1:
            meet(1, 0, np.repeat(np.arange(s.n), n), _values(h, 0))
        widths = [w for w in self.widths if w > 1]
        if not widths:
            return out
        # Blocks of the smallest class's size, counted from each text's start; the last block of a text is shorter.
        per = -(-n // widths[0])
        first = np.concatenate([[0], np.cumsum(per)])
        text_of = np.repeat(np.arange(s.n), per)
        nth = np.arange(first[-1]) - first[text_of]
        starts = bounds[text_of] + nth * widths[0]
        for j in range(HASHES):
            low = np.minimum.reduceat(_values(h, j), starts)
            text, pos, width = text_of, nth, widths[0]
            while True:
                if width in widths:
                    last = np.empty(len(low), bool)
                    last[-1], last[:-1] = True, text[1:] != text[:-1]
                    window = low.copy()
                    window[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                    meet(width, j, text, window)
                if width >= widths[-1]:
                    break
                pair = pos % 2 == 0  # a block of twice the width: this one and, in the same text, the next
                at = np.flatnonzero(pair)
                low = np.minimum.reduceat(low, at)
                text, pos, width = text[at], pos[at] // 2, width * 2
        return out


def _search(docs: DataFrame, index, threshold: tuple[int, int]) -> DataFrame:
    bound_batches(docs.sparkSession)
    num, den = threshold

    def search(batches) -> Iterator[pa.RecordBatch]:
        items: Index = index.value
        for batch in batches:
            ids, digests = batch.column("doc_id"), batch.column("digest")
            out: list[tuple] = []
            for s in text_slices(batch.column("text")):
                h, bounds = s.shingles(items.k)
                by_text = defaultdict(list)
                for text, item in items.candidates(s, h, bounds):
                    by_text[text].append(item)
                for text, found in by_text.items():
                    own = np.unique(h[bounds[text]:bounds[text + 1]])
                    for item in found:
                        u = items.sets[item]
                        shared = len(np.intersect1d(own, u, assume_unique=True))
                        if den * shared >= num * len(u):
                            out.append((ids[s.first + text].as_py(), digests[s.first + text].as_py(), items.ids[item], shared, len(u)))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "digest", "item_id", "n_shared", "n_item"])

    return docs.mapInArrow(search, "doc_id long, digest string, item_id long, n_shared long, n_item long")


def _digest(id_col: Column, text_col: Column) -> Column:
    """What tells a row without an id: its text's digest. Null for rows with an id."""
    return F.when(id_col.cast("long").isNull(), F.sha2(text_col.cast("binary"), 256))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, k: int,
           threshold: tuple[int, int]) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _digest(F.col(id_col), F.col(text_col)).alias("digest"))
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["b"] or 0) // BLOCK_BYTES))
    spark, found = docs.sparkSession, None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        index = Index([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()], k)
        part = _search(docs, spark.sparkContext.broadcast(index), threshold)
        found = part if found is None else found.unionAll(part)
    return found


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """-> a row per document and item found in it: doc_id, item_id, n_shared, n_item, containment."""
    found = _found(docs, items, id_col, text_col, item_id_col, item_text_col, k, threshold).drop("digest")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns kept. Rows with an id go by it, rows without one by
    their text."""
    hit = _found(docs, items, id_col, text_col, item_id_col, item_text_col, k, threshold)
    hit = hit.select(F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_digest")).distinct()
    same_id = docs[id_col].cast("long").eqNullSafe(hit["_hit_id"])
    return docs.join(hit, same_id & _digest(docs[id_col], docs[text_col]).eqNullSafe(hit["_hit_digest"]), "left_anti")
