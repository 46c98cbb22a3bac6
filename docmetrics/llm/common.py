"""Helpers shared by the operators: tables in the shared folder, and vectorised word hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. All texts of an Arrow batch are hashed
together: a word's 64-bit hash is a polynomial over its bytes, taken as a difference of running sums, so
there is no Python loop over words. Texts are taken in slices of about ``SLICE_BYTES`` so that the
working arrays stay about ten MB whatever the batch holds (one longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from docmetrics.session import scratch_dir

SLICE_BYTES = 1 << 18
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under the shared checkpoint folder and read back: cuts the lineage, so a
    lost executor costs a re-read of files, and a frame used twice is computed once."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    base = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)
    return mix64(base) | _U(1)


_MULT = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BYTE = seeds(256, salt=0xB17E)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        row = np.full(max(n, SLICE_BYTES + 1), base % 2**64, dtype=_U)
        row[0] = 1
        have = _powers[name] = np.multiply.accumulate(row)
    return have[:n]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of ``values``."""
    n = len(values)
    run = np.zeros(n + 1, dtype=_U)
    np.cumsum(values * _power("up", _MULT, n + 1)[:n], out=run[1:])
    down = _power("down", pow(_MULT, -1, 2**64), n + 1)
    h = (run[end] - run[start]) * down[start]
    return mix64(h + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


class Slice:
    """A run of consecutive texts of a batch: its bytes (``raw``, and lower-cased), and the place and text
    of every word.

    ``word_doc`` numbers texts from 0 within the slice; ``first`` is the batch row of text 0.
    """

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, cut_before: bytes = b""):
        self.first, self.n = first, len(offsets) - 1
        off = offsets - offsets[0]
        self.raw, self.offsets = data[offsets[0]:offsets[-1]], off
        raw = self.raw
        self.bytes = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        inside = (raw != 32) & ~((raw >= 9) & (raw <= 13))
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        edges = off[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]  # a word never runs into the next text
        head[edges] = inside[edges]
        tail[edges - 1] = inside[edges - 1]
        if cut_before:  # words also end where one of these bytes follows a letter a-z
            cut = np.isin(self.bytes[1:], np.frombuffer(cut_before, np.uint8)) & (self.bytes[:-1] >= 97) & (self.bytes[:-1] <= 122)
            head[1:] |= cut
            tail[:-1] |= cut
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.word_doc = np.searchsorted(off, self.start, side="right") - 1
        # With empty texts several offsets are equal: the rightmost one owns the bytes.
        self.bounds = np.searchsorted(self.word_doc, np.arange(self.n + 1))

    def word_hashes(self) -> np.ndarray:
        return run_hashes(_BYTE[self.bytes], self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles in order, and the bounds of each text's run. A text of 1 to k-1
        words has one shingle, the whole sequence; one without words has none."""
        w, mult = self.word_hashes(), seeds(k, salt=0x5417)
        count = np.diff(self.bounds)
        m = len(w)
        if m >= k:
            h = np.zeros(m - k + 1, dtype=_U)
            for j in range(k):
                h += w[j:m - k + 1 + j] * mult[j]
            whole = self.word_doc[:m - k + 1] == self.word_doc[k - 1:]
            h, doc = mix64(h[whole]), self.word_doc[:m - k + 1][whole]
        else:
            h, doc = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            own = np.array([int((w[self.bounds[d]:self.bounds[d + 1]] * mult[:count[d]]).sum()) for d in few], dtype=_U)
            own = mix64(own + count[few].astype(_U) * _U(0xD1B54A32D192ED03))
            h, doc = np.concatenate([h, own]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        return h, np.searchsorted(doc, np.arange(self.n + 1))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, cut_before: bytes = b"") -> Iterator[Slice]:
    """The texts of an Arrow column (null: empty) in slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    col = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        to = min(to, len(col))
        yield Slice(at, data, off[at:to + 1], cut_before)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U, copy=False).view(np.int64)
