"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Method: a document is a sparse vector of hashed words (log counts, unit length), of structure
statistics (lengths, shares of capitals, digits, signs, repeated words, ... each as one of 32 bins) and of
metadata (the stored character count, as a bin). The score is the logistic of
``w0 + sum(w_i x_i) + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2)``: all pairwise interactions of the
features through ``FACTORS`` latent factors, in time linear in the number of features.

The machine is fitted with AdaGrad on a bounded sample of labelled rows: at most ``sample_rows`` (id, label) pairs whose
document is there, the first by a hash of the id, and at most ``sample_features`` feature values altogether (3 million are some 24 MB on the
driver). Both are arguments. Of repeated rows of an id the one of smallest text hash is learned from. Everything else covers all documents: scoring is one pass without a shuffle, with the weights
(fixed size, 2.4 MB) broadcast. Labels, language, source and id are never features.

Defined results: null or empty text is scored by its statistics (no words); a null character count is the
text's own length; rows with a null id are scored and never learned from; a document with several labels
is learned from with each of them; labels that are null are skipped; without any label every score is 0.5,
with labels of one class only it is that class's share with one pseudo-row per class. Rows are scored one
by one, so repeated rows get equal scores; repeated labels of an id count once. Further columns are returned untouched inside the struct ``doc``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.llm.common import Slice, text_slices
from docmetrics.session import bound_batches

WORD_BITS = 16
BINS = 32
FACTORS = 8
SAMPLE_ROWS = 8_000
SAMPLE_FEATURES = 3_000_000
EPOCHS, BATCH, RATE, SHRINK = 5, 64, 0.1, 1e-5
THRESHOLD = 0.7
STATS = ("words", "bytes", "word length", "distinct words", "top word", "same word again", "capitals", "digits", "signs",
         "exclamation marks", "bars", "line ends", "other bytes", "stored length", "stored length against text")
DIM = (1 << WORD_BITS) + BINS * len(STATS)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(s: Slice, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, bounds of each text's run) of a slice."""
    words = np.diff(s.bounds)
    bucket = (s.word_hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair, count = np.unique((s.word_doc.astype(np.int64) << WORD_BITS) | bucket, return_counts=True)
    doc, feature = pair >> WORD_BITS, pair & ((1 << WORD_BITS) - 1)
    value = np.log1p(count)
    value /= np.sqrt(np.bincount(doc, value**2, minlength=s.n))[doc]

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return run[s.offsets[1:]] - run[s.offsets[:-1]]

    raw, size = s.raw, np.diff(s.offsets)
    capital, digit, other = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), raw >= 128
    letter = capital | ((raw >= 97) & (raw <= 122))
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    again = np.zeros(len(s.word_doc), bool)
    if len(again) > 1:
        again[1:] = (bucket[1:] == bucket[:-1]) & (s.word_doc[1:] == s.word_doc[:-1])
    top = np.zeros(s.n)
    np.maximum.at(top, doc, count)
    share = lambda part, whole: np.sqrt(part / np.maximum(whole, 1)) * (BINS - 1)
    chars = size - total((raw & 0xC0) == 0x80)
    stored = np.where(np.isnan(n_chars), chars, n_chars)
    stats = np.stack([np.log2(words + 1) * 1.5, np.log2(size + 1) * 1.5, size / np.maximum(words, 1) * 2, share(np.bincount(doc, minlength=s.n), words),
                      share(top, words), share(np.bincount(s.word_doc[again], minlength=s.n), words), share(total(capital), total(letter)),
                      share(total(digit), size), share(total(~(letter | digit | other | blank)), size), share(total(raw == 33), size),
                      share(total(raw == 124), size), share(total(raw == 10), words), share(total(other), size),
                      np.log2(np.maximum(stored, 0) + 1) * 1.5, share(np.minimum(np.abs(stored - chars), chars), chars)], axis=1)
    bins = np.clip(stats, 0, BINS - 1).astype(np.int64) + np.arange(len(STATS)) * BINS + (1 << WORD_BITS)
    doc = np.concatenate([doc, np.repeat(np.arange(s.n), len(STATS))])
    feature = np.concatenate([feature, bins.ravel()])
    value = np.concatenate([value, np.full(bins.size, 1 / np.sqrt(len(STATS)))]).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    return feature[order].astype(np.int32), value[order], np.searchsorted(doc[order], np.arange(s.n + 1))


class FactorisationMachine:
    def __init__(self, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(DIM, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (DIM, FACTORS)).astype(np.float32)

    def margin(self, feature: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Every run has features (the statistics), so reduceat sees no empty run."""
        vx = self.v[feature] * value[:, None]
        both = np.add.reduceat(vx, bounds[:-1])
        alone = np.add.reduceat(vx * vx, bounds[:-1])
        return self.w0 + np.add.reduceat(self.w[feature] * value, bounds[:-1]) + 0.5 * (both**2 - alone).sum(axis=1)

    def score(self, feature, value, bounds) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(feature, value, bounds).astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> FactorisationMachine:
        order = np.random.default_rng(11)
        gw0, gw, gv = 1e-8, np.full(DIM, 1e-8, np.float32), np.full((DIM, FACTORS), 1e-8, np.float32)
        for _ in range(EPOCHS):
            shuffled = order.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                part = [rows[i] for i in shuffled[at:at + BATCH]]
                feature, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
                n = np.array([len(r[0]) for r in part])
                bounds = np.concatenate([[0], np.cumsum(n)])
                g = ((self.score(feature, value, bounds) - np.array([r[2] for r in part])) / len(part)).astype(np.float32)
                vx = self.v[feature] * value[:, None]
                both = np.add.reduceat(vx, bounds[:-1])
                gx = np.repeat(g, n) * value
                used, slot = np.unique(feature, return_inverse=True)
                dw = np.bincount(slot, gx, minlength=len(used)).astype(np.float32) + SHRINK * self.w[used]
                pull = gx[:, None] * (np.repeat(both, n, axis=0) - vx)
                dv = np.stack([np.bincount(slot, pull[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1).astype(np.float32)
                dv += SHRINK * self.v[used]
                gw0 += float(g.sum())**2
                self.w0 -= RATE * float(g.sum()) / gw0**0.5
                gw[used] += dw**2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                gv[used] += dv**2
                self.v[used] -= RATE * 0.5 * dv / np.sqrt(gv[used])
        return self


def _rows(docs: DataFrame, id_col: str, text_col: str, chars_col: str | None) -> DataFrame:
    bound_batches(docs.sparkSession)
    chars = F.col(chars_col).cast("double") if chars_col else F.lit(None).cast("double")
    return docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), chars.alias("chars"))


def _chars(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("chars").to_numpy(zero_copy_only=False).astype(float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> FactorisationMachine | float:
    """The fitted machine, or a constant score where the labels hold fewer than two classes."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    there = docs.select(F.col(id_col).cast("long").alias("id"))
    sample = known.distinct().join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)  # bounded, so it may be broadcast
    rows = _rows(docs, id_col, text_col, chars_col).select("id", F.struct("text", "chars").alias("row")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("id", "label", "row.text", "row.chars")

    def extract(batches):
        for batch in batches:
            label, chars = batch.column("label").to_numpy(), _chars(batch)
            for s in text_slices(batch.column("text")):
                feature, value, bounds = features(s, chars[s.first:s.first + s.n])
                runs = list(zip(bounds[:-1], bounds[1:]))
                yield pa.record_batch([batch.column("id").slice(s.first, s.n), pa.array(label[s.first:s.first + s.n], pa.int32()),
                                       pa.array([feature[a:b].tobytes() for a, b in runs], pa.binary()),
                                       pa.array([value[a:b].tobytes() for a, b in runs], pa.binary())], names=["id", "label", "feature", "value"])

    got, size = [], 0
    extracted = rows.mapInArrow(extract, "id long, label int, feature binary, value binary")
    for r in extracted.orderBy(F.xxhash64("id"), "id", "label").toLocalIterator():
        size += len(r["feature"]) // 4
        if size > sample_features:
            break
        got.append((np.frombuffer(r["feature"], np.int32), np.frombuffer(r["value"], np.float32), r["label"]))
    ones = sum(r[2] for r in got)
    if ones in (0, len(got)):
        return (ones + 1) / (len(got) + 2)
    return FactorisationMachine().fit(got)


def score(docs: DataFrame, machine: FactorisationMachine | float, id_col: str = "doc_id", text_col: str = "text",
          chars_col: str | None = "n_chars") -> DataFrame:
    """-> doc (the input row as a struct), id, score."""
    rows = _rows(docs, id_col, text_col, chars_col)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def apply(batches):
        fm = model.value
        for batch in batches:
            chars, parts = _chars(batch), [np.zeros(0)]
            for s in text_slices(batch.column("text")):
                parts.append(np.full(s.n, fm) if isinstance(fm, float) else fm.score(*features(s, chars[s.first:s.first + s.n])))
            yield pa.record_batch([batch.column("doc"), batch.column("id"), pa.array(np.concatenate(parts))], names=["doc", "id", "score"])

    out = T.StructType([rows.schema["doc"], T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(apply, out)
