"""Spelling variant grouping: words that differ by one inserted, deleted or replaced code point.

Method: a variable-length gram index. All grams of ``QMIN`` to ``QMAX`` code points of the words are counted, and
the frequent ones (more than ``LIST`` words and more than a share of all grams) make the gram dictionary:
a trie in which a frequent gram is always extended by one more code point and an infrequent one is
a leaf, so the grams of frequent letter pairs become longer and their lists shorter. A word (with a mark at both ends) is
decomposed from every position into the leaf met there; grams inside an earlier gram are dropped.
For every place of the word the trie tells how many of its grams one edit there can touch: those over the
place, those before it that could now reach further, and those after it that a gram from before could now cover.
The most over all places is the word's bound ``touched``. Words at distance one therefore share all of a word's grams but
``touched``, each at the same position or, behind an inserted or deleted code point, one further. So of the lists of a
word's grams only the ``touched + 1`` rarest need merging: a near word is in one of them, and among its own
``touched + 1`` rarest. Lists are keyed by gram, position and word length; what meets is verified by the edit distance.
Two words that one edit may touch in all grams (both bounds reach the number of grams) are found by their
one-code-point deletions instead, which is exact too.

Scale: words are counted per task before the shuffle. The dictionary has at most ``1 << DICTIONARY_BITS`` grams of
each length by construction (a gram is in it if it holds more than that share of all grams), whatever the words are, and is
broadcast. The merge is an equi-join of word rows on gram keys; a long list is a skewed key, which adaptive execution
splits. Forms are followed by pointer doubling, so a chain of n takes log2(n) joins.

Defined results: null and empty texts have no words; a null id is written as ``null`` before the colon; repeated rows of
a document count again each; runs are matched over whole texts however long; ties among near words go to the smallest
in code-point order; an empty table gives an empty result; further columns are not looked at. The words' letters must be
those of Latin-1, as those of ``LETTERS``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize, mix64

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 7, 2
QMIN, QMAX = 2, 5
LIST = 64  # grams of at most so many words are never extended
DICTIONARY_BITS = 17
DAMAGE = 31  # one run in so many, by hash, has a code point deleted
TASK_WORDS = 200_000  # distinct words a task counts before it gives them out
_U = np.uint64


def _runs(text: str, pattern: re.Pattern) -> Counter:
    if len(text) < 1 << 20:
        return Counter(pattern.findall(text.encode().lower().decode()))
    return Counter(m.group().encode().lower().decode() for m in pattern.finditer(text))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of all documents, after ``damage``."""
    pattern = re.compile(f"[{LETTERS}]{{{least_letters},}}")  # shorter runs give no word, damaged or not

    def count(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for i, doc in enumerate(ids):
                for run, n in _runs(texts[i].as_py() or "", pattern).items():
                    h = zlib.crc32(f"{doc}:{run}".encode())
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_letters:
                            continue
                    seen[run] += n
                if len(seen) > TASK_WORDS:
                    yield given()
        yield given()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their code points with a mark at both ends), a matrix for each length."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        step = max(1, 400_000 // int(n))
        for at in range(0, len(own), step):
            some = own[at:at + step]
            x = np.zeros((len(some), n + 2), np.int64)
            x[:, 0], x[:, -1] = 1, 2
            x[:, 1:-1] = np.frombuffer("".join([words[i] for i in some]).encode("latin-1"), np.uint8).reshape(len(some), n)
            yield some, x


def _codes(x: np.ndarray, n: int) -> np.ndarray:
    """The gram of n code points at every position, as a number that tells its length too."""
    out = np.full((x.shape[0], x.shape[1] - n + 1), n, np.int64)
    for j in range(n):
        out = out << 8 | x[:, j:x.shape[1] - n + 1 + j]
    return out


def _member(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(codes.shape, bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)] == codes


class GramDictionary:
    """Frequent grams, rarest first; those shorter than QMAX are the inner nodes of the trie."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.lexsort((grams, counts))
        rank = np.empty(len(grams), np.int64)
        rank[order] = np.arange(1, len(grams) + 1)
        at = np.argsort(grams)
        self.grams, self.rank = grams[at], rank[at]
        length = sum((self.grams >> (8 * n) > 0).astype(np.int64) for n in range(1, QMAX + 1))
        self.inner = self.grams[length < QMAX]
        size = length[length < QMAX]
        ends = []  # proper suffixes of inner nodes: what the end of a gram may look like before its last code point
        for n in range(QMIN - 1, QMAX - 1):
            some = self.inner[size > n]
            ends.append(some & ((1 << 8 * n) - 1) | n << 8 * n)
        self.ends = np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)

    def decompose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, its end; kept or not) at every position of the words."""
        m, width = x.shape
        gram = _codes(x, QMIN)
        end = np.broadcast_to(np.arange(gram.shape[1]) + QMIN, gram.shape).copy()
        open_ = np.ones(gram.shape, bool)
        for n in range(QMIN, QMAX):
            longer = _codes(x, n + 1) if width > n else np.zeros((m, 0), np.int64)
            fits = longer.shape[1]
            open_[:, fits:] = False
            open_ &= _member(self.inner, gram)
            gram[:, :fits] = np.where(open_[:, :fits], longer, gram[:, :fits])
            end += open_
        kept = np.ones(gram.shape, bool)
        kept[:, 1:] = end[:, 1:] > np.maximum.accumulate(end, axis=1)[:, :-1]
        return gram, end, kept

    def touched(self, x: np.ndarray, end: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """The most kept grams of each word that one edit can touch."""
        m, width = x.shape
        starts = end.shape[1]
        before = np.zeros((m, width + 1), np.int64)  # kept grams that start before a place
        before[:, 1:starts + 1] = np.cumsum(kept, axis=1)
        before[:, starts + 1:] = before[:, starts:starts + 1]
        place = np.arange(width + 1)
        first = np.broadcast_to(place, (m, width + 1)).copy()  # the first gram that reaches over a place from before
        for d in range(1, QMAX):
            reach = np.zeros((m, width + 1), bool)
            n = max(0, min(starts, width + 1 - d))
            reach[:, d:d + n] = end[:, :n] > place[d:d + n]
            first = np.where(reach, place - d, first)
        left = before - np.take_along_axis(before, first, axis=1)
        cover = np.zeros((m, width + 1), np.int64)  # how far a gram from before can reach behind a place
        for t in range(QMIN, QMAX):
            ends = _codes(x, t - 1)[:, :max(0, width - t + 1)] if width >= t else np.zeros((m, 0), np.int64)
            cover[:, :ends.shape[1]] = np.where(_member(self.ends, ends), t, cover[:, :ends.shape[1]])
        right = np.zeros((m, width + 1), np.int64)
        for j in range(QMAX - QMIN):
            n = max(0, starts - j)
            right[:, :n] += kept[:, j:j + n] & (end[:, j:j + n] <= place[:n] + cover[:, :n])
        inserted = (left + right)[:, 1:width]
        own = np.zeros((m, width + 1), np.int64)
        own[:, :starts] = kept
        changed = (left + own)[:, 1:width - 1] + right[:, 2:width]
        return np.maximum(inserted.max(axis=1), changed.max(axis=1))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, key, whether it only probes): the lists that each word is in and those it asks besides."""
        gram, end, kept = self.decompose(x)
        bound, count = self.touched(x, end, kept), kept.sum(axis=1)
        at = np.searchsorted(self.grams, gram)
        known = _member(self.grams, gram)
        rank = np.where(known, self.rank[np.minimum(at, len(self.grams) - 1)] if len(self.grams) else 0, 0)
        order = rank << 40 | (mix64(gram.view(_U)) >> _U(24)).view(np.int64)
        order = np.argsort(np.where(kept, order, np.iinfo(np.int64).max), axis=1, kind="stable")
        all_ = bound >= count
        some = np.arange(order.shape[1]) < np.where(all_, count, bound + 1)[:, None]
        row, col = np.nonzero(some)
        pos = order[row, col]
        g, letters = gram[row, pos].view(_U), _U(x.shape[1] - 2)
        key = lambda p, n: mix64(mix64(g) + mix64(p.astype(_U) * _U(0x9E3779B97F4A7C15) + n))
        rows, keys = [row, row, row], [key(pos, letters), key(pos, letters + _U(1)), key(pos + 1, letters + _U(1))]
        probe = [np.zeros(len(row), bool), np.ones(len(row), bool), np.ones(len(row), bool)]
        if all_.any():
            weak = np.flatnonzero(all_)
            own, k = deletions(x[weak, 1:-1])
            rows.append(weak[own])
            keys.append(k)
            probe.append(np.zeros(len(k), bool))
        return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(probe)


def deletions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of the word without any one of its code points, each once."""
    m, n = x.shape
    salt = mix64(np.arange(1, n + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
    here = mix64(x.astype(_U) + salt)  # a code point at its own place
    shifted = np.zeros_like(here)
    if n > 1:
        shifted[:, 1:] = mix64(x[:, 1:].astype(_U) + salt[:-1])  # and one place before
    none = np.zeros((m, 1), _U)
    head = np.concatenate([none, np.cumsum(here, axis=1, dtype=_U)], axis=1)
    tail = np.concatenate([np.cumsum(shifted[:, ::-1], axis=1, dtype=_U)[:, ::-1], none], axis=1)
    without = head[:, :-1] + tail[:, 1:] + _U(n - 1)
    sums = mix64(np.concatenate([head[:, -1:] + _U(n), without], axis=1))
    both = np.unique(np.stack([np.repeat(np.arange(m, dtype=_U), n + 1), sums.ravel()], axis=1), axis=0)
    return both[:, 0].astype(np.int64), both[:, 1].copy()


def gram_dictionary(words: DataFrame) -> GramDictionary:
    def count(batches):
        for batch in batches:
            parts = [_codes(x, n).ravel() for _, x in _by_length(batch.column("word").to_pylist())
                     for n in range(QMIN, QMAX + 1) if x.shape[1] >= n]
            gram, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([pa.array(gram), pa.array(n)], names=["gram", "n"])

    total = words.agg(F.sum(F.length("word") + 2 - (QMIN - 1))).first()[0] or 0
    least = max(LIST, total >> DICTIONARY_BITS)
    grams = words.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    got = grams.toPandas()  # at most 2**DICTIONARY_BITS grams of each length: each holds more than that share
    return GramDictionary(got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def near_words(words: DataFrame, grams: GramDictionary) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words at distance one, once, a before b in code-point order."""
    model = words.sparkSession.sparkContext.broadcast(grams)

    def lists(batches):
        for batch in batches:
            for own, x in _by_length(batch.column("word").to_pylist()):
                row, key, probe = model.value.keys(x)
                at = pa.array(own[row])
                letters = np.bitwise_or.reduce(np.int64(1) << (x[:, 1:-1] & 63), axis=1)
                yield pa.record_batch([pa.array(key), pa.array(probe), batch.column("word").take(at), batch.column("n").take(at),
                                       pa.array(letters[row])], names=["key", "probe", "word", "n", "letters"])

    rows = words.mapInArrow(lists, "key long, probe boolean, word string, n long, letters long")
    asked = rows.select("key", "probe", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"))
    listed = rows.where("NOT probe").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "letters")
    met = asked.join(listed, "key").where(
        "(probe OR a < b) AND bit_count(a_letters ^ letters) <= 2 AND levenshtein(a, b, 1) = 1")  # one edit changes two bits at most
    first = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(pick("a", "b", "a"), pick("a_n", "b_n", "a_n"), pick("b", "a", "b"), pick("b_n", "a_n", "b_n")).distinct()


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``words`` (word, n), each word once -> word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, if that is at least ``ratio`` (more than 1) times its own; the root
    is reached by following forms to the last."""
    pairs = near_words(words, gram_dictionary(words))
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= F.col("n") * ratio
    formed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.m")).alias("form_n")), "spelling_forms")
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles how far the links reach; n grows ratio-fold along a link, so they end
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return formed.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return group_variants(materialize(count_words(docs, id_col, text_col), "spelling_words"))
