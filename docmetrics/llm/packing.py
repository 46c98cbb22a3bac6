"""Best-fit packing: token sequences of at most ``size`` tokens, filled best-fit decreasing.

Method: documents longer than a sequence are cut; the pieces are taken in order of decreasing length, and
each goes to the open sequence with the least room that still holds it, found by a segment tree over the
remaining capacities. Pieces of one length are interchangeable, so the run needs only the histogram of
lengths (``size`` numbers, whatever the corpus): sequences of equal remaining room are kept as ranges of
sequence numbers, and one step places a range of equal pieces into a range of equal sequences. The result
is that of best-fit decreasing over the whole corpus, not over parts of it.

Spark does the rest: one pass tokenises (in Python, every distinct word of a slice once) and writes a
small row per piece; the pieces of a length are numbered in salted parts (counts per part, running sums of
the counts, row numbers inside a part), so one length may hold a third of all pieces; a piece's number
finds its sequence in the broadcast steps, whose number is bounded by the histogram (each of the ``size``
lengths adds at most three ranges), not by the corpus.

Word-wise tokenising is right for tokenizers whose pre-tokenizer always splits at the ASCII blanks
``[\\x20\\x09-\\x0D]`` and drops them, as the default one does. The string of a special token in a text is that
token, as in the library's plain call; with ``ordinary`` it is text like any other.

Defined results: null or empty text is the end token alone (one piece of length 1); equal documents
(repeated rows) are packed each for itself; a null id stays null; an empty table gives an empty result;
other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize, text_slices
from docmetrics.session import bound_batches

SIZE = 2048
END_ID = 0
WORD_MEMO = 300_000  # distinct words whose ids a worker keeps; beyond that it forgets those met once
WORDS = 500  # words encoded in one call
SLICE = 1 << 18  # bytes of text taken at once
CUT = b".,!|"  # a sign that always begins a new pre-token after a letter
PART_ROWS = 50_000  # pieces of one length numbered in one part, about


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer_text(spark: SparkSession, path: str) -> str:
    """The tokenizer's file, read through Spark on the driver (a few MB)."""
    return "\n".join(r.value for r in spark.read.text(path if ":" in path else f"file://{path}", wholetext=True).collect())


class WordTokenizer:
    """Ids of whole texts, as the library's plain call gives them; each distinct word is encoded once.

    Words of a-z alone go straight to the vocabulary; of the others many go in one call with a special token
    between them, which keeps them apart before anything else looks at the text. A text that holds a special
    token's string is encoded as a whole. With ``ordinary`` such strings are text like any other."""

    def __init__(self, definition: str, ordinary: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        from tokenizers import Tokenizer

        self.tok, self.ordinary = Tokenizer.from_str(definition), ordinary
        added = self.tok.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.lower = [t.lower() for t in self.special]
        between = [i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.between = between[0] if between else None
        probe = [w for w in ("a", "the", "zq", "information", "xkjqwvzzz") if not any(t in w for t in self.lower)]
        self.direct = all([t.id for t in self.tok.model.tokenize(w)] == self._library(True).encode(w, add_special_tokens=False).ids for w in probe)
        self._keep(np.zeros(0, np.int64))

    def _library(self, ordinary: bool):
        """The one tokenizer (some 50 MB in every worker); with ``ordinary``, strings of special tokens are text like any other."""
        self.tok.encode_special_tokens = ordinary
        return self.tok

    def _keep(self, numbers: np.ndarray) -> None:
        """Forget all words but these."""
        if not len(numbers):
            self.hashes, self.place, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.n, self.at, self.ids = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
            return
        new = np.full(len(self.n), -1)
        new[numbers] = np.arange(len(numbers))
        left = new[self.place] >= 0
        n = self.n[numbers]
        to = np.cumsum(n)
        self.ids = self.ids[np.repeat(self.at[numbers] - (to - n), n) + np.arange(to[-1])]
        self.hashes, self.place = self.hashes[left], new[self.place[left]]
        self.n, self.at, self.uses = n, np.concatenate([[0], to]), np.zeros(len(numbers), np.int64)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, how many each has)."""
        flat: list = [None] * len(words)
        model, rest = self.tok.model.tokenize, []
        for i, w in enumerate(words):
            if self.direct and w.isascii() and w.isalpha():
                flat[i] = [t.id for t in model(w)]
            else:
                rest.append(i)
        for at in range(0, len(rest), WORDS):
            own = rest[at:at + WORDS]
            if self.between is None or any(t in words[i] for i in own for t in self.lower):
                got = [e.ids for e in self._library(True).encode_batch_fast([words[i] for i in own], add_special_tokens=False)]
            else:
                sep = self.tok.id_to_token(self.between)
                ids = self._library(False).encode_batch_fast([sep.join([words[i] for i in own])], add_special_tokens=False)[0].ids
                cut = [-1, *(j for j, x in enumerate(ids) if x == self.between), len(ids)]
                got = [ids[a + 1:b] for a, b in zip(cut, cut[1:])]
            for i, ids in zip(own, got):
                flat[i] = ids
        return np.array([x for ids in flat for x in ids], np.uint32), np.array([len(ids) for ids in flat], np.int64)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of the column, in order."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        whole: dict[int, np.ndarray] = {}
        if not self.ordinary and len(column):
            marked = np.zeros(len(column), bool)
            for t in self.special:
                marked |= pc.fill_null(pc.match_substring(column, t), False).to_numpy(zero_copy_only=False)
            if marked.any():
                whole = {i: np.array(self._library(False).encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(marked).tolist()}
                column = pc.if_else(pa.array(marked), pa.scalar("", column.type), column)
        for i, ids in enumerate(self._encode(column)):
            yield whole.get(i, ids)

    def _encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        for s in text_slices(column, SLICE, CUT):
            if len(self.n) > WORD_MEMO:
                keep = np.flatnonzero(self.uses > 1)  # words that were met again and again (or, if those fill the memo, none)
                self._keep(keep if len(keep) <= WORD_MEMO // 2 else keep[:0])
            own, first, slot, uses = np.unique(s.word_hashes(), return_index=True, return_inverse=True, return_counts=True)
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
                number = np.where(self.hashes[at] == own, self.place[at], -1)
            else:
                number = np.full(len(own), -1)
            fresh = np.flatnonzero(number < 0)
            if len(fresh):
                text = s.bytes.tobytes()
                ids, sizes = self._ids_of([text[a:b].decode() for a, b in zip(s.start[first[fresh]].tolist(), s.end[first[fresh]].tolist())])
                number[fresh] = np.arange(len(self.n), len(self.n) + len(fresh))
                self.n, self.ids = np.concatenate([self.n, sizes]), np.concatenate([self.ids, ids])
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
                self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
                to = np.searchsorted(self.hashes, own[fresh])  # both are sorted
                self.hashes, self.place = np.insert(self.hashes, to, own[fresh]), np.insert(self.place, to, number[fresh])
            self.uses[number] += uses
            word = number[slot]
            n = self.n[word]
            to = np.cumsum(n)
            ids = self.ids[np.repeat(self.at[word] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
            ends = np.concatenate([[0], to])[s.bounds]
            for a, b in zip(ends[:-1], ends[1:]):
                yield ids[a:b]


_tokenizers: dict[tuple[str, bool], WordTokenizer] = {}


def word_tokenizer(definition: str, ordinary: bool = False) -> WordTokenizer:
    """One per worker process: its memo serves the tasks that follow."""
    if (definition, ordinary) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[definition, ordinary] = WordTokenizer(definition, ordinary)
    return _tokenizers[definition, ordinary]


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int, ordinary: bool = False) -> DataFrame:
    """(doc_id, text) -> a row per piece: doc_id, piece, start, length, ids_crc32."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def pieces(batches):
        tok = word_tokenizer(definition.value, ordinary)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            rows = []
            for doc, seq in zip(batch.column("doc_id").to_pylist(), tok.encode(batch.column("text"))):
                seq = np.concatenate([seq, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(seq), size)):
                    part = seq[start:start + size]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            for at in range(0, len(rows), 10_000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 10_000]), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                      names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Room:
    """Segment tree over the remaining capacities 0..size: the tightest one in use that is at least r."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = bytearray(2 * self.leaves)

    def set(self, room: int, used: bool) -> None:
        i = room + self.leaves
        self.used[i] = used
        i >>= 1
        while i:
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.used[i]:
            return least
        while i > 1:
            if not i & 1 and self.used[i + 1]:  # a left child whose right neighbour holds larger rooms
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, first number of the pieces of that length, pieces per sequence, first sequence, offset
    in it), in order, and the number of sequences. Piece number x of a length goes with the last step of
    that length that starts at or before x: sequence = first + (x - start) // per, offset + (x - start) % per * length."""
    room, tree = {}, Room(size)  # remaining room -> ranges [first sequence, count]
    steps, sequences = [], 0

    def give(r: int, first: int, count: int) -> None:
        if count:
            room.setdefault(r, []).append((first, count))
            tree.set(r, True)

    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                first, count, r = sequences, -(-left // (size // length)), size
                sequences += count
            else:
                first, count = room[r].pop()
                if not room[r]:
                    tree.set(r, False)
            per = r // length
            full = min(count, left // per)
            some = left - full * per if full < count else 0  # a last sequence of the range gets fewer
            steps.append((length, at, per, first, size - r))
            give(r - per * length, first, full)
            used = full
            if some:
                give(r - some * length, first + full, 1)
                used += 1
            give(r, first + used, count - used)
            at += full * per + some
            left -= full * per + some
    return steps, sequences


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                  tokenizer_path: str | None = None, ordinary: bool = False) -> DataFrame:
    """-> a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``ordinary``: strings of special
    tokens are ordinary text."""
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = tokenizer_text(spark, tokenizer_path or default_tokenizer())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(tokenized_pieces(rows, tokenizer, size, ordinary), "pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    steps, _ = best_fit_decreasing({r["length"]: r["n"] for r in counts}, size)

    # Number the pieces of each length: salted parts, running sums over the parts' counts.
    parts = max(1, -(-max((r["n"] for r in counts), default=0) // PART_ROWS))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = salted.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY part) - n")).drop("n")
    salted = salted.withColumn("row", F.expr("row_number() OVER (PARTITION BY length, part ORDER BY doc_id, piece, ids_crc32) - 1"))
    numbered = salted.join(before, ["length", "part"]).withColumn("number", F.col("before") + F.col("row"))

    plan = spark.sparkContext.broadcast(np.array(steps, dtype=np.int64).reshape(-1, 5))

    def place(batches):
        table = plan.value
        key = (size - table[:, 0]) * (1 << 46) + table[:, 1]  # the steps' own order: length down, number up
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            step = table[np.searchsorted(key, (size - length) * (1 << 46) + number, side="right") - 1]
            nth = number - step[:, 1]
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            out = out.append_column("sequence_id", pa.array(step[:, 3] + nth // step[:, 2]))
            yield out.append_column("offset", pa.array(step[:, 4] + nth % step[:, 2] * length))

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
