"""LM scoring: log10 probabilities of whole texts under a causal self-attention model and under a word-count base.

Method: a text is its words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), each encoded with a blank before it by a public
byte-pair vocabulary, and one end. The model is one causal self-attention layer over subword embeddings and positions, with a
rectified hidden layer, trained in numpy with hand-written gradients (Adam). Its output is a tree of two levels: a group, then a class in the
group; only the group of the subword that came is looked into. The most frequent subwords are classes of their own, the others are dealt
into ``SHARED`` classes by frequency, those that begin a word apart from the others; inside a class a subword has its share of the class's
counts (one added to each), so the probabilities of all subwords and the end sum to 1.
A text is scored in overlapping windows of ``2 * STEP`` places: a window scores its last ``STEP`` places, each
seeing the places before it in the window, so every token is scored once, with ``STEP`` to ``2 * STEP - 1`` places of context (fewer
at the start). Windows of all texts of a slice go through the layer together; what lies before a text and after a place is masked.

The base is a unigram: sum over words and end of log10((c + 1) / (N + V + 1)), from counts over all learning documents.

Scale: one pass over the texts writes their subwords to the shared folder; all else reads these. Counts of words and subwords cover all
learning documents, added up in each task before the shuffle. The weights are fitted
on all windows of all learning documents, in rounds: tasks train copies on their own documents, and the copies' mean starts the next round. The ``HEAVY`` most
frequent words are broadcast with their counts (their number is bounded, whatever the vocabulary); the others are looked
up by an equi-join of (document, word) rows, where no word can be hot, as the hot ones are not in it. Words are keyed by 64-bit hashes of their subwords
(a pair of words collides with 2**-64). Documents are scored in one pass whose result is written to the shared folder. Texts beyond ``PIECE`` characters are taken
in pieces cut at blanks, so the working arrays stay bounded but for the text's own subwords.

Defined results: null and empty texts are the end alone; a null id is not held out and is never learned from; repeated rows are
scored each and count each; without any learning document N and V are 0 and all classes are equally likely; words beyond
``LONG_WORD`` characters are encoded in parts; an empty table gives an empty result; further columns are not looked at. A model
score is a sum of single-precision terms: equal texts agree to about 6 digits. The weights depend on how the input is split over tasks.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize, run_hashes, seeds, signed, text_slices
from docmetrics.llm.packing import tokenizer_text

STEP = 16
GROUPS, MEMBERS, SHARED = 24, 24, 16  # half the groups for subwords that begin a word; shared classes in either half
CLASSES = GROUPS * MEMBERS
INPUTS = 1024  # subwords with an embedding of their own, by frequency; the others share one per class
WIDTH, KEY, HIDDEN = 32, 16, 32
ROUNDS = ((1, 1.0), (1, 1.0), (2, 0.8), (4, 0.5), (4, 0.25), (4, 0.1))  # sixteenths of the documents, and the rate they are learned at
LEAST_STEPS, BATCH, RATE, WARM = 300, 256, 6e-3, 20
BUFFER, SLOTS = 20_000, 16
HEAVY = 1 << 17
MEMO = 400_000  # distinct words whose subwords a worker keeps
PIECE = 1 << 21
BLANKS = " \t\n\x0b\x0c\r"
SLICE = 1 << 21
LONG_WORD = 1_000
CALL = 500  # words encoded in one call
RUN = 1 << 19  # subwords whose windows are made at once
CHUNK = 512  # windows taken through the layer at once
TOP = 40.0  # scores are cut here, so exp needs no maximum taken off
LN10 = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Subwords:
    """Subword ids of texts; each distinct word is encoded once as long as the memo holds it."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.split("\n") if x.strip())}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = max(table.values()) + 1
        self.starts = np.zeros(self.size, bool)  # subwords that begin a word
        self.starts[[i for b, i in table.items() if b.startswith(b" ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.place = np.zeros(0, np.int64)  # of a hash: its number
        self.n, self.at, self.ids = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _one(self, word: str) -> list[int]:
        parts = [word[i:i + LONG_WORD] for i in range(0, len(word), LONG_WORD)]
        return [i for j, part in enumerate(parts) for i in self.encoding.encode_ordinary(part if j else " " + part)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, how many each has)."""
        flat, sizes = [], []
        for at in range(0, len(words), CALL):
            some = words[at:at + CALL]
            if max(map(len, some)) <= LONG_WORD:
                ids = np.array(self.encoding.encode_ordinary(" " + " ".join(some)), np.int32)
                cut = np.flatnonzero(self.starts[ids])
                if len(cut) == len(some):
                    flat.append(ids)
                    sizes.append(np.diff(cut, append=len(ids)))
                    continue
            alone = [self._one(w) for w in some]  # signs that the pattern ties to a blank
            flat.append(np.array([i for ids in alone for i in ids], np.int32))
            sizes.append(np.array([len(ids) for ids in alone]))
        return np.concatenate(flat), np.concatenate(sizes)

    def numbers(self, s, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The numbers of distinct word hashes of a slice; ``first`` is a word of each."""
        if len(self.hashes) > MEMO:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == own if len(self.hashes) else np.zeros(len(own), bool)
        number = np.where(known, self.place[at], -1) if len(self.hashes) else np.full(len(own), -1)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            text = s.bytes.tobytes()
            ids, sizes = self._encode([text[a:b].decode() for a, b in zip(s.start[first[fresh]].tolist(), s.end[first[fresh]].tolist())])
            number[fresh] = np.arange(len(self.n), len(self.n) + len(fresh))
            self.n = np.concatenate([self.n, sizes])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            hashes, place = np.concatenate([self.hashes, own[fresh]]), np.concatenate([self.place, number[fresh]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.place = hashes[order], place[order]
        return number

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, ends of each word's)."""
        n = self.n[numbers]
        to = np.cumsum(n)
        return self.ids[np.repeat(self.at[numbers] - (to - n), n) + np.arange(to[-1] if len(to) else 0)], to


_subwords: dict[int, Subwords] = {}


def _worker(definition) -> Subwords:
    """This worker's encoder."""
    got = _subwords.get(definition.value[2])
    if got is None:
        got = _subwords[definition.value[2]] = Subwords(*definition.value[:2])
    return got


def _groups(column: pa.Array):
    """(texts, row of each): runs of texts up to PIECE together; a longer one for itself, in pieces cut at blanks."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    for row in np.flatnonzero(size > PIECE).tolist():
        if row > at:
            yield column.slice(at, row - at), np.arange(at, row)
        text, pieces, start = column[row].as_py(), [], 0
        while len(text) - start > PIECE:
            cut = max(text.rfind(c, start + 1, start + PIECE) for c in BLANKS)
            if cut <= start:
                cut = min((x for x in (text.find(c, start + PIECE) for c in BLANKS) if x >= 0), default=len(text))
            pieces.append(text[start:cut])
            start = cut
        pieces.append(text[start:])
        yield pa.array(pieces, pa.large_string()), np.full(len(pieces), row)
        at = row + 1
    if at < len(column):
        yield column.slice(at), np.arange(at, len(column))


def _texts(column: pa.Array, words: Subwords):
    """(rows, their subwords, bounds of each row's, words): whole texts, those of a slice together; ``words`` lists
    (place in rows of each word, distinct hashes, which of them each word is)."""
    for texts, rows in _groups(column):
        whole = len(rows) > 1 and rows[0] == rows[-1]  # the pieces of one text
        held, seen = [], []
        for s in text_slices(texts, SLICE):
            own, first, which = np.unique(s.word_hashes(), return_index=True, return_inverse=True)
            ids, to = words.of(words.numbers(s, own, first)[which])
            if whole:
                held.append(ids)
                seen.append((np.zeros(len(which), np.int64), own, which))
            else:
                yield rows[s.first:s.first + s.n], ids, np.concatenate([[0], to])[s.bounds], [(s.word_doc, own, which)]
        if whole:
            ids = np.concatenate(held)
            yield rows[:1], ids, np.array([0, len(ids)]), seen


# --- the subwords of the documents ---


def keep_heap() -> None:
    """Has glibc keep freed memory below some 32 MB for the next arrays (its bounds follow the largest block freed; see M_MMAP_THRESHOLD in
    mallopt(3)). Otherwise the arrays of each batch of windows are given back and their pages come anew, at a third of the time."""
    np.empty(1 << 24, np.uint8)


def encode_texts(docs: DataFrame, definition) -> DataFrame:
    """``docs`` (id, learn, text and others) -> the columns but the text, ``deal`` (which sixteenth of the learning they are in), and ``ids``:
    their subwords, two bytes each, or four where the vocabulary needs it."""
    dealt = docs.withColumn("deal", F.pmod(F.xxhash64("id", "text"), F.lit(sum(parts for parts, _ in ROUNDS))))
    kept = [c for c in dealt.columns if c != "text"]

    def encode(batches):
        words = _worker(definition)
        for batch in batches:
            for row, ids, bounds, _ in _texts(batch.column("text"), words):
                packed = ids.astype(_width(words.size))
                ends = pa.py_buffer((bounds * packed.itemsize).astype(np.int32))
                own = batch.take(pa.array(row))
                yield pa.record_batch([*(own.column(c) for c in kept), pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(packed)])],
                                      names=[*kept, "ids"])

    return dealt.mapInArrow(encode, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(kept).schema), "ids binary"]))


def _width(size: int):
    return np.uint16 if size <= 1 << 16 else np.int32


def _runs(column: pa.Array, size: int):
    """(rows, their subwords, bounds of each row's): whole texts, those of up to ``RUN`` subwords together."""
    packed, column = np.dtype(_width(size)), column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // packed.itemsize
    data = column.buffers()[2]
    ids = np.frombuffer(data, packed, len(data) // packed.itemsize) if data else np.zeros(0, packed)
    at = 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(off, off[at] + RUN, side="right")) - 1))
        yield np.arange(at, to), ids[off[at]:off[to]], (off[at:to + 1] - off[at]).astype(np.int64)
        at = to


def word_keys(ids: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, its 64-bit key): a word begins at a subword that begins with a blank, and has the same subwords wherever it is."""
    head = np.flatnonzero(np.take(starts, ids))
    tail = np.append(head[1:], len(ids))  # a text begins with a word, so a word never runs into the next text
    codes = _codes(len(starts))
    key, at = np.empty(len(head), np.uint64), 0
    while at < len(head):
        to = max(at + 1, int(np.searchsorted(tail, head[at] + RUN, side="right")))
        first, last = head[at], tail[to - 1]
        key[at:to] = run_hashes(np.take(codes, ids[first:last]), head[at:to] - first, tail[at:to] - first)
        at = to
    return np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(head, bounds))), key


@lru_cache(2)
def _codes(size: int) -> np.ndarray:
    return seeds(size, salt=0x1D5)


# --- corpus counts ---

WORD, SUBWORD, DOCUMENT = 0, 1, 2


def count_corpus(docs: DataFrame, starts) -> DataFrame:
    """``docs`` (learn, ids) -> (kind, key, n, n_learn): words by key (n over all documents, n_learn over those learned
    from), subwords and documents (both over those learned from)."""

    def count(batches):
        key, tally, learned, size = [], [], 0, len(starts.value)
        used = np.zeros(size, np.int64)

        def merged():
            k, at = np.unique(np.concatenate(key), return_inverse=True)
            both = np.concatenate(tally)
            return k, np.stack([np.bincount(at, both[:, j], minlength=len(k)).astype(np.int64) for j in (0, 1)], axis=1)

        def rows(kind, k, both):
            for at in range(0, len(k), 100_000):
                part = both[at:at + 100_000]
                yield pa.record_batch([pa.array(np.full(len(part), kind, np.int32)), pa.array(k[at:at + 100_000]), pa.array(part[:, 0].copy()),
                                       pa.array(part[:, 1].copy())], names=["kind", "key", "n", "n_learn"])

        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            learned += int(learn.sum())
            for row, ids, bounds in _runs(batch.column("ids"), size):
                of, found = word_keys(ids, bounds, starts.value)
                own, which, n = np.unique(signed(found), return_inverse=True, return_counts=True)
                key.append(own)
                tally.append(np.stack([n, np.bincount(which[learn[row][of]], minlength=len(own))], axis=1))
                used += np.bincount(ids[np.repeat(learn[row], np.diff(bounds))], minlength=size)
            if sum(map(len, key)) > 1_500_000:
                k, both = merged()
                key, tally = [k], [both]
                if len(k) > 1_000_000:
                    yield from rows(WORD, k, both)
                    key, tally = [], []
        if key:
            yield from rows(WORD, *merged())
        k = np.flatnonzero(used)
        yield from rows(SUBWORD, k, np.stack([used[k]] * 2, axis=1))
        yield from rows(DOCUMENT, np.zeros(1, np.int64), np.full((1, 2), learned))

    parts = docs.mapInArrow(count, "kind int, key long, n long, n_learn long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_learn").alias("n_learn"))


def heavy_words(words: DataFrame, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, learned counts, n): the words that occur more than n times, ``most`` at most."""
    steps = words.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.count("*").alias("words"), F.max("n").alias("top"))
    left, least = most, 0
    for r in steps.orderBy(F.desc("step")).collect():  # 16 rows for each doubling of a count
        if r["words"] > left:
            least = r["top"]
            break
        left -= r["words"]
    got = words.where(F.col("n") > least).select("key", "n_learn").toPandas()
    key = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], got["n_learn"].to_numpy(np.int64)[order], least


# --- the model ---


class Classes:
    """The classes of all subwords and the end (id ``size``), their shares, and the embedding each has."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.of = np.zeros(size + 1, np.int16)
        for half, first in ((np.append(size, order[starts[order]]), 0), (order[~starts[order]], CLASSES // 2)):  # the end comes first
            alone = CLASSES // 2 - SHARED
            self.of[half[:alone]] = first + np.arange(len(half[:alone]))
            rest = half[alone:]
            mass = np.cumsum(counts[rest] + 1.0)
            self.of[rest] = first + alone + (np.minimum(mass / mass[-1], 1 - 1e-9) * SHARED).astype(np.int64) if len(rest) else first
        used = np.bincount(self.of, minlength=CLASSES) > 0
        self.empty = np.where(used, 0, -1e9).astype(np.float32).reshape(GROUPS, MEMBERS)
        self.empty_group = np.where(used.reshape(GROUPS, MEMBERS).any(axis=1), 0, -1e9).astype(np.float32)
        smooth = np.append(counts + 1.0, 1.0)
        self.share = np.log10(smooth / np.bincount(self.of, smooth, minlength=CLASSES)[self.of])
        self.input = np.full(size + 2, 0, np.int16)  # of subwords, and of the begin (size) and of nothing (size + 1)
        self.input[order] = np.minimum(np.arange(size), INPUTS - 1)
        rare = order[INPUTS - 2 * SHARED:]  # these are in shared classes
        kind = self.of[rare] % (CLASSES // 2) - (CLASSES // 2 - SHARED)
        self.input[rare] = INPUTS - 2 * SHARED + np.maximum(kind, 0) + SHARED * (self.of[rare] >= CLASSES // 2)
        self.input[size], self.input[size + 1] = INPUTS, INPUTS + 1


def windows(ids: np.ndarray, bounds: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs of each window's 2 * STEP places, targets of its last STEP places or -1, text of each window)."""
    size = len(classes.of) - 1
    count = np.diff(bounds) + 1  # with the end
    blocks = -(-count // STEP)
    first = np.concatenate([[0], np.cumsum(blocks + 1)])  # in blocks; a text's first block is empty
    given = np.full(first[-1] * STEP, size + 1, np.int32)
    target = np.full(first[-1] * STEP, -1, np.int32)
    at = (first[:-1] + 1) * STEP
    doc = np.repeat(np.arange(len(count)), count - 1)
    to = at[doc] + np.arange(len(ids)) - bounds[:-1][doc]
    target[to] = ids
    target[at + count - 1] = size
    given[at] = size
    given[to + 1 if len(to) else to] = ids  # a text's places end before the next text's empty block
    last = np.repeat(first[:-1], blocks) + np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks) + 1
    grid, aims = classes.input[given].reshape(-1, STEP), target.reshape(-1, STEP)
    return np.concatenate([grid[last - 1], grid[last]], axis=1), aims[last], np.repeat(np.arange(len(count)), blocks)


def _cut(x: np.ndarray) -> np.ndarray:
    return np.minimum(x, TOP, out=x) if x.max() > TOP else x


def _by_value(of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of ``of``, the sum of the rows of each)."""
    order = np.argsort(of, kind="stable")
    of = of[order]
    head = np.flatnonzero(np.diff(of, prepend=-1))
    pairs = np.complex64 if rows.dtype == np.float32 else np.complex128  # two columns are added at a time
    return of[head], np.add.reduceat(np.take(rows, order, axis=0).view(pairs), head).view(rows.dtype)


class Attention:
    """embedding + position -> one head of causal attention -> rectified hidden layer -> classes."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.p = {"emb": draw(INPUTS + 2, WIDTH, by=0.3), "pos": draw(2 * STEP, WIDTH, by=0.1), "q": draw(WIDTH, KEY, by=0.2), "k": draw(WIDTH, KEY, by=0.2),
                  "v": draw(WIDTH, HIDDEN, by=0.15), "r": draw(WIDTH, HIDDEN, by=0.15), "b": np.zeros(HIDDEN, np.float32),
                  "group": np.zeros((HIDDEN, GROUPS), np.float32), "group_bias": np.zeros(GROUPS, np.float32),
                  "member": np.zeros((GROUPS, HIDDEN, MEMBERS), np.float32), "member_bias": np.zeros((GROUPS, MEMBERS), np.float32)}
        later = np.arange(2 * STEP)[None, :] > np.arange(STEP, 2 * STEP)[:, None]
        self.later = np.where(later, np.float32(-1e9), np.float32(0))
        self.fold()

    def fold(self) -> None:
        """The projections of every embedding and position, so that a place only looks them up and adds; the output's two levels side by side."""
        p = self.p
        self.eq, self.ek, self.ev, self.er = (p["emb"] @ p[x] for x in "qkvr")
        self.eq /= np.float32(KEY**0.5)
        self.pq, self.pk = p["pos"][STEP:] @ p["q"] / np.float32(KEY**0.5), p["pos"] @ p["k"]
        self.pr = p["pos"][STEP:] @ p["r"] + p["b"]
        self.none = np.zeros(INPUTS + 2, np.float32)
        self.none[INPUTS + 1] = -1e9
        self.both = np.concatenate([np.broadcast_to(p["group"], (GROUPS, HIDDEN, GROUPS)), p["member"]], axis=2)

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(queries, keys, values, attention, hidden layer) of some windows."""
        none = x == INPUTS + 1
        x = x.astype(np.intp)
        own = x[:, STEP:]
        q, k, v, h = (np.take(t, i, axis=0) for t, i in ((self.eq, own), (self.ek, x), (self.ev, x), (self.er, own)))
        q += self.pq
        k += self.pk
        h += self.pr
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self.later
        if none.any():
            some = np.flatnonzero(none.any(axis=1))
            a[some] += np.take(self.none, x[some])[:, None, :]
        _cut(a)
        np.exp(a, out=a)
        a *= (1 / (a.reshape(-1, 2 * STEP) @ np.ones(2 * STEP, a.dtype))).reshape(-1, STEP, 1)
        h += np.matmul(a, v)
        h *= h > 0
        return q, k, v, a, h

    def log_probabilities(self, x: np.ndarray, target: np.ndarray, classes: Classes) -> np.ndarray:
        """The log10 probability of each window's targets, added up."""
        total = np.zeros(len(x))
        for at in range(0, len(x), CHUNK):
            aim = target[at:at + CHUNK].ravel()
            out = self.outcome(self.attend(x[at:at + CHUNK])[4], np.take(classes.of, aim), classes)[0]
            total[at:at + CHUNK] = np.where(aim >= 0, out / LN10 + np.take(classes.share, aim), 0).reshape(-1, STEP) @ np.ones(STEP)
        return total

    def outcome(self, h: np.ndarray, aim: np.ndarray, classes: Classes):
        """(ln of the probability of class ``aim`` at every place; for the gradients the places ordered by group, the bounds of the groups, and
        in this order the hidden layer, exp of the scores of all groups and of the members of the group aimed at, side by side, the sums of both,
        and where in these the aims are)."""
        group, member = np.divmod(aim, np.int16(MEMBERS))
        order = np.argsort(group, kind="stable")
        group, member = np.take(group, order), np.take(member, order)
        bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        h = np.take(h.reshape(-1, HIDDEN), order, axis=0)
        bias = np.concatenate([np.broadcast_to(self.p["group_bias"] + classes.empty_group, (GROUPS, GROUPS)), self.p["member_bias"] + classes.empty], axis=1)
        out = np.empty((len(aim), GROUPS + MEMBERS), h.dtype)
        for a, b, weights, own in zip(bounds, bounds[1:], self.both, bias):
            if b > a:
                run = out[a:b]
                np.matmul(h[a:b], weights, out=run)
                run += own
        np.exp(_cut(out), out=out)
        sums = (out.reshape(-1, MEMBERS) @ np.ones(MEMBERS, h.dtype)).reshape(-1, 2)
        at = (np.arange(len(aim)) * (GROUPS + MEMBERS))[:, None] + np.stack([group, member + np.int16(GROUPS)], axis=1)
        ln = np.empty(len(aim), h.dtype)
        ln[order] = np.log(np.take(out, at) / sums) @ np.ones(2, h.dtype)
        return ln, order, bounds, h, out, sums, at

    def gradients(self, x: np.ndarray, target: np.ndarray, classes: Classes) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the classes. Those of the projections are added up per embedding and per position first,
        then go through the weights."""
        p = self.p
        q, k, v, a, h = self.attend(x)
        aim = target.ravel()
        _, order, bounds, flat, g, sums, at = self.outcome(h, np.take(classes.of, aim), classes)
        scale = ((aim >= 0) / max(1, (aim >= 0).sum())).astype(np.float32)[order][:, None]
        g.reshape(-1, 2, MEMBERS)[...] *= (scale / sums)[:, :, None]
        g.reshape(-1)[at] -= scale
        gh, both, bias, ones = np.empty_like(flat), np.zeros_like(self.both), np.zeros((GROUPS, GROUPS + MEMBERS), g.dtype), np.ones(len(aim), g.dtype)
        for a_, b_, weights, to, to_bias in zip(bounds, bounds[1:], self.both, both, bias):
            if b_ > a_:
                run = g[a_:b_]
                np.matmul(run, weights.T, out=gh[a_:b_])
                np.matmul(flat[a_:b_].T, run, out=to)
                np.matmul(ones[a_:b_], run, out=to_bias)
        gh *= flat > 0
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        gh = np.take(gh, back, axis=0).reshape(h.shape)
        gkv, gqr = np.empty((len(x), 2 * STEP, KEY + HIDDEN), g.dtype), np.empty((len(x), STEP, KEY + HIDDEN), g.dtype)
        np.matmul(a.transpose(0, 2, 1), gh, out=gkv[:, :, KEY:])
        ga = np.matmul(gh, v.transpose(0, 2, 1))
        ga -= np.einsum("ijk,ijk->ij", ga, a)[:, :, None]
        ga *= a
        np.matmul(ga.transpose(0, 2, 1), q, out=gkv[:, :, :KEY])
        np.matmul(ga, k, out=gqr[:, :, :KEY])
        gqr[:, :, KEY:] = gh
        kv, qr, root = np.concatenate([p["k"], p["v"]], axis=1), np.concatenate([p["q"], p["r"]], axis=1), np.float32(KEY**0.5)
        by_place = ones[:len(x)] @ gkv.reshape(len(x), -1), ones[:len(x)] @ gqr.reshape(len(x), -1)
        at_k, at_qr = by_place[0].reshape(2 * STEP, -1)[:, :KEY], by_place[1].reshape(STEP, -1)
        at_qr[:, :KEY] /= root
        d = {"pos": at_k @ p["k"].T, "emb": np.zeros_like(p["emb"])}
        d["pos"][STEP:] += at_qr @ qr.T
        ids, parts = _by_value(x.ravel(), gkv.reshape(-1, KEY + HIDDEN))
        d["emb"][ids] = parts @ kv.T
        at_kv = p["emb"][ids].T @ parts
        ids, parts = _by_value(x[:, STEP:].ravel(), gqr.reshape(-1, KEY + HIDDEN))
        parts[:, :KEY] /= root
        d["emb"][ids] += parts @ qr.T
        at_qr_ = p["emb"][ids].T @ parts + p["pos"][STEP:].T @ at_qr
        d |= {"k": at_kv[:, :KEY] + p["pos"].T @ at_k, "v": at_kv[:, KEY:], "q": at_qr_[:, :KEY], "r": at_qr_[:, KEY:], "b": at_qr[:, KEY:].sum(axis=0)}
        return d | {"group": both[:, :, :GROUPS].sum(axis=0), "group_bias": bias[:, :GROUPS].sum(axis=0), "member": both[:, :, GROUPS:], "member_bias": bias[:, GROUPS:]}

    def start_from(self, seen: np.ndarray) -> None:
        """Biases that give every class its share of ``seen`` (how often each class came)."""
        seen = (seen + 1.0).reshape(GROUPS, MEMBERS)
        self.p["group_bias"] = np.log(seen.sum(axis=1) / seen.sum()).astype(np.float32)
        self.p["member_bias"] = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
        self.fold()

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.p.values()])

    def set_flat(self, weights: np.ndarray) -> Attention:
        """The weights become views of ``weights``."""
        at = 0
        for n, w in self.p.items():
            self.p[n] = weights[at:at + w.size].reshape(w.shape).astype(np.float32, copy=False)
            at += w.size
        self.fold()
        return self


class Adam:
    """Passes over windows that change a model's weights."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t, self.rng, self.weights = model, rate, 0, np.random.default_rng(9), model.flat()
        model.set_flat(self.weights)
        self.mean, self.square = np.zeros_like(self.weights), np.zeros_like(self.weights)

    def learn(self, x: np.ndarray, target: np.ndarray, classes: Classes, passes: int = 1) -> None:
        for _ in range(passes):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                some = order[at:at + BATCH]
                self.t += 1
                rate = self.rate * min(1.0, self.t / WARM)
                d = self.model.gradients(x[some], target[some], classes)
                g = np.concatenate([d[n].ravel() for n in self.model.p])
                self.mean += np.float32(0.1) * (g - self.mean)
                self.square += np.float32(0.01) * (g * g - self.square)
                step = np.sqrt(self.square / np.float32(1 - 0.99**self.t))
                step += np.float32(1e-8)
                self.weights -= np.float32(rate / (1 - 0.9**self.t)) * self.mean / step
                self.model.fold()


def fit_corpus(docs: DataFrame, seen: np.ndarray, classes, definition, most: int | None = None) -> Attention:
    """``docs`` (id, learn, text), or what ``encode_texts`` makes of it -> the model, fitted on all windows of all documents learned from.

    The documents are dealt to ``ROUNDS`` by hash, each to one. In a round every task trains a copy of the weights on the windows of
    its documents; the mean of the copies, weighted by windows, starts the next round. A task holds ``BUFFER`` windows at most (and
    those of one run); one with few takes them several times. Only weights are shuffled, in ``SLOTS`` parts, and one mean reaches
    the driver. ``most`` bounds the windows of a task and round; None, the default, takes all."""
    spark, model, done = docs.sparkSession, Attention(), 0
    if most == 0:
        return model
    model.start_from(seen)
    if "ids" not in docs.columns:
        docs = encode_texts(docs, definition)
    for parts, factor in ROUNDS:
        least = LEAST_STEPS * parts // sum(parts for parts, _ in ROUNDS)
        start = spark.sparkContext.broadcast(model.flat())

        def train(batches, start=start, factor=factor, least=least):
            keep_heap()
            own = Attention().set_flat(start.value)
            adam, held, n, size = Adam(own, RATE * factor), [], 0, 0

            def learn(last):
                x, target = (np.concatenate(part) for part in zip(*held))
                adam.learn(x, target, classes.value, max(1, -(-(least - adam.t) // -(-len(x) // BATCH))) if last else 1)

            for batch in batches:
                for _, ids, bounds in _runs(batch.column("ids"), len(classes.value.of) - 1):
                    x, target, _ = windows(ids, bounds, classes.value)
                    if most is not None:
                        x, target = x[:max(0, most - n)], target[:max(0, most - n)]
                    held.append((x, target))
                    n, size = n + len(x), size + len(x)
                    if size >= BUFFER:
                        learn(False)
                        held, size = [], 0
            if size:
                learn(True)
            if n:
                slots = [w.tobytes() for w in np.array_split(own.flat(), SLOTS)]
                yield pa.record_batch([pa.array(range(SLOTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLOTS, pa.int32()), pa.array([n] * SLOTS, pa.int64()),
                                       pa.array(slots, pa.binary())], names=["slot", "part", "n", "w"])

        def mean(copies: pa.Table) -> pa.Table:
            copies = copies.sort_by("part")
            total, n = 0.0, copies["n"].to_numpy()
            for w, of in zip(copies["w"], n):
                total = total + of * np.frombuffer(w.as_py(), np.float32).astype(np.float64)
            return pa.table({"slot": copies["slot"][:1], "w": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

        dealt = docs.where("learn").where((F.col("deal") >= done) & (F.col("deal") < done + parts)).select("ids")
        got = dealt.mapInArrow(train, "slot int, part int, n long, w binary").groupBy("slot").applyInArrow(mean, "slot int, w binary").collect()  # SLOTS rows
        if got:
            model.set_flat(np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["slot"])]))
        done += parts
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None,
                most_windows: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """-> id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of ``docs``. ``most_windows`` bounds what a
    task learns from in a round, for trial runs; by default all is learned from."""
    spark: SparkSession = docs.sparkSession
    ranks = tokenizer_text(spark, vocabulary or default_vocabulary())
    pattern = pattern or default_pattern()
    definition = spark.sparkContext.broadcast((ranks, pattern, hash((ranks, pattern))))
    out = held_out(F.col(id_col))
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), (~out & F.col(id_col).isNotNull()).alias("learn"), F.col(text_col).alias("text"))

    encoder = Subwords(ranks, pattern)
    starts = spark.sparkContext.broadcast(encoder.starts)
    coded = materialize(encode_texts(rows, definition), "lm_subwords")
    counts = materialize(count_corpus(coded.select("learn", "ids"), starts), "lm_counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n", "n_learn")
    known = words.agg(F.sum("n_learn").alias("n"), F.count_if(F.col("n_learn") > 0).alias("v")).first()
    learning = (counts.where(F.col("kind") == DOCUMENT).agg(F.sum("n_learn")).first()[0] or 0)
    all_tokens, distinct = (known["n"] or 0) + learning, known["v"] + (learning > 0)
    keys, uses, least = heavy_words(words, heavy)

    tally = np.zeros(encoder.size, np.int64)
    for r in counts.where(F.col("kind") == SUBWORD).select("key", "n_learn").collect():  # one row per subword of the vocabulary
        tally[r["key"]] = r["n_learn"]
    classes = Classes(tally, encoder.starts)
    shared = spark.sparkContext.broadcast(classes)
    seen = np.bincount(classes.of, np.append(tally, learning), minlength=CLASSES)
    model = fit_corpus(coded.select("learn", "deal", "ids"), seen, shared, definition, most_windows)
    state = spark.sparkContext.broadcast((model, classes, keys, uses))

    def apply(batches):
        keep_heap()
        begins, (model, classes, keys, uses) = starts.value, state.value
        gain, number = np.log10(uses + 1.0), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for row, ids, bounds in _runs(batch.column("ids"), len(begins)):
                x, target, doc = windows(ids, bounds, classes)
                score = np.bincount(doc, model.log_probabilities(x, target, classes), minlength=len(row))
                of, key = word_keys(ids, bounds, begins)
                own, which = np.unique(key, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                hit = (keys[at] == own)[which] if len(keys) else np.zeros(len(key), bool)
                n, have, base = np.bincount(of, minlength=len(row)) + 1, np.zeros(len(row), np.int64), np.zeros(len(row))
                if len(keys):
                    base = np.bincount(of, np.where(hit, gain[at][which], 0), minlength=len(row))
                    have = np.bincount(of[hit & (uses[at] > 0)[which]], minlength=len(row))
                rare_doc, rare_key = of[~hit], key[~hit]
                order = np.lexsort((rare_key, rare_doc))
                rare_doc, rare_key = rare_doc[order], rare_key[order]
                first = np.flatnonzero(np.append(True, (rare_doc[1:] != rare_doc[:-1]) | (rare_key[1:] != rare_key[:-1]))[:len(order)])
                times = np.diff(first, append=len(order))
                to = pa.array(np.searchsorted(rare_doc[first], np.arange(len(row) + 1)).astype(np.int32))
                own = batch.take(pa.array(row))
                yield pa.record_batch([
                    pa.array((part << 40) + number + np.arange(len(row), dtype=np.int64)), own.column("id"), own.column("held_out"), pa.array(n), pa.array(have),
                    pa.array(base), pa.array(score), pa.ListArray.from_arrays(to, pa.array(signed(rare_key[first]))),
                    pa.ListArray.from_arrays(to, pa.array(times.astype(np.int32)))],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])
                number += len(row)

    kind = rows.schema["id"].dataType.simpleString()
    scored = materialize(coded.select("id", "held_out", "ids").mapInArrow(
        apply, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>"), "lm_scored")
    asked = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "key")
    rest = words.where((F.col("n") <= least) & (F.col("n_learn") > 0)).select("key", "n_learn")
    found = asked.join(rest, "key").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n_learn") + 1.0)).alias("more"))
    end, norm = (learning + 1.0), all_tokens + distinct + 1.0
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(learning > 0)).cast("long").alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + float(np.log10(end)) - F.col("n_tokens") * float(np.log10(norm))).alias("base_score"), "score")
