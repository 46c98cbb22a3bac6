"""Numpy kernels for hashed term vectors, run inside ``mapInArrow`` tasks.

A chunk arrives as its array of token bucket ids (computed by JVM
expressions). Counting buckets per chunk and scoring chunks against a small,
broadcast query matrix are sparse products that numpy does per Arrow batch;
Spark partitions the chunks and finishes the top-k across tasks.

All dot products and squared norms are integer-valued and exact in float64
(below 2**53), and the score is ``dot / (sqrt(qn2) * sqrt(cn2))`` — the same
operations in the same order as the SQL form, so results are bit-identical.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from docmetrics.functions.text import text_runs

# --- Fixed values -------------------------------------------------------------
# Token cleaning: keep letters, digits and blanks (blanks separate words).
_CLEAN = regex.compile(r"[^\p{L}\p{N} ]+")
# ------------------------------------------------------------------------------


class TokenHasher:
    """Text -> bucket ids of its tokens ('w:'+word, 'b:'+bigram inside a word).

    Words are the blank-separated pieces of the text after dropping every
    character that is not a letter, digit or blank, lower-cased. A bucket is
    the first 32 bits of the token's md5 modulo ``dim``. Bigrams are found as
    pairs of adjacent non-blank code points with numpy; md5 runs once per
    distinct word or bigram and is memoised per task (the memo is bounded: a
    corpus has new words without end, and four tasks and more share a machine).
    """

    MAX_MEMO = 100_000

    def __init__(self, dim: int, char_ngrams: bool = True):
        self.dim = dim
        self.char_ngrams = char_ngrams
        self.words: dict[str, int] = {}
        self.pairs: dict[int, int] = {}

    def _md5_bucket(self, tok: str) -> int:
        return int.from_bytes(hashlib.md5(tok.encode("utf-8")).digest()[:4], "big") % self.dim

    def buckets(self, text: str | None) -> list[int]:
        """Bucket ids of one text (words first, then bigrams)."""
        rows, vals = self.batch(pa.array([text], type=pa.string()))
        return vals.tolist()

    def batch(self, texts: pa.Array):
        """(row, bucket) of every token of a text column, as two int64 arrays; the working arrays take some
        hundred bytes for each of text, so callers give runs of texts (``count_runs``)."""
        cleaned = [_CLEAN.sub("", t).lower() if t else "" for t in texts.to_pylist()]
        # words
        words = [[w for w in c.split(" ") if w] for c in cleaned]
        flat = [w for ws in words for w in ws]
        if len(self.words) > self.MAX_MEMO:
            self.words.clear()
        for w in set(flat).difference(self.words):
            self.words[w] = self._md5_bucket("w:" + w)
        vals_w = np.fromiter(map(self.words.__getitem__, flat), dtype=np.int64, count=len(flat))
        rows_w = np.repeat(np.arange(len(words), dtype=np.int64),
                           np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        if not self.char_ngrams:
            return rows_w, vals_w
        # bigrams: adjacent non-blank code points; texts joined by a blank never pair up
        joined = " ".join(cleaned) + " "
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        pos = np.flatnonzero((cp[:-1] != 32) & (cp[1:] != 32))
        codes = (cp[pos] << 21) | cp[pos + 1]
        lens = np.fromiter((len(c) + 1 for c in cleaned), dtype=np.int64, count=len(cleaned))
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        rows_b = np.searchsorted(starts, pos, side="right") - 1
        inv, uniq = pd.factorize(codes, sort=False)   # hashing, not sorting
        if len(self.pairs) > self.MAX_MEMO:
            self.pairs.clear()
        memo = self.pairs
        ub = np.empty(len(uniq), dtype=np.int64)
        for i, c in enumerate(uniq.tolist()):
            v = memo.get(c)
            if v is None:
                v = self._md5_bucket("b:" + chr(c >> 21) + chr(c & 0x1FFFFF))
                memo[c] = v
            ub[i] = v
        return np.concatenate((rows_w, rows_b)), np.concatenate((vals_w, ub[inv]))


def bucket_counts(rows: np.ndarray, vals: np.ndarray, n: int, dim: int):
    """(row, bucket, tf) for the non-zero buckets of each row, plus norm2 per row."""
    key, tf = np.unique(rows * dim + vals, return_counts=True)
    r = key // dim
    b = key % dim
    norm2 = np.bincount(r, weights=tf.astype(np.float64) * tf, minlength=n)
    return r, b, tf.astype(np.int64), norm2.astype(np.int64)


def count_runs(texts: pa.Array, hasher: TokenHasher):
    """(first row, rows, counts of ``bucket_counts``) of consecutive runs of a text column; rows count from the run's first."""
    for at, to in text_runs(texts):
        yield at, to - at, bucket_counts(*hasher.batch(texts.slice(at, to - at)), to - at, hasher.dim)


class QueryMatrix:
    """Query term vectors by bucket (CSC): for bucket b, queries qidx[qptr[b]:qptr[b+1]].

    Travels to tasks as ``payload()`` (plain lists and arrays).
    """

    @classmethod
    def from_payload(cls, p):
        return cls(p["query_ids"], p["buckets"], p["tfs"], p["dim"])

    @staticmethod
    def payload(query_ids, buckets, tfs, dim: int) -> dict:
        return {"query_ids": list(query_ids), "buckets": np.asarray(buckets, dtype=np.int64),
                "tfs": np.asarray(tfs, dtype=np.int64), "dim": dim}

    def __init__(self, query_ids, buckets, tfs, dim: int):
        ids = sorted(set(query_ids))
        pos = {q: i for i, q in enumerate(ids)}
        qi = np.array([pos[q] for q in query_ids], dtype=np.int64)
        b = np.asarray(buckets, dtype=np.int64)
        # A query id given in several rows is one query: its counts of a bucket add up.
        pair, at = np.unique(b * max(len(ids), 1) + qi, return_inverse=True)
        tf = np.bincount(at, weights=np.asarray(tfs, dtype=np.int64), minlength=len(pair)).astype(np.int64)
        b, qi = pair // max(len(ids), 1), pair % max(len(ids), 1)
        order = np.arange(len(pair))  # by bucket, then query
        self.ids = ids
        self.dim = dim
        self.qidx = qi[order]
        self.qval = tf[order]
        self.qptr = np.zeros(dim + 1, dtype=np.int64)
        np.add.at(self.qptr, b[order] + 1, 1)
        self.qptr = np.cumsum(self.qptr)
        self.qnorm2 = np.bincount(qi, weights=tf.astype(np.float64) * tf, minlength=len(ids))

    @property
    def n(self) -> int:
        return len(self.ids)

    def dense(self) -> np.ndarray | None:
        """dim x n query matrix (float64, exact for integer counts), if small enough."""
        if self.dim * self.n > DENSE_Q:
            return None
        if getattr(self, "_dense", None) is None:
            q = np.zeros((self.dim, self.n), dtype=np.float64)
            b = np.repeat(np.arange(self.dim), np.diff(self.qptr))
            q[b, self.qidx] = self.qval
            self._dense = q
        return self._dense


# Work bound per slice: (term, query) pairs expanded at once, and cells of the
# dense (row x query) accumulator. Query matrices up to DENSE_Q cells are used
# densely (rows x dim times dim x queries); larger ones by sparse expansion.
MAX_PAIRS = 2_000_000
MAX_CELLS = 4_000_000
DENSE_Q = 8_000_000


def row_slices(r, b, n_rows: int, qm: "QueryMatrix"):
    """Split rows 0..n_rows-1 into consecutive slices whose pair expansion is bounded."""
    if qm.dense() is not None:
        step = max(1, MAX_CELLS // max(qm.dim, qm.n))
        return [(lo, min(lo + step, n_rows)) for lo in range(0, n_rows, step)]
    cnt = qm.qptr[b + 1] - qm.qptr[b]
    per_row = np.bincount(r, weights=cnt, minlength=n_rows)
    max_rows = max(1, MAX_CELLS // max(qm.n, 1))
    out = []
    lo = 0
    acc = 0.0
    for i in range(n_rows):
        if i > lo and (acc + per_row[i] > MAX_PAIRS or i - lo >= max_rows):
            out.append((lo, i))
            lo, acc = i, 0.0
        acc += per_row[i]
    if lo < n_rows:
        out.append((lo, n_rows))
    return out


def dot_block(r, b, tf, lo: int, hi: int, qm: "QueryMatrix") -> np.ndarray:
    """Dense (hi-lo) x n_queries block of exact integer dot products."""
    i, j = np.searchsorted(r, lo), np.searchsorted(r, hi)   # r is sorted
    rr, bb, tt = r[i:j] - lo, b[i:j], tf[i:j]
    qd = qm.dense()
    if qd is not None:
        m = np.zeros((hi - lo, qm.dim), dtype=np.float64)
        m[rr, bb] = tt
        return m @ qd
    start = qm.qptr[bb]
    cnt = qm.qptr[bb + 1] - start
    total = int(cnt.sum())
    block = np.zeros((hi - lo) * qm.n, dtype=np.float64)
    if total:
        rep = np.repeat(np.arange(len(bb), dtype=np.int64), cnt)
        pos = start[rep] + (np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(cnt) - cnt, cnt))
        w = (tt[rep] * qm.qval[pos]).astype(np.float64)
        block += np.bincount(rr[rep] * qm.n + qm.qidx[pos], weights=w, minlength=len(block))
    return block.reshape(hi - lo, qm.n)


def sort_codes(column: pa.Array) -> np.ndarray:
    """Integer codes that sort like the column's values.

    Strings compare by code point, which is also their UTF-8 byte order (the
    order Spark and SQL use).
    """
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    _, inv = np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True)
    return inv.astype(np.int64)


def partial_top_k(group, score, key_codes, k: int) -> np.ndarray:
    """Indices of the best k per group: score descending, then keys ascending.

    Exact as a partial step: any row in a group's global top k is in the top
    k of its own batch under the same total order.
    """
    if len(group) == 0:
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort(tuple(reversed(key_codes)) + (-score, group)) if key_codes else \
        np.lexsort((-score, group))
    g = group[order]
    starts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1]
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


class RunningTopK:
    """The best k rows of every query that a task has seen (score descending, then keys ascending).

    Rows wait until there are about twice as many as may stay, then all but each query's best k go; so a
    task holds O(queries x k) rows, and gives out at most k rows per query once, at its end.
    """

    def __init__(self, ids, k: int, key_cols):
        self.ids, self.k, self.key_cols = pa.array(ids, type=pa.string()), k, list(key_cols)
        self.limit = 2 * k * len(ids) + 8_192
        self.parts: list[pa.Table] = []
        self.rows = 0
        self.kth = np.full(len(ids), -np.inf)  # a row that scores less is not among its query's best

    def add(self, query: np.ndarray, score: np.ndarray, columns: dict[str, pa.Array]) -> None:
        if len(query):
            self.parts.append(pa.table({"_q": pa.array(query), "_s": pa.array(score), **columns}))
            self.rows += len(query)
            if self.rows > self.limit:
                self._settle()

    def offer(self, batch: pa.RecordBatch, rows: np.ndarray, query: np.ndarray, score: np.ndarray, columns, **own: np.ndarray) -> None:
        """``add`` rows of a batch with its ``columns`` and the pairs' ``own``. Ties (of copies) can make these any number of pairs:
        then only the best k of each query go on, before a text is taken once for every pair."""
        if len(rows) > self.k * len(self.ids):
            some, at = np.unique(rows, return_inverse=True)
            best = partial_top_k(query, score, [sort_codes(batch.column(c).take(pa.array(some)))[at] for c in self.key_cols], self.k)
            rows, query, score, own = rows[best], query[best], score[best], {n: x[best] for n, x in own.items()}
        take = pa.array(rows)
        self.add(query, score, {c: batch.column(c).take(take) for c in columns} | {n: pa.array(x) for n, x in own.items()})

    def _settle(self) -> None:
        t = pa.concat_tables(self.parts).combine_chunks()
        query, score = t["_q"].to_numpy(), t["_s"].to_numpy()
        best = partial_top_k(query, score, [sort_codes(t[c].combine_chunks()) for c in self.key_cols], self.k)
        kept = query[best]
        last = np.flatnonzero(np.r_[kept[1:] != kept[:-1], True]) if len(kept) else np.zeros(0, dtype=np.int64)
        full = last[np.bincount(kept, minlength=len(self.kth))[kept[last]] == self.k]
        self.kth[kept[full]] = score[best[full]]
        self.parts, self.rows = [t.take(pa.array(best))], len(best)

    def batches(self, columns, score_name: str, score=lambda s: s):
        """The kept rows: query_id, ``columns``, and the score under its name, in that order."""
        if self.parts:
            self._settle()
            t = self.parts[0]
            out = pa.table([self.ids.take(t["_q"].combine_chunks()), *(t[c] for c in columns),
                            pa.array(score(t["_s"].to_numpy()))], names=["query_id", *columns, score_name])
            yield from out.to_batches(max_chunksize=65_536)


def sparse_slices(batch: pa.RecordBatch, qm: QueryMatrix, hasher: TokenHasher, text_col: str, k: int,
                  floor: np.ndarray | None = None):
    """(rows, queries, dot, score) of the positive scores of a batch, in bounded slices. With ``floor``
    (the queries' k-th scores so far, changed by the caller), only those that can be among the best k."""
    qn = np.sqrt(qm.qnorm2)
    for first, n, (r, b, tf, norm2) in count_runs(batch.column(text_col), hasher):
        cn = np.sqrt(norm2.astype(np.float64))
        for lo, hi in row_slices(r, b, n, qm):
            block = dot_block(r, b, tf, lo, hi, qm)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(block > 0, block / (qn[None, :] * cn[lo:hi, None]), 0.0)
            keep = score > 0
            if floor is not None:
                keep &= score >= floor[None, :]
                if len(score) > k:  # ties of the slice's k-th score stay: keys decide later
                    keep &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k][None, :]
            rows, queries = np.nonzero(keep)
            yield rows + first + lo, queries, block[rows, queries], score[rows, queries]


def score_batch(batch: pa.RecordBatch, qm: QueryMatrix, top: RunningTopK, hasher: TokenHasher,
                text_col: str = "text", carry_cols=()) -> None:
    """Offer a batch of chunks to the task's running top k."""
    for rows, queries, dot, score in sparse_slices(batch, qm, hasher, text_col, top.k, top.kth):
        top.offer(batch, rows, queries, score, (*top.key_cols, *carry_cols), dot=dot)


def score_batch_per_document(batch: pa.RecordBatch, key_cols, qm: QueryMatrix, k: int, hasher: TokenHasher,
                             text_col: str = "text", carry_cols=()):
    """Partial top k per query and document (the first key) of each slice: at most one row per chunk and query."""
    codes = [sort_codes(batch.column(c)) for c in key_cols]
    for rows, queries, dot, score in sparse_slices(batch, qm, hasher, text_col, k):
        group = queries * (int(codes[0].max(initial=0)) + 1) + codes[0][rows]
        best = partial_top_k(group, score, [c[rows] for c in codes], k)
        take = pa.array(rows[best])
        yield pa.RecordBatch.from_arrays(
            [pa.array([qm.ids[i] for i in queries[best]], type=pa.string()),
             *(batch.column(c).take(take) for c in (*key_cols, *carry_cols)), pa.array(dot[best]), pa.array(score[best])],
            names=["query_id", *key_cols, *carry_cols, "dot", "score"])


# Chunks scored at once when they come as lists, one per document.
LIST_ROWS = 10_000


def contexts_of_lists(lists: pa.ListArray, qm: QueryMatrix, k: int, hasher: TokenHasher):
    """(rows, queries, contexts): per row and query the k best of the row's texts (score, then position), joined by
    newlines. A text may be in the context of every query, so they are made and yielded for runs of rows."""
    if qm.n:
        for at, to in text_runs(lists):
            for rows, queries, texts in _contexts_of_run(lists.slice(at, to - at), qm, k, hasher):
                yield rows + at, queries, texts


def _contexts_of_run(lists: pa.ListArray, qm: QueryMatrix, k: int, hasher: TokenHasher):
    """The same of some rows, after all their texts were scored in bounded pieces."""
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    kept = [np.zeros((3, 0))]
    for at in range(0, len(flat), LIST_ROWS):
        piece = pa.record_batch([flat.slice(at, LIST_ROWS)], names=["text"])
        for r, j, _, score in sparse_slices(piece, qm, hasher, "text", k):
            best = partial_top_k(row[at + r] * qm.n + j, score, [r], k)
            kept.append(np.stack([(at + r)[best], j[best], score[best]]))
    chunk, query, score = np.concatenate(kept, axis=1)
    chunk, query = chunk.astype(np.int64), query.astype(np.int64)
    group = row[chunk] * qm.n + query
    best = partial_top_k(group, score, [chunk], k)
    group, texts = group[best], flat.take(pa.array(chunk[best])).to_pylist()
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    to = np.r_[cut[1:], len(group)]
    yield group[cut] // qm.n, group[cut] % qm.n, ["\n".join(texts[a:b]) for a, b in zip(cut, to)]


def term_rows(batch: pa.RecordBatch, key_cols, hasher: TokenHasher,
              text_col: str = "text"):
    """Batches with one row per (chunk, non-zero bucket): keys, bucket, tf, norm2; a batch per run of chunks."""
    for first, _, (r, b, tf, norm2) in count_runs(batch.column(text_col), hasher):
        take = pa.array(r + first)
        arrays = [batch.column(c).take(take) for c in key_cols]
        arrays += [pa.array(b, type=pa.int64()), pa.array(tf, type=pa.int64()),
                   pa.array(norm2[r], type=pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*key_cols, "bucket", "tf", "norm2"])


def dense_matrix(column: pa.Array, width: int):
    """ARRAY<FLOAT> column -> (rows x width float64 matrix, valid mask).

    A row is valid when it is non-null, has exactly ``width`` elements and
    none of them is null, NaN or infinite; invalid rows get zeros and are masked out.
    """
    n = len(column)
    out = np.zeros((n, width), dtype=np.float64)
    valid = np.zeros(n, dtype=bool)
    if n == 0:
        return out, valid
    offsets = column.offsets.to_numpy()
    values = column.flatten()
    vals = values.to_numpy(zero_copy_only=False).astype(np.float64)
    if values.null_count:
        vals[~values.is_valid().to_numpy(zero_copy_only=False)] = np.nan
    lens = np.diff(offsets)
    ok = (lens == width) & column.is_valid().to_numpy(zero_copy_only=False)
    idx = np.flatnonzero(ok)
    if len(idx):
        starts = offsets[:-1][idx] - offsets[0]
        block = vals[starts[:, None] + np.arange(width)[None, :]]
        good = np.isfinite(block).all(axis=1)
        out[idx[good]] = block[good]
        valid[idx[good]] = True
    return out, valid


# Cells of the (rows x queries) arrays that the dense kernel holds at once; a matrix product may differ
# from the row-by-row sum by far less than SLACK (for squared distances: SLACK times the squared norms), so
# it only picks the pairs whose distance is taken.
DENSE_CELLS = 1_000_000
SLACK = 1e-9


def dense_slices(v: np.ndarray, q: np.ndarray, metric: str, k: int, floor, norms: np.ndarray | None = None):
    """(rows, queries, distance) of the pairs that can be among a query's k nearest, in slices of rows.

    ``floor()`` gives minus the distance of the k-th row known for each query; ``norms`` are the rows' norms, if
    known. A matrix product picks the pairs; their distance is summed in a fixed order from the two vectors
    alone, so equal vectors get equal distances in any batch.
    """
    step = max(1, DENSE_CELLS // max(q.shape[0], q.shape[1], 1))
    q2 = (q * q).sum(axis=1)
    qn = np.sqrt(q2)
    for lo in range(0, len(v), step):
        part = v[lo:lo + step]
        least = floor()
        if metric == "cosine":
            own = np.sqrt((part * part).sum(axis=1)) if norms is None else norms[lo:lo + step]
            both = own[:, None] * qn[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.where(both > 0, (part @ q.T) / both, np.nan) - 1.0
            slack = SLACK
        else:  # minus the squared distance, which sorts alike
            v2 = (part * part).sum(axis=1)
            near = 2.0 * (part @ q.T) - v2[:, None] - q2[None, :]
            slack = SLACK * (v2.max(initial=0.0) + q2 + 1e-300)
            least = -(least * least)
        keep = ~np.isnan(near)
        if len(part) > k:
            near[~keep] = -np.inf
            kth = np.partition(near, len(part) - k, axis=0)[len(part) - k]
            least = np.maximum(least, kth)
        rows, queries = np.nonzero(keep & (near >= (least - slack)[None, :]))
        dist = np.empty(len(rows))
        width = max(1, DENSE_CELLS // max(1, q.shape[1]))
        for i in range(0, len(rows), width):
            r, j = rows[i:i + width], queries[i:i + width]
            if metric == "cosine":
                dist[i:i + width] = 1.0 - (part[r] * q[j]).sum(axis=1) / both[r, j]
            else:
                diff = part[r] - q[j]
                dist[i:i + width] = np.sqrt((diff * diff).sum(axis=1))
        yield rows + lo, queries, dist


def dense_score_batch(batch: pa.RecordBatch, vec_col: str, q: np.ndarray, metric: str, top: RunningTopK,
                      columns, scope_col: str | None = None, scopes: dict | None = None, norm_col: str | None = None) -> None:
    """Offer a batch of vectors to the task's running top k (score = minus the distance). With ``scopes``
    (scope value -> numbers of its queries), a vector meets the queries of its own scope only."""
    for at in range(0, batch.num_rows, step := max(1, DENSE_CELLS // max(1, q.shape[1]))):
        _dense_score_run(batch.slice(at, step), vec_col, q, metric, top, columns, scope_col, scopes, norm_col)


def _dense_score_run(batch, vec_col, q, metric, top, columns, scope_col, scopes, norm_col) -> None:
    v, valid = dense_matrix(batch.column(vec_col), q.shape[1])
    norms = batch.column(norm_col).to_numpy(zero_copy_only=False) if norm_col else None
    if scope_col is None:
        groups = [(np.flatnonzero(valid), np.arange(len(q)))]
    else:
        coded = batch.column(scope_col).dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        groups = [(np.flatnonzero(valid & (code == i)), scopes[value])
                  for i, value in enumerate(coded.dictionary.to_pylist()) if value in scopes]
    for rows, of in groups:
        for r, j, dist in dense_slices(v[rows], q[of], metric, top.k, lambda of=of: top.kth[of], None if norms is None else norms[rows]):
            top.offer(batch, rows[r], of[j], -dist, columns)


def dense_pairs_top_k(batch: pa.RecordBatch, vec_col: str, of_col: str, q: np.ndarray | None, width: int, metric: str, k: int, scope_col: str,
                      keys, norm_col: str | None = None):
    """Vectors that bring their queries, a list of (query_id, query): the partial top k per query and scope of each run of
    rows, as batches (query_id, scope, keys, distance). ``query`` is a row of ``q``, or without it the vector itself."""
    for at in range(0, batch.num_rows, step := max(1, DENSE_CELLS // max(1, width))):
        run = batch.slice(at, step)
        v, valid = dense_matrix(run.column(vec_col), width)
        norms = run.column(norm_col).to_numpy(zero_copy_only=False) if norm_col else np.sqrt((v * v).sum(axis=1))
        of = run.column(of_col)
        row = np.repeat(np.arange(len(of)), np.diff(of.offsets.to_numpy()))
        flat = of.flatten()
        ids, given = flat.field("query_id"), flat.field("query")
        if q is None:
            matrix, good = dense_matrix(given, width)
            number = np.arange(len(flat))
        else:
            matrix, number = q, given.to_numpy(zero_copy_only=False)
            good = np.isfinite(q).all(axis=1)[number]
        pair = np.flatnonzero(valid[row] & good)
        row, number = row[pair], number[pair]
        qn, dist = np.sqrt((matrix * matrix).sum(axis=1)), np.empty(len(pair))
        for lo in range(0, len(pair), step):
            r, j = row[lo:lo + step], number[lo:lo + step]
            if metric == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    both = norms[r] * qn[j]
                    dist[lo:lo + step] = np.where(both > 0, 1.0 - (v[r] * matrix[j]).sum(axis=1) / both, np.nan)
            else:
                diff = v[r] - matrix[j]
                dist[lo:lo + step] = np.sqrt((diff * diff).sum(axis=1))
        known = np.flatnonzero(~np.isnan(dist))
        name = ids.dictionary_encode()
        code = name.indices.to_numpy(zero_copy_only=False)[pair[known]]
        group = sort_codes(run.column(scope_col))[row[known]] * (len(name.dictionary) + 1) + code
        best = known[partial_top_k(group, -dist[known], [sort_codes(run.column(c))[row[known]] for c in keys], k)]
        take = pa.array(row[best])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(pair[best])), *(run.column(c).take(take) for c in (scope_col, *keys)), pa.array(dist[best])],
                                         names=["query_id", scope_col, *keys, "distance"])
