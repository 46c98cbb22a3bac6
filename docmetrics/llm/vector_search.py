"""Approximate nearest neighbours by balanced posting lists, for cosine.

Method: vectors are put into posting lists, one per centroid. Centroids are fitted by a balanced
hierarchical k-means (a cluster that is too large is split again, and assignment is penalised by size) on
a bounded sample; their number follows the number of vectors, up to ``MAX_LISTS``. A vector on the boundary
is replicated to further lists: those at most ``1 + REPLICA`` times as far as its nearest one, skipping a
centroid that is nearer to a chosen centroid than to the vector. Centroids are searched in memory by a
neighbour graph (best-first, a beam of ``BEAM`` or as many as are asked for; where such a beam would meet
all centroids anyway they are ranked outright). A query reads the lists of its nearest centroids up to
``1 + PROBE`` times the nearest one's distance, and as many as the table itself needs: ``TRIAL`` of its queries,
the first by a hash, are compared with brute force, and the number of lists grows from ``LEAST_MOST`` by a quarter
at a time until their recall, less two standard errors, is at least ``RECALL`` (and if the ratio alone
prevents that, the ratio is dropped; with all lists read the recall is 1). Vectors and queries of a list meet as
matrices in blocks.

Scale: fitting sees ``SAMPLE`` vectors at most (and at most ``SAMPLE_BYTES``); the centroids and graph are
broadcast (``MAX_LISTS`` x dimension, at most a few MB). The comparison with brute force is one pass over the
vectors for ``TRIAL`` queries, each task keeping their nearest k + 1. Lists longer than ``BLOCK_ROWS`` are cut into blocks by hash, and so are a list's
queries, so a task holds one block of each however large a list becomes. Equal vectors are one class,
listed once with its k + 1 smallest ids (more cannot be among the nearest, as ties go to smaller ids), and equal
query vectors are searched once, so a vector that a third of all rows share costs one entry.

Result: the score is the cosine in double precision of the original vectors, computed row by row in one fixed order.
Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor
do vectors of another length than the most common one (of equally common ones the shorter); null ids take no
part; a query is never its own neighbour by id, and repeated rows of one id and vector are one; ties go to
smaller ids; a query with fewer than k neighbours in the lists it reads is searched in all lists; an empty
table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.llm.common import materialize

SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
LIST_ROWS, MAX_LISTS = 256, 4_096
BLOCK_ROWS = 2_048
REPLICA, MAX_REPLICAS = 0.10, 4
PROBE, LEAST_MOST, LEAST_PROBES = 0.35, 48, 8
TRIAL, RECALL = 256, 0.9
NEIGHBOURS, BEAM, ENTRIES = 24, 64, 32


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Centroids:
    """Unit centroids with a neighbour graph over them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        m = min(NEIGHBOURS, n - 1)
        self.graph = np.zeros((n, m), np.int32)
        for at in range(0, n, 512):
            near = points[at:at + 512] @ points.T
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
            if m:
                self.graph[at:at + 512] = np.argpartition(-near, m - 1, axis=1)[:, :m]
        self.entries = np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64)

    def search(self, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) per query, nearest first; -1 where there are fewer. Best-first over the graph, all queries at once."""
        n, rows = len(self.points), np.arange(len(q))
        beam = min(max(BEAM, top), n)
        if beam * NEIGHBOURS >= n and top > BEAM:  # such a beam meets all of them
            sims = q @ self.points.T
            ids = np.argsort(-sims, axis=1, kind="stable")[:, :top]
            return ids, np.take_along_axis(sims, ids, axis=1)
        seen = np.zeros((len(q), n), bool)
        seen[:, self.entries] = True
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf)
        done = np.ones((len(q), beam), bool)
        new = np.broadcast_to(self.entries, (len(q), len(self.entries)))
        ids, sims, done = self._merge(ids, sims, done, new, q @ self.points[self.entries].T, beam)
        active = rows
        while len(active):
            best = np.argmax(~done[active], axis=1)  # sorted by similarity: the first one not expanded
            active = active[~done[active, best]]
            if not len(active):
                break
            best = np.argmax(~done[active], axis=1)
            done[active, best] = True
            near = self.graph[ids[active, best]].astype(np.int64)
            if not near.shape[1]:
                break
            known = seen[active[:, None], near]
            seen[active[:, None], near] = True
            sim = np.einsum("ij,ikj->ik", q[active], self.points[near])
            sim[known] = -np.inf
            a, b, c = self._merge(ids[active], sims[active], done[active], np.where(known, -1, near), sim, beam)
            ids[active], sims[active], done[active] = a, b, c
        return ids[:, :top], sims[:, :top]

    @staticmethod
    def _merge(ids, sims, done, new, sim, beam):
        ids, sims = np.concatenate([ids, new], axis=1), np.concatenate([sims, sim], axis=1)
        done = np.concatenate([done, ~np.isfinite(sim)], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return tuple(np.take_along_axis(x, order, axis=1) for x in (ids, sims, done))


def fit_centroids(sample: np.ndarray, lists: int) -> Centroids:
    """Balanced hierarchical k-means on unit vectors: clusters are split until each is at most its share."""
    rng = np.random.default_rng(5)
    share = max(1.0, len(sample) / lists)
    out, todo = [], [np.arange(len(sample))]
    while todo:
        own = todo.pop()
        parts = min(8, round(len(own) / share))
        if parts < 2:
            c = sample[own].sum(axis=0)
            size = np.sqrt(c @ c)
            out.append(c / size if size > 1e-9 else sample[own[0]])
            continue
        x = sample[own]
        c = x[rng.choice(len(x), parts, replace=False)]
        count = np.full(parts, len(x) / parts)
        for _ in range(8):
            to = np.argmax(x @ c.T - 0.15 * (count * parts / len(x) - 1), axis=1)
            count = np.bincount(to, minlength=parts).astype(float)
            c = np.stack([x[to == i].sum(axis=0) if count[i] else x[rng.integers(len(x))] for i in range(parts)])
            c /= np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-12)[:, None]
        if count.max() == len(x):  # all on one side: nothing to tell them apart, so cut
            to = np.arange(len(x)) % parts
        todo += [own[to == i] for i in range(parts) if (to == i).any()]
    return Centroids(np.stack(out))


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, vec as packed doubles) of the rows that take part, but for the choice of one length."""

    def pack(batches):
        for batch in batches:
            column = batch.column("v")
            size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            out_id, out_dim, out_vec = [], [], []
            ids = batch.column("id").to_pylist()
            for dim in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dim)
                flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = flat.reshape(len(at), dim)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                out_id += [ids[i] for i in at[good]]
                out_dim += [int(dim)] * int(good.sum())
                out_vec += [v.tobytes() for v in x[good]]
            yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(out_dim, pa.int32()), pa.array(out_vec, pa.binary())], names=["id", "dim", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(pack, "id long, dim int, vec binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _probed(cent: Centroids, u: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(lists, which of them are read) of every query: at most ``most``, up to ``1 + ratio`` times the nearest one's distance."""
    ids, sims = cent.search(u, most)
    far = np.sqrt(np.maximum(2 - 2 * sims, 0))
    take = far <= far[:, :1] * (1 + ratio) + 1e-12
    take[:, :LEAST_PROBES] = True
    return ids, take & (ids >= 0)


def _enough(cent: Centroids, u: np.ndarray, truth: np.ndarray) -> tuple[int, float]:
    """(most, ratio) for ``_probed`` that find the true neighbours of the trial queries ``u``: rows of ``truth`` are
    (query, neighbour's number, a list that holds it)."""
    n = len(cent.points)
    pairs, slot = np.unique(truth[:, :2], axis=0, return_inverse=True)
    each = np.maximum(np.bincount(pairs[:, 0], minlength=len(u)), 1)
    asked = np.bincount(pairs[:, 0], minlength=len(u)) > 0
    for ratio in (PROBE, np.inf):
        most = min(LEAST_MOST, n)
        while True:
            ids, take = _probed(cent, u, most, ratio)
            read = np.zeros((len(u), n), bool)
            row, at = np.nonzero(take)
            read[row, ids[row, at]] = True
            hit = np.zeros(len(pairs), bool)
            hit[slot[read[truth[:, 0], truth[:, 2]]]] = True
            recall = (np.bincount(pairs[:, 0], hit, minlength=len(u)) / each)[asked]
            if not len(recall) or recall.mean() - 2 * recall.std() / np.sqrt(len(recall)) >= RECALL:
                return most, ratio
            if most == n:
                break
            most = min(n, max(most + 1, most * 5 // 4))
    return n, np.inf


def _placed(rows: DataFrame, model, dim: int, kind: str, most: int = 0, ratio: float = 0.0) -> DataFrame:
    """(rep, vec) -> a row per list: where a vector is stored (``store``) or a query looks (``probe``)."""
    step = 1024 if kind == "store" else max(1, 1024 * LEAST_MOST // max(most, LEAST_MOST))  # rows of one output batch are bounded

    def place(batches):
        cent: Centroids = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                u = _unit(_matrix(part.column("vec"), dim))
                if kind == "store":
                    ids, sims = cent.search(u, MAX_REPLICAS * 2)
                    far = np.sqrt(np.maximum(2 - 2 * sims, 0))
                    near = far <= far[:, :1] * (1 + REPLICA) + 1e-12
                    take = np.zeros(ids.shape, bool)
                    take[:, 0] = True
                    for j in range(1, ids.shape[1]):
                        ok = near[:, j] & (ids[:, j] >= 0) & (take.sum(axis=1) < MAX_REPLICAS)
                        for i in range(j):  # a centroid nearer to a chosen one than to the vector adds nothing
                            between = np.einsum("ij,ij->i", cent.points[ids[:, i]], cent.points[ids[:, j]])
                            ok &= ~(take[:, i] & (between > sims[:, j]))
                        take[:, j] = ok
                else:
                    ids, take = _probed(cent, u, most, ratio)
                row, slot = np.nonzero(take)
                pick = part.take(pa.array(row))
                yield pa.record_batch([pa.array(ids[row, slot].astype(np.int32)), pick.column("rep"), pick.column("vec")], names=["list", "rep", "vec"])

    return rows.select("rep", "vec").mapInArrow(place, "list int, rep long, vec binary")


def _nearest(left: pa.Table, right: pa.Table, dim: int, keep: int) -> pa.Table:
    """The ``keep`` nearest stored vectors of a block for every query of a block, scored exactly."""
    names, kinds = ["query", "rep", "score"], [pa.int64(), pa.int64(), pa.float64()]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    x, q = _matrix(left.column("vec"), dim), _matrix(right.column("vec"), dim)
    rep, query = left.column("rep").to_numpy(), right.column("rep").to_numpy()
    ux = _unit(x)
    nx = np.sqrt(np.einsum("ij,ij->i", x, x))
    found_q, found_r, found_s = [], [], []
    for at in range(0, len(q), 256):
        own = q[at:at + 256]
        sim = _unit(own) @ ux.T
        if len(rep) > keep:
            cut = -np.partition(-sim, keep - 1, axis=1)[:, keep - 1:keep]
            row, col = np.nonzero(sim >= cut - 1e-9)
        else:
            row, col = np.nonzero(np.ones_like(sim, bool))
        exact = np.einsum("ij,ij->i", own[row], x[col]) / (np.sqrt(np.einsum("ij,ij->i", own, own))[row] * nx[col])
        order = np.lexsort((rep[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = nth < keep
        found_q.append(query[at + row[best]])
        found_r.append(rep[col[best]])
        found_s.append(exact[best])
    return pa.table([pa.array(np.concatenate(c)) for c in (found_q, found_r, found_s)], names=names)


def _trial(classes: DataFrame, stored: DataFrame, queries: DataFrame, cent: Centroids, dim: int, k: int) -> tuple[int, float]:
    """How many lists a query must read, and up to which ratio, measured on some of the queries."""
    if len(cent.points) <= LEAST_PROBES:
        return len(cent.points), PROBE
    own = [r["vec"] for r in queries.orderBy(F.xxhash64("rep", "vec"), "vec").limit(TRIAL).select("vec").collect()]
    if not own:
        return min(LEAST_MOST, len(cent.points)), PROBE
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(own)

    def nearest(batches):
        right = pa.table([pa.array(range(len(sent.value)), pa.int64()), pa.array(sent.value, pa.binary())], names=["rep", "vec"])
        number = {v: i for i, v in enumerate(sent.value)}
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                found = _nearest(part, right, dim, k + 1)
                # the query's own vector is no neighbour of it
                self_rep = {number[v]: r for v, r in zip(part.column("vec").to_pylist(), part.column("rep").to_pylist()) if v in number}
                alone = np.array([self_rep.get(q) != r for q, r in zip(found.column("query").to_pylist(), found.column("rep").to_pylist())], bool)
                found = found.filter(pa.array(alone))
                best = found if best is None else pa.concat_tables([best, found])
                q, r, s = (best.column(c).to_numpy() for c in ("query", "rep", "score"))
                order = np.lexsort((r, -s, q))
                nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                best = best.take(pa.array(order[nth < k]))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    near = classes.select("rep", "vec").mapInArrow(nearest, "query long, rep long, score double")
    near = near.withColumn("nth", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, rep)")).where(F.col("nth") <= k)
    near = materialize(near.select("query", "rep"), "vector_trial")  # at most TRIAL * k rows
    truth = stored.select("rep", "list").join(F.broadcast(near), "rep").select("query", "rep", "list").collect()
    return _enough(cent, _unit(np.frombuffer(b"".join(own), np.float64).reshape(-1, dim)), np.array([tuple(r) for r in truth], np.int64).reshape(-1, 3))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """The rows where ``is_query`` holds (an expression on the column ``id``) are searched in all rows
    -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid_vectors(vectors, id_col, vec_col)
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return empty
    dim = lengths[0]["dim"]
    rows = materialize(rows.where(F.col("dim") == dim).drop("dim").distinct(), "vectors")

    # Classes of equal vectors, each with its k + 1 smallest ids (a top-k per class that tasks cut down before the shuffle).
    ranked = rows.withColumn("nth", F.expr("row_number() OVER (PARTITION BY vec ORDER BY id)")).where(F.col("nth") <= k + 1)
    classes = materialize(ranked.groupBy("vec").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "vector_classes")
    asked = rows.where(is_query)
    queries = materialize(asked.groupBy("vec").agg(F.min("id").alias("rep")), "vector_queries")

    size = min(SAMPLE, SAMPLE_BYTES // (8 * dim) or 1)
    sample = classes.orderBy(F.xxhash64("rep"), "rep", "vec").limit(size).select("vec").collect()
    n = classes.count()
    lists = max(1, min(n // LIST_ROWS, MAX_LISTS, len(sample) // 4))
    cent = fit_centroids(_unit(np.frombuffer(b"".join(r["vec"] for r in sample), np.float64).reshape(-1, dim)), lists)
    model = spark.sparkContext.broadcast(cent)
    stored = materialize(_placed(classes, model, dim, "store"), "vector_lists")
    most, ratio = _trial(classes, stored, queries, cent, dim, k)

    def meet(probes: DataFrame) -> DataFrame:
        """Blocks of a list's vectors times blocks of its queries."""
        blocks = stored.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
        rounds = probes.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("rounds"))
        sizes = blocks.join(rounds, "list")  # at most MAX_LISTS rows
        each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), (F.col(c) - 1).cast("long")))
        left = stored.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), each("rounds").alias("round"), "rep", "vec")
        right = probes.join(F.broadcast(sizes), "list").select("list", each("blocks").alias("block"), F.pmod(F.xxhash64("rep"), F.col("rounds")).alias("round"), "rep", "vec")
        key = ["list", "block", "round"]
        return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(lambda a, b: _nearest(a, b, dim, k + 1), "query long, rep long, score double")

    def answers(probes: DataFrame) -> DataFrame:
        best = meet(probes).distinct().withColumn("nth", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, rep)")).where(F.col("nth") <= k + 1)
        members = best.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
        ids = asked.join(queries.select("vec", F.col("rep").alias("query")), "vec").select("query", F.col("id").alias("query_id"))
        pairs = ids.join(members, "query").where("query_id != vec_id").groupBy("query", "query_id", "vec_id").agg(F.max("score").alias("score"))
        return pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k)

    found = materialize(answers(_placed(queries, model, dim, "probe", most, ratio)), "vector_found")
    # Queries that found too few, though there are enough rows, look into all lists.
    least = min(k, rows.select("id").distinct().count() - 1)
    poor = queries.join(found.groupBy("query", "query_id").agg(F.count("*").alias("n")).groupBy("query").agg(F.min("n").alias("n")), queries["rep"] == F.col("query"), "left")
    poor = materialize(poor.where(F.coalesce("n", F.lit(0)) < least).select("rep", "vec"), "vector_poor")
    if not poor.isEmpty():
        everywhere = poor.select(F.explode(F.sequence(F.lit(0), F.lit(len(cent.points) - 1))).alias("list"), "rep", "vec")
        found = found.join(poor.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(answers(everywhere))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
