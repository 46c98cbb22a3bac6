"""Centroid clustering: Lloyd rounds on integer vectors over a persisted matrix of exact dot products.

Method: every vector keeps, beside its integer components, its exact integer dot product with each of the
``k`` centroids. Squared distances are ``|v|^2 - 2 v.c + |c|^2``, so an assignment needs the dot products and
the centroids' norms only. When a round has moved the centroids, the products are not computed anew: only the
components in which a centroid changed are looked at, ``dots[k] += v[changed] . (new - old)[changed]``; a centroid that did
not change costs nothing. Then the smallest distance is taken again. All of it is integer arithmetic, so the
updated matrix equals the one computed from scratch.

Scale: a round is one pass without a shuffle over the state table (components, products), which is written to
the shared folder, so a lost executor re-reads files and a round is never computed twice. Component sums per
cluster are added up in each task (``k`` rows a task) before the shuffle; ``k`` rows of sums reach the driver
and ``k`` centroids are broadcast. The first centroids are the ``k`` smallest by hash, a top k of partial top k. Equal
vectors, even a third of all rows, need no special care: nothing is grouped by vector.

Defined results: vectors that are null, not ``width`` long, or hold a null or non-finite component take no part, nor do
those with an integer component beyond ``LARGEST`` (their squared distances need not fit a long). Repeated rows count each.
Rows with a null id are clustered but never start a centroid. Rows of equal hash (a repeated id) are taken in the order of
their components. With fewer than ``k`` vectors there are as many centroids. A cluster without vectors keeps its
centroid. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize

LARGEST = 1 << 27
STATE = "id long, v binary, dots binary, cluster int, distance long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = 64, scale: int = 64) -> DataFrame:
    """(id, v): the vectors that take part, each component x as the integer floor(scale * x)."""
    x = F.transform(F.col(vec_col), lambda c: F.lit(float(scale)) * c.cast("double"))
    good = F.forall("x", lambda c: F.coalesce(F.abs(c) <= float(LARGEST), F.lit(False)))  # null, NaN and infinity fail too
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where((F.size("x") == width) & good & ~F.exists("x", F.isnan))
    return rows.select("id", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id IS NOT NULL").orderBy(order, "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _nearest(v: np.ndarray, dots: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance); of equally near centroids the one with the smaller number."""
    from_norm = norms - 2 * dots
    cluster = from_norm.argmin(axis=1)
    return cluster, from_norm[np.arange(len(v)), cluster] + np.einsum("ij,ij->i", v, v)


def start(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The first state: all dot products with the first centroids."""
    norms = (centroids * centroids).sum(axis=1)

    def compute(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            v = flat.astype(np.int64).reshape(batch.num_rows, centroids.shape[1])
            dots = v @ centroids.T
            cluster, distance = _nearest(v, dots, norms)
            yield pa.record_batch([batch.column("id"), _packed(v.astype(np.int32)), _packed(dots), pa.array(cluster, pa.int32()), pa.array(distance)],
                                  names=["id", "v", "dots", "cluster", "distance"])

    return vectors.mapInArrow(compute, STATE)


def advance(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the centroids went from old to new: products updated where components changed."""
    k, width = new.shape
    step, norms = new - old, (new * new).sum(axis=1)
    moved = [(c, np.flatnonzero(step[c])) for c in range(k) if step[c].any()]

    def update(batches):
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, width).astype(np.int64)
            dots = _matrix(batch.column("dots"), k).copy()
            for c, at in moved:
                dots[:, c] += v[:, at] @ step[c, at]
            cluster, distance = _nearest(v, dots, norms)
            yield pa.record_batch([batch.column("id"), batch.column("v"), _packed(dots), pa.array(cluster, pa.int32()), pa.array(distance)],
                                  names=["id", "v", "dots", "cluster", "distance"])

    return state.mapInArrow(update, STATE)


def _moved(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """The exact floored means of the clusters; a cluster without vectors keeps its centroid."""
    k, width = old.shape

    def add(batches):
        sums, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, width).astype(np.int64)
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                own = v[cluster == c]
                sums[c] += own.sum(axis=0)
                count[c] += len(own)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                              names=["cluster", "n", "sums"])

    parts = state.select("v", "cluster").mapInArrow(add, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
    out = old.copy()
    for r in totals.collect():  # k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3,
                    width: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """-> id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one row per vector that takes part."""
    rows = materialize(integer_vectors(vectors, id_col, vec_col, width, scale), "cluster_vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.where("false").selectExpr("id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    state = materialize(start(rows, centroids), "cluster_state")
    for i in range(rounds):
        new = _moved(state, centroids)
        state = advance(state, centroids, new)
        if i == rounds - 1:
            state = state.select("id", "cluster", "distance")  # the last state is only read
        state, centroids = materialize(state, "cluster_state"), new
    inertia = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    own = {r["cluster"]: int(r["s"]) for r in inertia}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    spark = vectors.sparkSession
    facts = spark.createDataFrame([(c, str(own[c]), str(sum(own.values())), sha[c]) for c in own],
                                  "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    long = lambda c: F.expr(f"try_cast({c} AS long)").alias(c)  # noqa: E731  null where a sum needs more than a long
    return state.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", long("cluster_inertia"), long("inertia"), "centroid_sha256")
