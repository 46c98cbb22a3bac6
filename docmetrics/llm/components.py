"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two partial aggregations and two equi-joins on the edges; nothing but one count and one
checksum per round reaches the driver. A vertex with a third of all edges is only a skewed join key,
which adaptive execution splits. The edge table of each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) -> (id, comp): each vertex of an edge with the smallest vertex it reaches."""
    cur = materialize(_larger_first(edges), "cc")
    stamp = _stamp(cur)
    for _ in range(max_rounds):
        if not stamp[0]:
            break
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour is tied to the smallest vertex around
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours and the vertex itself are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
        cur = materialize(_larger_first(small), "cc")
        new = _stamp(cur)
        if new == stamp:
            break
        stamp = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionAll(
        cur.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
