"""N-gram Jaccard join: which documents have word-shingle sets with a Jaccard similarity of at least t.

Method: rare-first prefix filtering. All sets are put in one global order, shingles of few documents
first. Two sets that reach t share a shingle among the first ``n - ceil(t*n) + 1`` of each, so documents
are joined on those prefix shingles only; a candidate must then pass the length filter, the positional
filter (what can still be shared behind the common shingle) and the suffix filter (difference of the two
sets' counts over hash ranges), and is verified once, on the whole sets.

Groups of copies never become all pairs:

* equal sets are one class, represented by the smallest document id;
* every prefix shingle's documents of about one length have a pivot, the one with the fewest rarer shingles
  (of a group of near copies, the one nearest to their common text); each document is first verified
  against the pivots of its largest and its smallest shingle groups (stars). Documents tied to a pivot are
  then known to be connected, and only pairs that lie in *different* components so far are still compared: each shingle's documents outside its largest
  component meet all of that shingle's documents. No link between two components is lost, so the
  components are those of all links.

The result is the join's components and classes, not its links: pairs inside one component are not all verified,
so neither the links nor their number are known. The op1 contract asks for the shingle counts and components only,
and those are exact.

The frequency order needs only to be the same for all documents to be right; its quality decides the
number of candidates. Every shingle is counted per task; those that a task sees often are summed over all
tasks and the most frequent ``ORDER_SIZE`` (fixed bound, 3 MB) are broadcast with their ranks. All other
shingles count as rare and are ordered by hash.

Defined results: null or empty text, or no words, gives an empty set, linked with nothing; a text of
fewer than k words has its whole sequence as its one shingle; equal texts (ties, repeated rows of one id)
are one class; repeated rows of an id are one document and give one row (of different texts, the one with
the smallest xxhash64 stands for the id); rows with a null id take no part (they are not in the result). An empty table gives an empty result. Other columns of
the input are not looked at. Sets are of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize, mix64, signed, text_slices
from docmetrics.llm.components import components
from docmetrics.session import bound_batches

ORDER_SIZE = 262_144  # frequent shingles in the broadcast order
LOCAL_LEAST = 2  # a task reports shingles that it saw in so many documents
PIVOTS = 2  # pivots that a document is verified against first: of its largest shingle groups, and of its smallest
BROADCAST_IDS = 500_000  # ids (8 bytes each) that may be broadcast to pick texts; more are joined by a shuffle
LOCAL_BLOCK = 2_000_000  # shingles counted at once in a task
SUFFIX_CELLS = 64  # hash ranges whose counts are compared before a pair's texts are fetched
PARITY = ("p0", "p1", "p2", "p3")  # 256 parities of counts over hash ranges, compared where postings meet
SALT_ROWS = 2_000  # members verified against one copy of a pivot's set


def _doc_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row's text."""
    for s in text_slices(batch.column("text")):
        h, bounds = s.shingles(k)
        for d in range(s.n):
            yield s.first + d, np.unique(h[bounds[d]:bounds[d + 1]])


def shingle_order(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (sorted) and their ranks from 1, the most frequent last."""

    def count(batches):
        kept, size = [], 0

        def flush():
            token, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= LOCAL_LEAST
            return pa.record_batch([pa.array(signed(token[often])), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for _, u in _doc_sets(batch, k):
                kept.append(u)
                size += len(u)
                if size >= LOCAL_BLOCK:
                    yield flush()
                    kept, size = [], 0
        if size:
            yield flush()

    top = (docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "token").limit(ORDER_SIZE).toPandas())
    token = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    rank = np.arange(len(token), 0, -1, dtype=np.int32)
    by = np.argsort(token)
    return token[by], rank[by]


def _described(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row per document: set size, a 128-bit digest of the set, its prefix in the global order, and
    its counts over SUFFIX_CELLS hash ranges."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, k))

    def describe(batches):
        token, rank = order.value
        for batch in batches:
            size, digest, prefix, cells, parity = [], [], [], [], []
            for _, u in _doc_sets(batch, k):
                n = len(u)
                r = np.zeros(n, dtype=np.int32)
                if n and len(token):
                    at = np.minimum(np.searchsorted(token, u), len(token) - 1)
                    r = np.where(token[at] == u, rank[at], 0)
                first = np.argsort(r, kind="stable")[:n - -(-num * n // den) + 1] if n else []
                size.append(n)
                digest.append(np.array([u.sum(dtype=np.uint64), mix64(u).sum(dtype=np.uint64)], dtype=np.uint64).tobytes())
                prefix.append(u[first].tobytes())
                cells.append(np.minimum(np.bincount(u >> np.uint64(58), minlength=SUFFIX_CELLS), 255).astype(np.uint8).tobytes())
                parity.append(np.packbits(np.bincount(u >> np.uint64(56), minlength=256).astype(np.uint8) & 1).tobytes())
            odd = np.frombuffer(b"".join(parity), np.int64).reshape(-1, len(PARITY))
            yield pa.record_batch([batch.column("doc_id"), batch.column("stamp"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                                   pa.array(prefix, pa.binary()), pa.array(cells, pa.binary()), *(pa.array(odd[:, i].copy()) for i in range(len(PARITY)))],
                                  names=["doc_id", "stamp", "n", "digest", "prefix", "cells", *PARITY])

    return docs.withColumn("stamp", F.xxhash64("text")).mapInArrow(describe, "doc_id long, stamp long, n long, digest binary, prefix binary, cells binary, " + ", ".join(f"{p} long" for p in PARITY))


def _postings(classes: DataFrame) -> DataFrame:
    def explode(batches):
        for batch in batches:
            prefix = batch.column("prefix").to_pylist()
            m = np.array([len(p) // 8 for p in prefix], dtype=np.int64)
            token = np.frombuffer(b"".join(prefix), dtype=np.int64)
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), m)
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), m)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(m) - m, m)
            for at in range(0, len(token), 100_000):
                to = at + 100_000
                yield pa.record_batch([pa.array(token[at:to]), pa.array(rep[at:to]), pa.array(n[at:to].astype(np.int32)),
                                       pa.array(pos[at:to].astype(np.int32))], names=["token", "rep", "n", "pos"])

    return classes.select("rep", "n", "prefix").mapInArrow(explode, "token long, rep long, n int, pos int")


def _index_prefix(num: int, den: int):
    """Whether a posting is in the short prefix that holds the first common shingle if its set is the smaller one:
    ``2t/(1+t)`` of the smaller set must be shared, as the other one has no fewer."""
    return F.expr(f"pos <= n - (2L * {num} * n + {num + den - 1}) div {num + den}")


def _may_link(num: int, den: int):
    """Length, positional and parity filter of two postings (n, pos, ..) and (n2, pos2, ..) of one shingle."""
    both = F.col("n") + F.col("n2")
    shared = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(p).bitwiseXOR(F.col(p + "_2"))) for p in PARITY))
    return ((den * F.least("n", "n2") >= num * F.greatest("n", "n2")) & ((num + den) * shared >= num * both)
            & ((num + den) * differ <= (den - num) * both))  # both - 2 * (num * both / (num + den))


def _suffix_filter(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose counts over the hash ranges do not already differ by too much."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"c_{x}"))

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ca, cb = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint8).reshape(-1, SUFFIX_CELLS).astype(np.int32)
                      for x in ("c_a", "c_b"))
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            least = -(-num * both // (num + den))  # shingles that the two must share
            ok = np.abs(ca - cb).sum(axis=1) <= both - 2 * least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, few: bool, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the similarity. Members b are dealt by their pivot a, at most
    about SALT_ROWS to a part; each part holds a's text once, before its members' texts. With ``few`` pairs
    (at most BROADCAST_IDS) the pairs go to the texts, which are then shuffled once only."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int").alias("parts"))
    text_of = lambda x: texts.select(F.col("doc_id").alias(x), "text")
    sent = F.broadcast if few else lambda df: df
    heads = (text_of("a").join(sent(parts), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                                        F.lit(None).cast("long").alias("b"), "text"))
    dealt_to = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "part", "b")
    members = text_of("b").join(sent(dealt_to), "b").select("a", "part", "b", "text")
    rows = heads.unionByName(members)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def check(batches):
        pivot = None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out_a, out_b = [], []
            for row, u in _doc_sets(batch, k):
                if b[row] is None:
                    pivot = u
                    continue
                same = len(np.intersect1d(pivot, u, assume_unique=True))
                if den * same >= num * (len(pivot) + len(u) - same):
                    out_a.append(a[row])
                    out_b.append(b[row])
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(check, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """-> doc_id, n_shingles, component_id (smallest id reachable by links), class_id (smallest id with the
    same set; null for empty sets). ``similarity`` is a fraction (numerator, denominator)."""
    bound_batches(docs.sparkSession)
    num, den = similarity
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    sets = materialize(_described(docs, k, num, den), "ngram_sets")
    again = sets.groupBy("doc_id").agg(F.min("stamp").alias("lo"), F.count("*").alias("k")).where("k > 1").drop("k")
    if repeated := not again.isEmpty():
        sets = materialize(sets.join(again, "doc_id", "left").where("lo IS NULL OR stamp = lo").drop("lo").dropDuplicates(["doc_id"]), "ngram_sets")
    classes = materialize(sets.where("n > 0").groupBy("n", "digest").agg(
        F.min("doc_id").alias("rep"), F.min_by("cells", "doc_id").alias("cells"), *(F.first(p).alias(p) for p in PARITY)), "ngram_classes")

    # Prefix shingles of two classes or more, one of which has it in its index prefix, with each one's length bucket: linked
    # sets are at most one bucket apart.
    step = math.log(den / num) + 1e-9 if num < den else 1.0
    postings = _postings(sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep"))
    # A shingle of just two sets is kept only if they pass the length and the positional filter.
    shared = (postings.groupBy("token").agg(F.count("*").alias("k"), F.bool_or(_index_prefix(num, den)).alias("index"), F.min("n").alias("lo"),
                                            F.max("n").alias("hi"), F.sum("n").alias("both"), F.min(F.col("n") - F.col("pos")).alias("left"))
              .where("k > 1 AND index").where((F.col("k") > 2) | ((den * F.col("lo") >= num * F.col("hi")) & ((num + den) * F.col("left") >= num * F.col("both"))))
              .select("token"))
    postings = materialize(postings.join(shared, "token").join(classes.select("rep", *PARITY), "rep").withColumn("bucket", F.floor(F.log("n") / step).cast("int"))
                           .withColumn("half", F.floor(F.log("n") / step + 0.5).cast("int")), "ngram_postings")

    def verified(pairs: DataFrame) -> DataFrame:
        few = pairs.count() <= BROADCAST_IDS
        texts = docs
        if repeated or not few:
            ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
            texts = materialize(texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")) if repeated else texts, "ngram_texts")
        return _verify(pairs, texts, few, k, num, den)

    def star(bucket: str) -> DataFrame:
        pivots = (postings.groupBy("token", bucket).agg(F.min(F.struct("pos", "n", "rep", *PARITY)).alias("p"), F.count("*").alias("k"))
                  .where("k > 1").select("token", bucket, "k", F.col("p.n").alias("n2"), F.col("p.rep").alias("a"), F.col("p.pos").alias("pos2"),
                          *(F.col(f"p.{p}").alias(p + "_2") for p in PARITY)))
        return postings.join(pivots, ["token", bucket]).where((F.col("rep") != F.col("a")) & _may_link(num, den)).select("a", F.col("rep").alias("b"), "k")

    stars = (star("bucket").unionAll(star("half")).groupBy("a", "b").agg(F.max("k").alias("k"))
             .withColumn("large", F.expr("row_number() OVER (PARTITION BY b ORDER BY k DESC, a)"))
             .withColumn("small", F.expr("row_number() OVER (PARTITION BY b ORDER BY k, a)")))
    pairs = stars.where((F.col("large") <= PIVOTS) | (F.col("small") <= PIVOTS)).select("a", "b")
    tried = materialize(_suffix_filter(pairs, classes, num, den), "ngram_pairs")
    links = materialize(verified(tried), "ngram_links")
    comps = components(links)

    # What is left: pairs of one shingle that are not in one component yet.
    tagged = postings.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    main = (tagged.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token")
            .agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("token", "main"))
    tagged = materialize(tagged.join(main, "token"), "ngram_rest")
    minor = (tagged.where("comp != main").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
             .select("token", "bucket", F.col("rep").alias("a"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"), *(F.col(p).alias(p + "_2") for p in PARITY)))
    rest = (tagged.join(minor, ["token", "bucket"]).where((F.col("comp") != F.col("comp2")) & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("rep"))))
            .where(_may_link(num, den)).select("a", F.col("rep").alias("b")).distinct())
    known = tried.unionAll(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = materialize(_suffix_filter(rest.join(known, ["a", "b"], "left_anti"), classes, num, den), "ngram_rest_pairs")
    links = links.unionAll(verified(rest))

    comps = components(links).withColumnRenamed("id", "rep")
    out = sets.select("doc_id", "n", "digest").join(classes.select("n", "digest", "rep"), ["n", "digest"], "left").join(comps, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"), F.col("rep").alias("class_id"))
