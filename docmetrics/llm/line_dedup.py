"""Line dedup: lines found in several documents stay only in the document with the smallest id.

Method: the keys of all lines are hashed to 128 bits; the distinct hashes that occur in at least two
documents are dealt into shards, and each shard gets a minimal perfect hash over its hashes, built in
levels: every key sets a bit of the level's bit array, keys that are alone on their bit are placed, the
others go on to the next level; a key's place is the number of set bits before its own. The place indexes
three arrays: fingerprint (the other 64 bits of the hash), document count and smallest document id.
Documents then probe the arrays: a document's hashes travel as one packed value per shard, each task reads
a shard's arrays once and answers the packed values that follow it, and what comes back is one packed
list of dropped hashes per document. A hash that is in no shard lands on some place, where the fingerprint
tells it apart (both halves equal: 2**-128 a pair).

Scale: a document's distinct hashes are packed where its text is read, one row per document, and counted and dealt to the shards
from there: documents times the shards that their lines meet are shuffled, not lines. The shards hold at most about ``SHARD_KEYS`` hashes each (their number follows the count of
repeated lines), so a task holds a few MB of arrays. Line counts are pre-aggregated before the shuffle. A
line of a third of all documents is one key of one shard, whose probes are dealt over ``salt`` parts with a
copy of that shard's arrays each. Each document's text is shuffled once, by its id.

Defined results: a text is split at \\n only; null or empty text is one empty line; a key is the line
without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; keys shorter than ``least`` code points stay.
Documents are told apart by id: repeated rows of one id are one document when documents are counted, and
each of them is returned, treated alike. Rows with a null id are returned unchanged and don't count. An
empty table gives an empty result; further columns are returned untouched inside the struct ``doc``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.llm.common import materialize, mix64, seeds
from docmetrics.session import bound_batches

SHARD_KEYS = 200_000
LEVELS = 24  # keys still not placed after that many levels are kept as a sorted list
SPACE = " \t\n\x0b\x0c\r"
_LEVEL_SEED = seeds(LEVELS, salt=0x1E7E1)


def line_key(line: str) -> str:
    key = line.strip(SPACE)
    return key.encode().lower().decode() if not key.islower() else key


def line_hash(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def _hashes(text: str | None, least: int) -> Iterator[tuple[str, bytes | None]]:
    """(line, hash of its key; None for a key that is too short)."""
    for line in (text or "").split("\n"):
        key = line_key(line)
        yield line, line_hash(key) if len(key) >= least else None


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: ``place(keys)`` is a number in 0..n-1 for each of
    them, and any number in that range (or -1) for a key that is not among them."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        for seed in _LEVEL_SEED:
            if not len(left):
                break
            size = 64 * (len(left) * 2 // 64 + 1)
            at = (mix64(left ^ seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64), np.sort(left))

    def place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for seed, size, start in zip(_LEVEL_SEED, self.sizes, self.starts):
            at = (mix64(keys[todo] ^ seed) % np.uint64(size)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[word] + below)[hit]
            todo = todo[~hit]
            if not len(todo):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[at] == keys[todo], self.before[-1] + at, -1)
        return out


def _packed_lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, key, hashes): the distinct line hashes of every row, packed where the text is whole; rows without any are left out."""

    def rows(batches):
        for batch in batches:
            ids, keys, texts, out = batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), []
            for i in range(len(ids)):
                own = {h for _, h in _hashes(texts[i].as_py(), least) if h}
                if own:
                    out.append((ids[i], keys[i], b"".join(sorted(own))))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["id", "key", "hashes"])

    return docs.mapInArrow(rows, "id long, key long, hashes binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes n x 2, row of the batch, id) of packed rows."""
    blobs = batch.column("hashes").to_pylist()
    row = np.repeat(np.arange(len(blobs)), [len(x) // 16 for x in blobs])
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2), row, batch.column("id").to_numpy()[row] if len(blobs) else np.zeros(0, np.int64)


def count_lines(packed: DataFrame) -> DataFrame:
    """(h1, h2, docs, keep): in how many documents a line is, and the smallest id. Counted per batch before the
    shuffle; only the lines of ids with several rows are made distinct first."""

    def count(batches):
        for batch in batches:
            h, _, doc = _unpacked(batch)
            order = np.lexsort((doc, h[:, 1], h[:, 0]))
            h, doc = h[order], doc[order]
            cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])) if len(h) else np.zeros(0, np.int64)
            for at in range(0, len(cut), 100_000):
                own = cut[at:at + 100_000]
                n = np.diff(np.append(cut, len(h)))[at:at + 100_000]
                yield pa.record_batch([pa.array(h[own, 0]), pa.array(h[own, 1]), pa.array(n), pa.array(doc[own])], names=["h1", "h2", "docs", "keep"])

    def unpack(batches):
        for batch in batches:
            h, _, doc = _unpacked(batch)
            for at in range(0, len(h), 100_000):
                yield pa.record_batch([pa.array(x[at:at + 100_000]) for x in (h[:, 0].copy(), h[:, 1].copy(), doc)], names=["h1", "h2", "id"])

    again = materialize(packed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "line_ids")
    schema = "h1 long, h2 long, docs long, keep long"
    if again.isEmpty():
        parts = packed.mapInArrow(count, schema)
    else:
        apart = packed.join(again, "id", "left_semi").mapInArrow(unpack, "h1 long, h2 long, id long").distinct()
        parts = packed.join(again, "id", "left_anti").select("id", "key", "hashes").mapInArrow(count, schema).unionByName(
            apart.select("h1", "h2", F.lit(1).cast("long").alias("docs"), F.col("id").alias("keep")))
    return parts.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("keep").alias("keep"))


def build_shards(repeated: DataFrame, shards: int) -> DataFrame:
    """(h1, h2, docs, keep) -> one row per shard: the hash's levels and the arrays in its order."""

    def build(group: pa.Table) -> pa.Table:
        h1 = group.column("h1").to_numpy().view(np.uint64)
        order = np.argsort(h1)
        h1 = h1[order]
        once = np.concatenate([[True], h1[1:] != h1[:-1]])  # equal first halves: the second goes to `extra`
        h2, n, keep = (group.column(x).to_numpy()[order] for x in ("h2", "docs", "keep"))
        mph = PerfectHash.build(h1[once])
        place = mph.place(h1[once])
        put = lambda x, kind: np.array(x[once], dtype=kind)[np.argsort(place)].tobytes()
        extra = np.stack([h1[~once].view(np.int64), h2[~once], keep[~once]], axis=1).astype(np.int64) if (~once).any() else np.zeros((0, 3), np.int64)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([mph.sizes], pa.list_(pa.int64())),
                         "bits": [mph.bits.tobytes()], "rest": [mph.rest.tobytes()], "fingerprint": [put(h2, np.int64)],
                         "docs": [put(np.minimum(n, 2**32 - 1), np.uint32)], "keep": [put(keep, np.int64)], "extra": [extra.tobytes()]})

    return (repeated.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard")
            .applyInArrow(build, "shard int, sizes array<long>, bits binary, rest binary, fingerprint binary, docs binary, keep binary, extra binary"))


class _Shard:
    def __init__(self, row: dict):
        self.mph = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["rest"], np.uint64))
        self.fingerprint, self.keep = np.frombuffer(row["fingerprint"], np.int64), np.frombuffer(row["keep"], np.int64)
        self.docs = np.frombuffer(row["docs"], np.uint32)
        self.extra = {(a, b): c for a, b, c in np.frombuffer(row["extra"], np.int64).reshape(-1, 3).tolist()}

    def lost(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of the hashes (n x 2) occur elsewhere in a document of a smaller id than ``doc``."""
        at = self.mph.place(np.ascontiguousarray(h[:, 0]).view(np.uint64))
        known = at >= 0
        at = np.maximum(at, 0)
        out = known & (self.fingerprint[at] == h[:, 1]) & (self.docs[at] > 1) & (self.keep[at] < doc)
        if self.extra:
            out |= np.array([self.extra.get((a, b), d) < d for (a, b), d in zip(h.tolist(), doc.tolist())])
        return out


def split_by_shard(packed: DataFrame, shards: int) -> DataFrame:
    """Packed rows -> (id, key, shard, hashes): one row per row and shard that its lines meet."""

    def split(batches):
        for batch in batches:
            h, row, _ = _unpacked(batch)
            shard = h[:, 0] % shards
            order = np.lexsort((shard, row))
            h, row, shard = np.ascontiguousarray(h[order]), row[order], shard[order]
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])) if len(row) else np.zeros(0, np.int64)
            of = pa.array(row[cut])
            yield pa.record_batch([batch.column("id").take(of), batch.column("key").take(of), pa.array(shard[cut].astype(np.int32)),
                                   pa.array([h[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(row)))], pa.binary())], names=["id", "key", "shard", "hashes"])

    return packed.mapInArrow(split, "id long, key long, shard int, hashes binary")


def _probe(lines: DataFrame, arrays: DataFrame, shards: int) -> DataFrame:
    """(id, key, lost): each row's dropped hashes in a shard, packed."""
    width = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    salt = -(-width // shards)
    packed = split_by_shard(lines, shards).withColumn("part", F.pmod(F.xxhash64("id", "key"), F.lit(salt)).cast("int"))
    copies = arrays.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    dealt = (copies.unionByName(packed, allowMissingColumns=True).repartition(width, "shard", "part")
             .sortWithinPartitions("shard", "part", F.asc_nulls_first("id")))

    def probe(batches):
        shard = None
        for batch in batches:
            lost_of: list[tuple[int, int, bytes]] = []
            ids, keys, hashes = batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("hashes")
            heads = [i for i, d in enumerate(ids) if d is None]
            for a, b in zip([-1, *heads], [*heads, len(ids)]):
                if a >= 0:
                    row = {x: batch.column(x)[a].as_py() for x in batch.schema.names}
                    shard, name = _Shard(row), row["shard"]
                if b == a + 1:
                    continue
                own = batch.column("shard")[a + 1].as_py()
                if shard is None or own != name:
                    continue  # a shard without repeated lines has no arrays
                blobs = hashes.slice(a + 1, b - a - 1).to_pylist()
                same = [x == name for x in batch.column("shard").slice(a + 1, b - a - 1).to_pylist()]
                size = np.array([len(x) // 16 if ok else 0 for x, ok in zip(blobs, same)])
                h = np.frombuffer(b"".join(x for x, ok in zip(blobs, same) if ok), np.int64).reshape(-1, 2)
                row = np.repeat(np.arange(a + 1, b), size)
                gone = shard.lost(h, np.array(ids[a + 1:b], dtype=np.int64)[row - a - 1])
                if gone.any():
                    h, row = np.ascontiguousarray(h[gone]), row[gone]
                    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    lost_of += [(ids[row[i]], keys[row[i]], h[i:j].tobytes()) for i, j in zip(cut, np.append(cut[1:], len(row)))]
            cols = list(zip(*lost_of)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["id", "key", "lost"])

    return dealt.mapInArrow(probe, "id long, key long, lost binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """-> doc (the input row but for the text, as a struct), id, kept (the text that stays), n_lines, n_dropped."""
    bound_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]  # the text is carried once
    # Rows are told apart by id and text hash, so a repeated id costs no larger group than its texts' own lines.
    whole = docs.select(F.struct(*others).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    lines = materialize(_packed_lines(whole.select("id", "key", "text").where("id IS NOT NULL"), least), "lines")
    repeated = materialize(count_lines(lines).where("docs > 1"), "lines_repeated")
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    arrays = materialize(build_shards(repeated, shards), "line_shards")
    lost = _probe(lines, arrays, shards).groupBy("id", "key").agg(F.collect_set("lost").alias("lost"))  # equal rows have equal sets
    rows = whole.join(lost.hint("shuffle_hash"), ["id", "key"], "left")

    def keep(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist()):
                text = text or ""
                n = text.count("\n") + 1
                dropped = 0
                if lost:
                    packed = b"".join(lost)
                    gone = {packed[i:i + 16] for i in range(0, len(packed), 16)}
                    stay = [line for line, h in _hashes(text, least) if h not in gone]
                    dropped, text = n - len(stay), "\n".join(stay)
                kept.append(text)
                n_lines.append(n)
                n_dropped.append(dropped)
            yield pa.record_batch([batch.column("doc"), batch.column("id"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
                                   pa.array(n_dropped, pa.int64())], names=["doc", "id", "kept", "n_lines", "n_dropped"])

    out = T.StructType([rows.schema["doc"], T.StructField("id", T.LongType()), T.StructField("kept", T.StringType()),
                        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.select("doc", "id", "text", "lost").mapInArrow(keep, out)
