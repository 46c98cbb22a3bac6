"""Blockwise chunking equals the sequential chunker; the chunk table's manifest, replays, breaks and compaction."""

import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmetrics.functions.text import greedy_word_chunks
from docmetrics.operators import long_text as L
from docmetrics.streaming import table as ST


def by_blocks(text, size, limit):
    """The operator's steps on one text, without Spark."""
    open_size, no, chunks = 0, 0, {}
    for block in L.cut_blocks(text, size):
        ends, closes = L.block_table(block, limit)
        for i, piece in enumerate(L.block_pieces(block, open_size, limit)):
            if piece:
                chunks.setdefault(no + i, []).append(piece)
        no, open_size = no + closes[open_size], ends[open_size]
    assert sorted(chunks) == list(range(len(chunks)))
    return [" ".join(chunks[i]) for i in range(len(chunks))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 80), st.integers(1, 40), st.sampled_from([" ", "\n", "  \t", "　"]))
def test_blocks_compose_to_the_sequential_chunker(sizes, block, limit, blank):
    text = blank.join("x" * n for n in sizes)
    assert by_blocks(text, block, limit) == greedy_word_chunks(text, limit)


@pytest.mark.parametrize("limit", [1, 2, 5, 800])
def test_block_edges(limit):
    for text in ("", " ", "a", " a ", "a" * 900 + " b", "a " * 1_000, " " * 50 + "a" + " " * 50 + "b", "b" * limit + " c" * 5):
        for size in (1, 3, 10, 1_000):
            assert by_blocks(text, size, limit) == greedy_word_chunks(text, limit), (text[:20], size)


def test_operator_equals_sequential_chunks_and_spreads_one_document(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.choice([1, 3, 8, 8, 30, 900]) for _ in range(rng.choice([0, 1, 30, 3_000]))) for _ in range(25)]
    texts += ["long word " * 60_000, None, "", " ", "short"]
    rows = [(i if i else None, "d", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, d, t, 1) for i, d, t in rows], "doc_id long, n string, text string, block int").select("doc_id", "n", "text")
    got = {}
    for r in L.chunk_long_words(docs, ["doc_id", "n"], block_chars=2_000).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["text"]
    for i, _, t in rows:
        want = greedy_word_chunks(t)
        assert [got.get(i, {}).get(k) for k in range(len(want))] == want and len(got.get(i, {})) == len(want)


def test_one_long_document_is_packed_by_several_tasks(spark):
    doc = spark.createDataFrame([("d", "some words of a text " * 100_000)], "document_id string, text string")
    chunks = L.chunk_long_words(doc, block_chars=50_000).withColumn("task", F.spark_partition_id())
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    blocks = spark.createDataFrame([(i, b) for i, b in enumerate(L.cut_blocks("some words of a text " * 100_000, 50_000))], "block int, text string")
    assert blocks.count() == 42
    spread = blocks.repartition(8, "block").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 4
    assert chunks.count() == len(greedy_word_chunks("some words of a text " * 100_000))


# --- the table of chunks ---

T0, T1, T2 = (datetime(2024, 1, d) for d in (1, 2, 3))


def batch(spark, rows):
    return spark.createDataFrame(rows, "document_id string, text string, version timestamp")


def content(spark, path):
    out = {}
    for r in ST.newest_chunks(spark, path).collect():
        out.setdefault(r["document_id"], {})[r["chunk_index"]] = r["text"]
    return {d: [c[i] for i in range(len(c))] for d, c in out.items()}


def test_resent_documents_replay_and_compaction(spark, tmp_path):
    path = str(tmp_path / "table")
    assert content(spark, path) == {} and ST.compact(spark, path) is None
    long = "word " * 400
    assert ST.add_batch(batch(spark, [("a", long, T0), ("b", "one", T0), ("b", "two", T1), (None, "no id", T0)]), 0, path)
    assert ST.add_batch(batch(spark, [("a", "short", T1), ("c", "three", T0)]), 1, path)
    first = {"a": ["short"], "b": ["two"], "c": ["three"], None: ["no id"]}
    assert content(spark, path) == first
    assert not ST.add_batch(batch(spark, [("a", "replayed", T2)]), 1, path)  # a batch that is in is not taken again
    assert content(spark, path) == first
    name = ST.compact(spark, path)
    assert ST.manifest(spark, path)["live"] == [name] and content(spark, path) == first
    assert ST.dead_folders(spark, path) == ["batch-000000000000", "batch-000000000001"]
    assert not ST.add_batch(batch(spark, [("a", "replayed", T2)]), 0, path)  # also after its folder was compacted away
    assert ST.add_batch(batch(spark, [("b", None, T2), ("c", "late and old", datetime(2023, 1, 1))]), 2, path)
    assert content(spark, path) == {"a": ["short"], "c": ["three"], None: ["no id"]}
    ST.compact(spark, path)
    assert ST.add_batch(batch(spark, [("b", "older than its removal", T1)]), 3, path)
    assert "b" not in content(spark, path)


def test_a_broken_off_compaction_or_batch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    for i in range(3):
        ST.add_batch(batch(spark, [("a", f"copy {i}", datetime(2024, 1, 1 + i)), (f"d{i}", "x", T0)]), i, path)
    before = content(spark, path)

    def stop(*_):
        raise RuntimeError("broken off")
    switch = ST._switch
    monkeypatch.setattr(ST, "_switch", stop)  # after the rows are written, before the manifest
    for job in (lambda: ST.compact(spark, path), lambda: ST.add_batch(batch(spark, [("a", "half", T2)]), 3, path)):
        with pytest.raises(RuntimeError, match="broken off"):
            job()
    assert content(spark, path) == before
    assert len(ST.dead_folders(spark, path)) == 2
    monkeypatch.setattr(ST, "_switch", switch)
    assert ST.add_batch(batch(spark, [("a", "whole", datetime(2024, 2, 1))]), 3, path)  # the replay takes the folder over
    assert content(spark, path)["a"] == ["whole"]
    ST.compact(spark, path)
    assert content(spark, path) == before | {"a": ["whole"]}


def test_two_writers_cannot_both_switch(spark, tmp_path):
    path = str(tmp_path / "table")
    ST.add_batch(batch(spark, [("a", "x", T0)]), 0, path)
    state = ST.manifest(spark, path)
    ST._switch(spark, path, state, state["live"], state["batches"], state["compacted_to"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        ST._switch(spark, path, state, [], [], -1)


def test_compacted_reads_skip_dead_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    for i in range(4):
        ST.add_batch(batch(spark, [("a", f"copy {i}", datetime(2024, 1, 1 + i))]), i, path)
    name = ST.compact(spark, path)
    files = ST.live_rows(spark, path).inputFiles()
    assert files and all(f"/data/{name}/" in f for f in files)


def test_stream_into_the_table(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    batch(spark, [("a", "first", T0), ("b", "kept", T0)]).coalesce(1).write.parquet(f"{source}/1")
    schema = "document_id string, text string, version timestamp"
    run = lambda: ST.start_upserts(spark, f"{source}/*", schema, path, str(tmp_path / "ckpt"), version_col="version").awaitTermination()
    run()
    batch(spark, [("a", "second", T1)]).coalesce(1).write.parquet(f"{source}/2")
    run()
    assert content(spark, path) == {"a": ["second"], "b": ["kept"]}
    assert len(ST.manifest(spark, path)["live"]) == 2
