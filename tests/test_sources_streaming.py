"""Sources, sinks, catalogue loading and streaming intake (SRC-*, SINK-*, STR-*)."""


import pytest
from pyspark.sql import functions as F

from docmetrics.catalog import ESG_CATALOG, catalog_df, load_catalog
from docmetrics.operators import chunk as C
from docmetrics.sources import documents as D
from docmetrics.sources import sinks as S
from docmetrics.streaming import intake as I

YAML = """
environmental:
  greenhouse_gas:
    name: "溫室氣體排放量"
    code: "E1.1"
    unit: "公噸CO2e"
    type: "numerical"
    possible_sources: ["table", "text", "chart"]
    validation:
      min: 0
      trend: "decreasing"
"""


def test_load_catalog_and_errors(spark, tmp_path):
    p = tmp_path / "m.yaml"
    p.write_text(YAML, encoding="utf-8")
    cat = load_catalog(str(p))
    assert cat[0].metric_id == "greenhouse_gas" and cat[0].vmin == 0.0 and cat[0].trend == "decreasing"
    (tmp_path / "empty.yaml").write_text("", encoding="utf-8")
    with pytest.raises(ValueError):
        load_catalog(str(tmp_path / "empty.yaml"))
    rows = catalog_df(spark, ESG_CATALOG).orderBy("cat_ord", "metric_ord").collect()
    assert [r.metric_id for r in rows] == [m.metric_id for m in ESG_CATALOG]
    assert rows[3].validation.max == 100.0 and rows[3].code == "S2.1"


def test_scan_text_documents_and_gate(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t\n| a | b |\n|---|---|\n| 1 | 2 |\n", encoding="utf-8")
    (tmp_path / "b.TXT").write_text("plain words", encoding="utf-8")
    (tmp_path / "c.html").write_text("<p>x</p>", encoding="utf-8")
    df = D.scan_documents(spark, str(tmp_path), "text", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = {r.file_name: r for r in df.collect()}
    assert set(rows) == {"a.md", "b.TXT", "c.html"}
    assert rows["b.TXT"].file_type == ".txt"
    gate = {r.file_name: (r.status, r.reason) for r in D.format_gate(df).collect()}
    assert gate["a.md"] == ("accepted", None)
    assert gate["c.html"] == ("rejected", "unsupported file type .html")


def test_file_name_rules(spark):
    df = spark.createDataFrame([("https://x.org/a/b/474.HTML?p=1#t",), ("https://x.org/en/",), ("/p/.bashrc",)], "u string")
    got = [(r.n, r.t) for r in df.select(D.file_name_col(F.col("u")).alias("n")).select(
        "n", D.file_type_col(F.col("n")).alias("t")).collect()]
    assert got == [("474.HTML", ".html"), ("", ""), (".bashrc", "")]


def test_sinks(spark, tmp_path):
    vec = spark.createDataFrame([("A", 0, [1.0, 2.0])], "document_id string, chunk_index int, embedding array<float>")
    path = str(tmp_path / "vec")
    S.write_vectors(vec, path)
    S.write_vectors(vec, path, mode="append")
    assert spark.read.parquet(path).count() == 2
    S.write_vectors(vec, path, mode="overwrite")
    assert spark.read.parquet(path).count() == 1
    S.clear_vectors(spark, path, vec.schema)
    assert spark.read.parquet(path).count() == 0
    S.write_results(vec, str(tmp_path / "csv"), fmt="csv")
    txt = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert txt.embedding == "[1.0,2.0]"


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    docs = spark.createDataFrame([(i, ("w%d " % i) * (50 * i + 1)) for i in range(20)], "document_id long, text string")
    docs.write.parquet(str(src))
    streamed = I.run_chunk_stream(spark, str(src), docs.schema)
    batch = C.chunk_words(spark.read.parquet(str(src)).select(F.col("document_id").cast("string"), "text"))
    a = sorted((r.document_id, r.chunk_index, r.text) for r in streamed.collect())
    b = sorted((r.document_id, r.chunk_index, r.text) for r in batch.collect())
    assert a == b and len(a) > 20


def test_resent_document_replaces_chunks(spark, tmp_path):
    src = tmp_path / "in"
    schema = "document_id long, text string"
    spark.createDataFrame([(1, "old " * 300), (2, "keep")], schema).write.parquet(str(src))
    table, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    I.upsert_batches(spark, str(src), spark.read.parquet(str(src)).schema, table, ck).awaitTermination()
    spark.createDataFrame([(1, "new text")], schema).write.mode("append").parquet(str(src))
    I.upsert_batches(spark, str(src), spark.read.parquet(str(src)).schema, table, ck).awaitTermination()
    got = sorted((r.document_id, r.text) for r in I.latest_chunks(spark, table).collect())
    assert got == [("1", "new text"), ("2", "keep")]


def test_vector_table_lifecycle(spark):
    name = "dm_test_vectors"
    vec = spark.createDataFrame([("A", 0, [1.0])], "document_id string, chunk_index int, embedding array<float>")
    S.drop_table(spark, name)
    S.write_vectors_table(vec, name)
    S.write_vectors_table(vec, name, mode="append")
    assert spark.table(name).count() == 2
    S.write_vectors_table(vec, name, mode="overwrite")
    assert spark.table(name).count() == 1
    S.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_binary_scan_manifest(spark, tmp_path):
    (tmp_path / "r.PDF").write_bytes(b"%PDF-1.4 fake")
    (tmp_path / "s.docx").write_bytes(b"PK fake")
    rows = {r.file_name: r for r in D.scan_documents(spark, str(tmp_path), "binary").collect()}
    assert rows["r.PDF"].file_type == ".pdf" and rows["r.PDF"].n_bytes == 13
    assert {r.status for r in D.format_gate(D.scan_documents(spark, str(tmp_path), "binary")).collect()} == {"accepted"}


def test_dedup_latest(spark):
    df = spark.createDataFrame([("A", 0, 1, "old"), ("A", 0, 2, "new"), ("B", 0, 1, "b")],
                               "document_id string, chunk_index int, ingest_time int, text string")
    got = sorted((r.document_id, r.text) for r in S.dedup_latest(df).collect())
    assert got == [("A", "new"), ("B", "b")]


def test_chunk_metadata_map_later_keys_win(spark):
    df = spark.createDataFrame([("A", 3, 8, 1)], "document_id string, chunk_index int, total_chunks int, tables_found int")
    m = C.chunk_metadata_map(df, doc_cols=("total_chunks", "tables_found", "chunk_index")).first().metadata
    assert m == {"total_chunks": "8", "tables_found": "1", "chunk_index": "3", "document_id": "A"}


def test_dedup_latest_is_per_document(spark):
    rows = [("A", i, 1, f"old {i}") for i in range(3)] + [("A", 0, 2, "new"), ("A", 0, 2, "new"), ("B", 0, 1, "b"), (None, 0, 1, "n")]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, ingest_time int, text string")
    assert sorted(r.text for r in S.dedup_latest(df).collect()) == ["b", "n", "new"]


def test_resent_documents_shrink_empty_and_repeat(spark, tmp_path):
    src, table, ck = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "ck")
    schema = "doc long, body string, v int"

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        I.upsert_batches(spark, str(src), spark.createDataFrame([], schema).schema, table, ck, "doc", "body", "v").awaitTermination()
        return {d: [r.text for r in sorted(g, key=lambda r: r.chunk_index)] for d, g in _by_document(I.latest_chunks(spark, table))}

    got = send((1, "one " * 500, 1), (2, "two", 1), (3, "three", 1))
    assert len(got["1"]) == 3 and got["2"] == ["two"]
    got = send((1, "short", 3), (1, "late older copy", 2), (2, "", 2), (3, None, 2))   # twice in a batch, emptied
    assert got == {"1": ["short"]}
    assert send((1, "an older copy", 1), (2, "back", 3)) == {"1": ["short"], "2": ["back"]}


def _by_document(chunks):
    groups = {}
    for r in chunks.collect():
        groups.setdefault(r.document_id, []).append(r)
    return groups.items()


def test_names_of_scanned_files(spark, tmp_path):
    names = ["my report.md", "what?.md", "Q1#2.txt", "a+b.md", "100%25.md", "報告.md"]
    for n in names:
        (tmp_path / n).write_text("x", encoding="utf-8")
    text, binary = (D.scan_documents(spark, str(tmp_path), f) for f in ("text", "binary"))
    assert sorted(r.file_name for r in text.collect()) == sorted(names)
    assert {r.document_id for r in text.collect()} == {r.document_id for r in binary.collect()}
    assert {r.status for r in D.format_gate(binary).collect()} == {"accepted"}
