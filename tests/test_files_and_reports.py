"""Scan of a folder of parquet files; the report text of a document."""

from datetime import datetime

from pyspark.sql import functions as F

from docmetrics.operators import report as R
from docmetrics.sources.documents import scan_parquet_files


def test_scan_of_files_of_any_schema(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(7).coalesce(1).write.parquet(f"{folder}/a.parquet")
    spark.createDataFrame([("x", [1.0])], "t string, v array<double>").coalesce(1).write.parquet(f"{folder}/deep/er/b.parquet")
    spark.range(0).coalesce(1).write.parquet(f"{folder}/empty.parquet")
    (tmp_path / "in" / "notes + more.txt").write_text("no table")
    when = F.lit("2024-01-31 12:00:00").cast("timestamp")
    got = scan_parquet_files(spark, folder, when).collect()
    rows = {r["document_id"].split("/in/")[1].split("/part-")[0]: r["n_rows"] for r in got}
    assert rows == {"a.parquet": 7, "deep/er/b.parquet": 1, "empty.parquet": 0}
    assert {r["file_type"] for r in got} == {".parquet"} and all(r["n_bytes"] > 0 and r["modified"] for r in got)
    assert {r["process_time"] for r in got} == {datetime(2024, 1, 31, 12)}
    assert all(r["file_name"].startswith("part-") and r["file_name"].endswith(".parquet") for r in got)


def test_report_text(spark):
    docs = spark.createDataFrame([("a", "x" * 3 * 1024 * 1024), ("b", None)], "document_id string, text string")
    chunks = spark.createDataFrame([("a", 4, 1)] * 4, "document_id string, total_chunks int, tables_found int")
    results = spark.createDataFrame([("a", 0.8, "environmental"), ("a", 0.5, "social"), ("a", 0.2, "social"), ("a", None, "governance")],
                                    "document_id string, confidence double, category string")
    got = {r["document_id"]: r["report"] for r in R.report_text(docs, chunks, results, F.lit("2024-05-06 07:08:09").cast("timestamp")).collect()}
    assert got["a"].split("\n") == ["# a", "- 大小：3.00 MB", "- 文字段：4", "- 表格：1", "- 指標：4", "- 把握高／中／低：1／1／1",
                                    "- 環境：1", "- 社會：2", "- 治理：1", "- 完成：2024-05-06 07:08:09"]
    assert got["b"].split("\n")[1:6] == ["- 大小：0.00 MB", "- 文字段：0", "- 表格：0", "- 指標：0", "- 把握高／中／低：0／0／0"]
