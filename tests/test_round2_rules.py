"""Signs, scale words, repeated query ids, empty documents and the scratch folder."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmetrics import session
from docmetrics.functions.sparse import QueryMatrix
from docmetrics.operators.candidates import split_value_unit
from docmetrics.operators.report import doc_summary

VALUES = [("-5 小時", -5.0, "小時"), ("-20%", -20.0, "%"), ("(5) 小時", -5.0, "小時"), ("1.2萬公噸CO2e", 12000.0, "公噸CO2e"), ("3.5億 元", 3.5e8, "元"),
          ("約 12", 12.0, None), ("12,345 公噸CO2e", 12345.0, "公噸CO2e"), ("5萬", 50000.0, None), ("no number", None, None), ("+7 個", 7.0, "個")]


def test_values_keep_sign_and_scale(spark):
    num, unit = split_value_unit(F.col("raw"))
    got = {r.raw: (None if r.v is None else float(r.v), r.u) for r in spark.createDataFrame([(v,) for v, _, _ in VALUES], "raw string").select("raw", num.alias("v"), unit.alias("u")).collect()}
    assert got == {raw: (v, u) for raw, v, u in VALUES}


def test_rows_of_one_query_id_add_up_in_both_forms():
    m = QueryMatrix(["a", "b", "a", "a"], [3, 3, 3, 5], [1, 4, 2, 6], 8)
    assert m.dense()[3].tolist() == [3.0, 4.0] and m.dense()[5].tolist() == [6.0, 0.0]
    assert m.qnorm2.tolist() == [9 + 36, 16] and len(m.qidx) == 3
    assert np.diff(m.qptr).tolist() == [0, 0, 0, 2, 0, 1, 0, 0]


def test_documents_without_chunks_keep_a_row(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "document_id string, text string")
    chunks = spark.createDataFrame([("a", 1, 0, "text")], "document_id string, total_chunks int, tables_found int, source_kind string")
    results = spark.createDataFrame([], "document_id string")
    got = {r.document_id: tuple(r)[1:] for r in doc_summary(docs, chunks, results).collect()}
    assert got == {"a": (1, 0, 0, 0), "b": (0, 0, 0, 0)}


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: None))
    assert not session.is_local(cluster)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(cluster)
    assert session.is_local(SimpleNamespace(sparkContext=SimpleNamespace(master="local[8]")))
    assert not session.is_local(SimpleNamespace(sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]")))
