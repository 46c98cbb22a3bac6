"""Model hooks (UDF-1/2) and sheet verbalisation (TXT-6)."""

import json

from pyspark.sql import functions as F

from docmetrics.operators import chunk as C
from docmetrics.operators import extract as X
from docmetrics.operators.hooks import complete_with, embed_with


def test_embedder_hook(spark):
    def fake_embedder(texts):   # local, so it ships by value to the workers
        return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "a" * i) for i in range(70)], "chunk_index int, text string")
    out = embed_with(df, fake_embedder, batch_size=32).collect()
    assert len(out) == 70
    assert all(r.embedding == [float(r.chunk_index), float(r.chunk_index), 1.0] for r in out)


def test_completer_hook_feeds_parser(spark):
    def fake_completer(prompts):
        return [json.dumps({"value": str(len(p)), "source": "hook", "confidence": 0.9}) if "x" in p
                else "no" for p in prompts]

    df = spark.createDataFrame([("d", "water_usage", "x y"), ("d", "compensation", "zz")],
                               "document_id string, metric_id string, prompt string")
    answered = complete_with(df, fake_completer)
    parsed = {r.metric_id: (r.value, r.reason) for r in X.parse_responses(answered).collect()}
    assert parsed == {"water_usage": ("3", None), "compensation": (None, "not an object")}


def test_verbalize_sheet(spark):
    df = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 | 2 |", "Sheet1")], "t string, name string")
    assert df.select(C.verbalize_sheet(F.col("t"), F.col("name"))).first()[0] == "\n工作表: Sheet1\na b\n1 2\n"
