"""Metric candidates and value normalisation (TXT-7, NORM-1)."""

from decimal import Decimal

from pyspark.sql import functions as F

from docmetrics.operators.candidates import BASE_UNITS, metric_candidates, split_value_unit, value_normalize

REPORT_B_SENTENCES = [
    "2023年溫室氣體排放量為12,345公噸CO2e，相較2022年減少5%。",
    "員工人數達到500人，女性主管比例為35%。",
    "員工平均training時數為42小時/年。",
    "能源使用量 1,234,567 kWh",
]


def _cands(spark, keywords, units=None):
    df = spark.createDataFrame([("B", i, t) for i, t in enumerate(REPORT_B_SENTENCES)],
                               "document_id string, chunk_index int, text string")
    kw = {} if units is None else {"units": units}
    return sorted((r.keyword, r.context, r.value_raw, r.unit)
                  for r in metric_candidates(df, keywords, **kw).collect())


def test_reference_keywords(spark):
    got = _cands(spark, ("員工", "環境", "碳排", "能源", "培訓", "薪資", "安全", "事故"))
    assert got == [
        ("員工", "員工人數達到500人", "500", "人"),
        ("員工", "員工平均training時數為42小時", "42", "小時"),
        ("能源", "能源使用量 1,234,567 ", "1,234,567", None),
    ]


def test_extra_keyword_and_catalogue_units(spark):
    assert _cands(spark, ("溫室",), BASE_UNITS) == [("溫室", "溫室氣體排放量為12,345", "12,345", None)]
    assert _cands(spark, ("溫室",)) == [("溫室", "溫室氣體排放量為12,345公噸CO2e", "12,345", "公噸CO2e")]


def test_max_gap(spark):
    df = spark.createDataFrame([("d", 0, "version of the thing 2.0")],
                               "document_id string, chunk_index int, text string")
    assert metric_candidates(df, ("version",), max_gap=3).count() == 0
    assert metric_candidates(df, ("version",)).first().value_raw == "2.0"


def test_value_normalize(spark):
    df = spark.createDataFrame([("1,234", "萬", False, None), ("3.5", "億", True, None), ("85.6", None, False, "％"), ("12", None, True, "百分比"), ("x", None, False, None)],
                               "value_raw string, scale string, negative boolean, unit string").withColumn("high_raw", F.lit("20"))
    got = [(r.value, r.unit_norm) for r in value_normalize(df).collect()]
    assert got == [(12340000, None), (-350000000, None), (Decimal("85.6"), "%"), (-12, "%"), (None, None)]
    assert dict(value_normalize(df).dtypes)["value"] == "decimal(38,6)"


# text -> value, upper end, unit: the same from running text after a keyword and from the value alone
GRAMMAR = [
    ("-5 立方米", "-5", None, "立方米"), ("(5) 立方米", "-5", None, "立方米"), ("（5）立方米", "-5", None, "立方米"), ("(+5) 立方米", "5", None, "立方米"),
    ("(-5) 立方米", "-5", None, "立方米"), ("−5%", "-5", None, "%"), ("1.2萬公噸CO2e", "12000", None, "公噸CO2e"), ("-1.2 萬 公噸CO2e", "-12000", None, "公噸CO2e"),
    ("12~15 立方米", "12", "15", "立方米"), ("12 – 15萬人", "120000", "150000", "人"), ("12至15 ％", "12", "15", "%"), ("1,234,567.5 元", "1234567.5", None, "元"),
    ("5萬", "50000", None, None), ("3.5億 元", "350000000", None, "元"), ("12", "12", None, None), ("0.0000015 個", "0.000002", None, "個"),
]


def test_one_grammar_in_running_text_and_alone(spark):
    texts = [(str(i), 0, f"用水量：{raw}") for i, (raw, *_) in enumerate(GRAMMAR)]
    cands = value_normalize(metric_candidates(spark.createDataFrame(texts, "document_id string, chunk_index int, text string"), ("用水量",)))
    got = {int(r.document_id): (r.value, r.value_high, r.unit_norm, r.gap) for r in cands.collect()}
    number = lambda x: None if x is None else Decimal(x)
    assert got == {i: (number(v), number(h), u, 1) for i, (_, v, h, u) in enumerate(GRAMMAR)}
    value, unit = split_value_unit(F.col("v"))
    alone = spark.createDataFrame([(raw,) for raw, *_ in GRAMMAR], "v string").select("v", value.alias("a"), unit.alias("b"))
    assert {r.v: (r.a, r.b) for r in alone.collect()} == {raw: (Decimal(v), u) for raw, v, _, u in GRAMMAR}


def test_dashes_and_brackets_that_are_no_signs(spark):
    texts = ["CC-BY-4.0 by", "by-4.0", "by 2023-24", "by (4.0 and more)", "by --- 5", "by the -3 rule", "by (see 7)", "by 9) next"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, chunk_index int, text string")
    got = {(r.chunk_index): (r.value_raw, r.negative, r.high_raw) for r in metric_candidates(df, ("by",), ignore_case=True).collect()}
    assert got == {0: ("4.0", False, None), 1: ("4.0", False, None), 2: ("2023", False, None), 3: ("4.0", False, None), 4: ("5", False, None),
                   5: ("3", True, None), 6: ("7", False, None), 7: ("9", False, None)}


def test_values_beyond_the_decimal_are_null(spark):
    df = spark.createDataFrame([("9" * 40,), ("9" * 32 + "萬",), ("",), (None,)], "v string")
    value, _ = split_value_unit(F.col("v"))
    assert [r[0] for r in df.select(value).collect()] == [None] * 4


def test_split_value_unit(spark):
    df = spark.createDataFrame([("12,345 公噸CO2e",), ("85.6%",), ("",), (None,), (".5 小時",)], "v string")
    v, u = split_value_unit(F.col("v"))
    assert [(r.a, r.b) for r in df.select(v.alias("a"), u.alias("b")).collect()] == [
        (12345, "公噸CO2e"), (Decimal("85.6"), "%"), (None, None), (None, None), (Decimal("0.5"), "小時")]


def test_ignore_case_keeps_text_as_written(spark):
    df = spark.createDataFrame([("d", 0, "Apache License, Version 2.0"), ("d", 1, "排放量 12 公噸CO2e")],
                               "document_id string, chunk_index int, text string")
    got = sorted((r.keyword, r.context, r.value_raw, r.unit)
                 for r in metric_candidates(df, ("version", "排放量"), ignore_case=True).collect())
    assert got == [("version", "Version 2.0", "2.0", None), ("排放量", "排放量 12 公噸CO2e", "12", "公噸CO2e")]
    assert metric_candidates(df, ("version",)).count() == 0
