"""Answer parsing, result rows and confidence reports (RAG-4/5, FLT-1..3, PRJ-1, AGG-1..6)."""

from docmetrics.operators import extract as X
from docmetrics.operators import report as R

FENCED = '```json\n{"value":"1","source":"s","confidence":0.5}\n```'
ROWS = [
    ('{"value":"12","source":"p1","confidence":0.9}', True, True, None),
    ('{"value":"12","source":"p1","confidence":"0.9","trend":"down"}', True, True, None),
    ('{"value":"","source":"p1","confidence":0.1}', True, False, None),
    ('{"value":null,"source":"p1","confidence":0.1}', True, False, None),
    ('{"value":"1"}', False, False, "missing key"),
    ("not json", False, False, "not an object"),
    (FENCED, False, False, "not an object"),
    ("null", False, False, "not an object"),
    ('{"value":{"a":1},"source":"s","confidence":0.5}', True, True, None),
    ('{"value":"1","source":"s","confidence":"high"}', True, True, None),
]


def _parsed(spark):
    df = spark.createDataFrame([("d", i, "greenhouse_gas", r[0]) for i, r in enumerate(ROWS)],
                               "document_id string, response_id int, metric_id string, response string")
    return X.parse_responses(df)


def test_keep_and_reject(spark):
    p = _parsed(spark)
    kept = {r.response_id for r in X.kept_answers(p).collect()}
    with_value = {r.response_id for r in X.kept_answers(p, require_value=True).collect()}
    reasons = {r.response_id: r.reason for r in X.rejected_answers(p).collect()}
    for i, (_, live, req, reason) in enumerate(ROWS):
        assert (i in kept) == live
        assert (i in with_value) == req
        assert reasons.get(i) == reason


def test_answers_of_unknown_metrics_are_rejected_with_a_reason(spark):
    good = '{"value":"1","source":"s","confidence":0.5}'
    rows = [("d", 0, "greenhouse_gas", good), ("d", 1, "no_such_metric", good), ("d", 2, None, good), ("d", 3, "no_such_metric", "null")]
    p = X.parse_responses(spark.createDataFrame(rows, "document_id string, response_id int, metric_id string, response string"))
    assert {r.response_id: r.reason for r in X.rejected_answers(p, X.ESG_CATALOG).collect()} == {
        1: "unknown metric", 2: "unknown metric", 3: "not an object"}
    assert X.result_rows(p).count() == 1


def test_results_come_in_order(spark):
    """Lists, not sets: documents in order, in each the catalogue's order, and the position says the same."""
    good = '{"value":"%d","source":"s","confidence":0.5}'
    metrics = ["risk_management", "greenhouse_gas", "compensation", "water_usage"]
    rows = [(f"d{i % 7}", i, metrics[i * 3 % 4], good % i) for i in range(56)]
    df = spark.createDataFrame(rows, "document_id string, response_id int, metric_id string, response string").repartition(5)
    got = [(r.document_id, r.position, r.metric_id, r.response_id) for r in X.result_rows(X.parse_responses(df), ordered=True, keep_cols=("response_id",)).collect()]
    place = {m.metric_id: i for i, m in enumerate(X.ESG_CATALOG)}
    want = sorted(((d, place[m], i, m) for d, i, m, _ in rows))
    assert [(d, m, i) for d, _, m, i in got] == [(d, m, i) for d, _, i, m in want]
    assert [p for _, p, _, _ in got] == [1, 2, 3, 4, 5, 6, 7, 8] * 7


def test_parsed_fields(spark):
    rows = {r.response_id: r for r in _parsed(spark).collect()}
    assert rows[0].trend == "" and rows[0].confidence == 0.9
    assert rows[1].trend == "down" and rows[1].confidence == 0.9
    assert rows[3].value is None
    assert rows[8].value == '{"a":1}'
    assert rows[9].confidence is None


def test_result_rows_use_catalogue(spark):
    out = X.result_rows(_parsed(spark), ordered=True).collect()
    assert {r.item for r in out} == {"溫室氣體排放量"}
    assert {r.category for r in out} == {"environmental"}
    assert len(out) == 6


def _conf(spark):
    vals = [0.0, 0.49, 0.5, 0.79, 0.8, 1.0]
    return spark.createDataFrame([("d", v, "social" if v < 0.5 else "environmental", "m")
                                  for v in vals], "document_id string, confidence double, category string, metric_id string")


def test_confidence_edges(spark):
    d = R.bucket_counts(_conf(spark)).first()
    assert (d.n_high, d.n_mid, d.n_low) == (2, 2, 2)
    c = R.bucket_counts(_conf(spark), closed=True).first()
    assert (c.n_high, c.n_mid, c.n_low) == (2, 3, 2)


def test_shares_and_categories(spark):
    shares = {r.bucket: (r.n, r.share) for r in R.bucket_shares(R.bucket_counts(_conf(spark))).collect()}
    assert shares["high"] == (2, 2 / 6)
    cats = {r.category: (r.n, r.label) for r in R.category_counts(_conf(spark)).collect()}
    assert cats == {"social": (2, "社會"), "environmental": (4, "環境")}


def test_rollup_levels(spark):
    rows = R.report_rollup(_conf(spark)).collect()
    assert sorted(r.level for r in rows) == [0, 0, 1, 1, 3]
    assert [r.n_results for r in rows if r.level == 3] == [6]


def test_metric_fanout_and_gap(spark):
    docs = spark.createDataFrame([("A",), ("B",)], "document_id string")
    fan = X.metric_fanout(docs)
    assert fan.count() == 12
    res = spark.createDataFrame([("A", "water_usage")], "document_id string, metric_id string")
    gap = X.coverage_gap(fan, res)
    assert gap.count() == 11
    assert "Join" not in fan._jdf.queryExecution().executedPlan().toString()
