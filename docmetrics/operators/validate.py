"""Validation rules from the catalogue (FLT-4, FLT-5, VAL-1..6, WIN-3).

All rules are column expressions over rows that carry a ``metric_id``; the
catalogue attributes come from a literal map, so no rule joins. The trend
rule pre-aggregates to one row per (entity, metric, period) before its
window, so a window partition holds one series of periods, whatever the
number of raw rows behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmetrics.catalog import ESG_CATALOG
from docmetrics.operators.extract import catalog_map


def _m(catalog) -> Column:
    return F.element_at(catalog_map(catalog), F.col("metric_id"))


def range_status(m: Column, v: Column) -> Column:
    ok = (m["vmin"].isNull() | (v >= m["vmin"])) & (m["vmax"].isNull() | (v <= m["vmax"]))
    return F.when(v.isNull(), "skip").when(ok, "pass").otherwise("fail")


def recommended_severity(m: Column, v: Column) -> Column:
    rec = m["recommended_min"]
    return F.when(v.isNull() | rec.isNull(), "skip").when(v < rec, "warning").otherwise("ok")


def type_status(m: Column, v: Column, unit: Column) -> Column:
    t = m["type"]
    ok = (F.when(t == "percentage", v.isNotNull() & (unit == "%"))
          .when(t == "numerical", v.isNotNull())
          .otherwise(F.lit(True)))
    return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def source_status(m: Column, kind: Column) -> Column:
    ok = F.array_contains(m["possible_sources"], kind)
    return F.when(kind.isNull(), "skip").when(ok, "pass").otherwise("fail")


def validate_range(obs: DataFrame, catalog=ESG_CATALOG, value_col: str = "value") -> DataFrame:
    """VAL-1: min <= value <= max; a NULL bound passes, a NULL value is 'skip'."""
    m = _m(catalog)
    return obs.select("*", m["vmin"].alias("vmin"), m["vmax"].alias("vmax"),
                      range_status(m, F.col(value_col)).alias("status"))


def validate_recommended(obs: DataFrame, catalog=ESG_CATALOG, value_col: str = "value") -> DataFrame:
    """VAL-2: value below recommended_min is a warning, not an error."""
    m = _m(catalog)
    return obs.select("*", m["recommended_min"].alias("recommended_min"),
                      recommended_severity(m, F.col(value_col)).alias("severity"))


def validate_type(obs: DataFrame, catalog=ESG_CATALOG, value_col: str = "value",
                  unit_col: str = "unit") -> DataFrame:
    """VAL-4: 'percentage' needs a % unit; 'numerical' needs a parsed number."""
    m = _m(catalog)
    return obs.select("*", m["type"].alias("type"),
                      type_status(m, F.col(value_col), F.col(unit_col)).alias("status"))


def validate_source(obs: DataFrame, catalog=ESG_CATALOG, kind_col: str = "source_kind") -> DataFrame:
    """VAL-5: the evidence's source kind is one the metric allows."""
    m = _m(catalog)
    return obs.select("*", F.array_join(m["possible_sources"], ",").alias("allowed"),
                      source_status(m, F.col(kind_col)).alias("status"))


def metric_trend(series: DataFrame, entity_cols=("entity",), metric_col: str = "metric_id",
                 period_col: str = "period", value_col: str = "value") -> DataFrame:
    """WIN-3: per entity and metric, each period's value against the previous one.

    Rows are first summed per (entity, metric, period). ``trend`` is
    increasing / decreasing / flat, NULL for the first period.
    """
    keys = [*entity_cols, metric_col]
    per = series.groupBy(*keys, period_col).agg(F.sum(value_col).alias("value"))
    w = Window.partitionBy(*keys).orderBy(period_col)
    prev = F.lag("value").over(w)
    out = per.select("*", prev.alias("prev_value"))
    d = F.col("value") - F.col("prev_value")
    return out.withColumn(
        "trend", F.when(F.col("prev_value").isNull(), F.lit(None).cast("string"))
        .when(d > 0, "increasing").when(d < 0, "decreasing").otherwise("flat"))


def validate_trend(trends: DataFrame, catalog=ESG_CATALOG) -> DataFrame:
    """VAL-3: observed step trend against the declared one (metrics that declare one)."""
    m = _m(catalog)
    decl = m["trend"]
    return (trends.filter(decl.isNotNull() & F.col("trend").isNotNull())
            .select("*", decl.alias("declared"),
                    F.when(F.col("trend") == decl, "pass").otherwise("fail").alias("status")))


def validation_report(obs: DataFrame, trends: DataFrame | None, id_col: str,
                      catalog=ESG_CATALOG, value_col: str = "value", unit_col: str = "unit",
                      kind_col: str = "source_kind") -> DataFrame:
    """VAL-6: one long frame of failures and warnings.

    Columns: id, metric_id, rule, severity ('error'|'warning'), observed,
    expected. All four row rules are evaluated in one pass over ``obs`` (one
    array of findings per row, exploded and filtered), not one scan per rule.
    """
    def fmt(c: Column) -> Column:
        return F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%.4f", c))

    m = _m(catalog)
    v = F.col(value_col)

    def finding(rule, severity, observed, expected, hit):
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                        observed.alias("observed"), expected.alias("expected"), hit.alias("hit"))

    findings = F.array(
        finding("range", "error", fmt(v),
                F.concat(F.lit("["), fmt(m["vmin"]), F.lit(", "), fmt(m["vmax"]), F.lit("]")),
                range_status(m, v) == "fail"),
        finding("recommended", "warning", fmt(v), F.concat(F.lit(">= "), fmt(m["recommended_min"])),
                recommended_severity(m, v) == "warning"),
        finding("type", "error", F.coalesce(F.col(unit_col), F.lit("")), m["type"],
                type_status(m, v, F.col(unit_col)) == "fail"),
        finding("source", "error", F.col(kind_col), F.array_join(m["possible_sources"], ","),
                source_status(m, F.col(kind_col)) == "fail"),
    )
    out = (obs.select(F.col(id_col).cast("string").alias("id"), "metric_id", F.inline(findings))
           .filter(F.col("hit")).drop("hit"))
    if trends is not None:
        tr = validate_trend(trends, catalog).filter(F.col("status") == "fail").select(
            F.concat_ws("@", *[F.col(c).cast("string") for c in ("entity", "period")]).alias("id"),
            "metric_id", F.lit("trend").alias("rule"), F.lit("warning").alias("severity"),
            F.col("trend").alias("observed"), F.col("declared").alias("expected"))
        out = out.unionByName(tr)
    return out


# --- vector and batch checks -------------------------------------------------------------

def norm_col(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x))


def vector_validate(vectors: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """FLT-4: width, NULL, NaN and infinite elements, zero norm -> status and reason. Elements are judged as
    the single-precision numbers that are stored, so one beyond their range is infinite."""
    v = F.col(vec_col).cast("array<float>")
    reason = (F.when(v.isNull(), "null vector")
              .when(F.size(v) != dim, "wrong width")
              .when(F.exists(v, lambda x: x.isNull()), "null element")
              .when(F.exists(v, lambda x: F.isnan(x)), "nan element")
              .when(F.exists(v, lambda x: F.abs(x) == float("inf")), "infinite element")
              .when(norm_col(v) == 0, "zero norm"))
    return vectors.select("*", F.size(v).alias("n_dims"), reason.alias("reason")) \
        .withColumn("status", F.when(F.col("reason").isNull(), "valid").otherwise("rejected"))


def batch_alignment(texts: DataFrame, vectors: DataFrame, key_cols) -> DataFrame:
    """FLT-5: full outer join on the key; one-sided keys are reported."""
    keys = list(key_cols)
    t = texts.select(*keys, F.lit(True).alias("_t"))
    v = vectors.select(*keys, F.lit(True).alias("_v"))
    j = t.join(v, keys, "full_outer")
    return j.select(
        *keys,
        F.coalesce("_t", F.lit(False)).cast("int").alias("has_text"),
        F.coalesce("_v", F.lit(False)).cast("int").alias("has_vector"),
        F.when(F.col("_t").isNotNull() & F.col("_v").isNotNull(), "aligned")
        .when(F.col("_t").isNotNull(), "text_only").otherwise("vector_only").alias("status"))
