"""Metric catalogue.

The catalogue is a handful of rows read on the driver (YAML or the built-in
default) and carried into plans as a literal array of structs: fan-out over
documents is then a per-row ``inline`` (a Generate node), not a join, and its
size is fixed by the catalogue, not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Metric:
    category: str
    metric_id: str
    name: str
    code: str
    unit: str
    type: str
    possible_sources: tuple[str, ...]
    vmin: float | None = None
    vmax: float | None = None
    recommended_min: float | None = None
    trend: str | None = None
    aliases: tuple[str, ...] = field(default_factory=tuple)

    @property
    def keywords(self) -> tuple[str, ...]:
        out = [self.name]
        out += [a for a in self.aliases if a not in out]
        return tuple(out)


# --- Fixed values: the ESG metric catalogue ---------------------------------
# Six rows, in catalogue order: category, metric_id, name, code, unit, type,
# possible sources, validation (min, max, recommended_min, trend).
# Aliases are ours (documents write the shorter names).
ESG_CATALOG: tuple[Metric, ...] = (
    Metric("environmental", "greenhouse_gas", "溫室氣體排放量", "E1.1", "公噸CO2e", "numerical",
           ("table", "text", "chart"), vmin=0.0, trend="decreasing"),
    Metric("environmental", "water_usage", "用水量", "E2.1", "立方米", "numerical",
           ("table", "text"), vmin=0.0),
    Metric("social", "employee_training", "員工全年平均學習時數", "S1.1", "小時", "numerical",
           ("table", "text"), vmin=0.0, recommended_min=12.0, aliases=("員工培訓時數",)),
    Metric("social", "compensation", "整體薪酬在業界水準", "S2.1", "百分比", "percentage",
           ("table", "chart"), vmin=0.0, vmax=100.0, recommended_min=50.0, aliases=("整體薪酬水準",)),
    Metric("governance", "board_diversity", "董事會多元化程度", "G1.1", "百分比", "percentage",
           ("table", "text"), vmin=0.0, vmax=100.0, recommended_min=30.0),
    Metric("governance", "risk_management", "風險管理覆蓋率", "G2.1", "百分比", "percentage",
           ("table", "text"), vmin=0.0, vmax=100.0, recommended_min=90.0),
)

# Category labels used by the report (English key -> label shown to readers).
CATEGORY_LABELS = {"environmental": "環境", "social": "社會", "governance": "治理"}

# One stand-in metric for the invented European-language corpus (ours): license
# versions are the one kind of figure those documents state in words.
CORPUS_CATALOG: tuple[Metric, ...] = (
    Metric("governance", "license_version", "license version", "X1.1", "", "numerical",
           ("text",), vmin=0.0, aliases=("version", "by-nc")),
)
# -----------------------------------------------------------------------------

CATALOG_SCHEMA = T.StructType([
    T.StructField("cat_ord", T.IntegerType()),
    T.StructField("metric_ord", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("metric_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("code", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("possible_sources", T.ArrayType(T.StringType())),
    T.StructField("validation", T.StructType([
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("recommended_min", T.DoubleType()),
        T.StructField("trend", T.StringType()),
    ])),
])


def load_catalog(path: str) -> tuple[Metric, ...]:
    """Read a YAML catalogue: category -> metric_id -> attributes.

    Raises on a missing or malformed file: an empty catalogue would hide the
    error and silently produce no results.
    """
    import yaml

    with open(path, encoding="utf-8") as fh:
        raw = yaml.safe_load(fh)
    if not isinstance(raw, dict) or not raw:
        raise ValueError(f"catalogue {path!r} is empty or not a mapping")
    out = []
    for category, metrics in raw.items():
        if not isinstance(metrics, dict):
            raise ValueError(f"category {category!r} is not a mapping")
        for metric_id, info in metrics.items():
            v = info.get("validation") or {}
            out.append(Metric(
                category=str(category), metric_id=str(metric_id), name=str(info["name"]),
                code=str(info.get("code", "")), unit=str(info.get("unit", "")),
                type=str(info.get("type", "")),
                possible_sources=tuple(info.get("possible_sources") or ()),
                vmin=_opt_float(v.get("min")), vmax=_opt_float(v.get("max")),
                recommended_min=_opt_float(v.get("recommended_min")),
                trend=v.get("trend"), aliases=tuple(info.get("aliases") or ()),
            ))
    return tuple(out)


def _opt_float(x):
    return None if x is None else float(x)


def _ordinals(catalog):
    cats: dict[str, int] = {}
    rows = []
    per_cat: dict[str, int] = {}
    for m in catalog:
        c = cats.setdefault(m.category, len(cats) + 1)
        per_cat[m.category] = per_cat.get(m.category, 0) + 1
        rows.append((c, per_cat[m.category], m))
    return rows


def catalog_rows(catalog=ESG_CATALOG) -> list[tuple]:
    return [
        (c, o, m.category, m.metric_id, m.name, list(m.aliases), m.code, m.unit, m.type,
         list(m.possible_sources), (m.vmin, m.vmax, m.recommended_min, m.trend))
        for c, o, m in _ordinals(catalog)
    ]


def catalog_df(spark: SparkSession, catalog=ESG_CATALOG) -> DataFrame:
    """The catalogue as a DataFrame (SRC-4); tiny, so safe to broadcast."""
    return spark.createDataFrame(catalog_rows(catalog), CATALOG_SCHEMA)


def sql_str(v: str) -> str:
    """A Spark SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_num(v) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)"


def struct_sql(cat_ord: int, metric_ord: int, m: Metric) -> str:
    """One catalogue row as a Spark SQL ``named_struct`` literal."""
    arr = lambda xs: "array(" + ", ".join(sql_str(x) for x in xs) + ")"
    trend = sql_str(m.trend) if m.trend else "CAST(NULL AS STRING)"
    return (f"named_struct('cat_ord', {cat_ord}, 'metric_ord', {metric_ord}, "
            f"'category', {sql_str(m.category)}, 'metric_id', {sql_str(m.metric_id)}, "
            f"'name', {sql_str(m.name)}, 'keywords', {arr(m.keywords)}, 'code', {sql_str(m.code)}, "
            f"'unit', {sql_str(m.unit)}, 'type', {sql_str(m.type)}, "
            f"'possible_sources', {arr(m.possible_sources)}, 'vmin', {_sql_num(m.vmin)}, "
            f"'vmax', {_sql_num(m.vmax)}, 'recommended_min', {_sql_num(m.recommended_min)}, "
            f"'trend', {trend})")


def catalog_array(catalog=ESG_CATALOG) -> Column:
    """Catalogue as a literal ARRAY<STRUCT>: explode it per row for a fan-out.

    Built from one SQL expression (one parse), not from hundreds of ``lit`` calls.
    """
    return F.expr("array(" + ", ".join(struct_sql(c, o, m) for c, o, m in _ordinals(catalog)) + ")")


def catalog_map_col(catalog=ESG_CATALOG) -> Column:
    """Literal MAP<metric_id, STRUCT> (folded to one constant by the optimizer)."""
    return F.expr("map(" + ", ".join(f"{sql_str(m.metric_id)}, {struct_sql(c, o, m)}"
                                     for c, o, m in _ordinals(catalog)) + ")")
