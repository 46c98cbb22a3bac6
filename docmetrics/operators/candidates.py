"""TXT-7 metric candidates and NORM-1 value normalisation.

A candidate is a keyword followed, within one sentence, by a number and an
optional unit. Each keyword gets one literal pattern (compiled once per task),
guarded by a cheap ``instr`` test, so chunks without the keyword cost one
substring search per keyword.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------------
# Keywords searched by default (in this order).
DEFAULT_KEYWORDS = ("員工", "環境", "碳排", "能源", "培訓", "薪資", "安全", "事故")
# Units recognised after a number; the first eight are the original list, the
# rest are the catalogue's. Longer alternatives are tried first.
BASE_UNITS = ("%", "％", "萬", "億", "個", "人", "元", "小時", "分鐘")
CATALOG_UNITS = ("公噸CO2e", "立方米", "百分比")
# A number: thousands groups or plain digits, optional decimals.
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"
# Sentence stops: the ideographic full stop and the line break.
STOP_CLASS = "[^。\n]"
# Scale words and unit spellings.
SCALE = {"萬": 10_000, "億": 100_000_000}
UNIT_ALIASES = {"％": "%", "百分比": "%"}
# -----------------------------------------------------------------------------------

# --- the value grammar: sign or brackets, number, range end, scale word, unit -----------------
# One grammar for candidates in running text and for values that stand alone. Brackets around a number, closed right
# after it, or a dash right before it mean a negative value; in running text the dash must not follow a letter, a digit
# or another dash (``CC-BY-4.0``, ``2023-24`` and ``---`` hold no sign). A range counts with its lower end.

def _quantity(number: str) -> str:
    """Groups: sign inside brackets, bracketed number, plain number, upper end of a range, scale word."""
    return (rf"(?:[(（][ \t]*([-−－+]?)[ \t]*({number})[ \t]*[)）]|({number}))"
            rf"(?:[ \t]*[~～〜–至][ \t]*({number}))?[ \t]*({'|'.join(SCALE)})?")


# A dash before a plain number, at the end of the text between keyword and number.
_DASH = r"[^\p{L}\p{N}\-−－][-−－]$"


def unit_alternation(units=BASE_UNITS + CATALOG_UNITS) -> str:
    """Units, longest first; scale words are no units."""
    ordered = sorted((u for u in dict.fromkeys(units) if u not in SCALE), key=lambda u: -len(u))
    return "|".join(re.escape(u) for u in ordered)


def candidate_pattern(keyword: str, units: str, max_gap: int | None = None,
                      ignore_case: bool = False) -> str:
    gap = f"{STOP_CLASS}*?" if max_gap is None else f"{STOP_CLASS}{{0,{max_gap}}}?"
    kw = f"(?i:{re.escape(keyword)})" if ignore_case else re.escape(keyword)
    return f"{kw}{gap}{_quantity(NUMBER)}[ \t]*(?:{units})?"


def metric_candidates(chunks: DataFrame, keywords=DEFAULT_KEYWORDS,
                      key_cols=("document_id", "chunk_index"), text_col: str = "text",
                      units=BASE_UNITS + CATALOG_UNITS, ignore_case: bool = False,
                      max_gap: int | None = None, keep_cols=()) -> DataFrame:
    """(keys, keyword, ordinal INT, context, gap INT, value_raw, negative, high_raw, scale, unit).

    Matches of one keyword do not overlap; ``ordinal`` numbers them from 0 in text order. ``value_raw`` is the number
    as written, without sign; ``high_raw`` the upper end of a range, ``scale`` the scale word and ``unit`` the unit,
    NULL where there is none. ``gap`` counts the characters between keyword and value (its sign and brackets are
    the value's). ``ignore_case`` matches the keywords without regard to (ASCII) case; units match as written, and
    the context keeps the text as written.
    """
    keys = list(key_cols)
    ualt = unit_alternation(units)
    text = F.col("_t")
    probe = F.lower(text) if ignore_case else text
    per_kw = []
    for kw in dict.fromkeys(keywords):
        pat = candidate_pattern(kw, ualt, max_gap, ignore_case)
        needle = kw.lower() if ignore_case else kw
        per_kw.append(F.struct(
            F.lit(kw).alias("keyword"),
            F.when(F.col("_d") & (F.instr(probe, needle) > 0),
                   F.regexp_extract_all(text, F.lit(pat), 0))
            .otherwise(F.array().cast("array<string>")).alias("ctx")))
    # Every match holds a digit: chunks without one skip the (backtracking)
    # pattern scans. This is a condition, not a filter, so it is not pushed
    # below the chunk exchange (other readers of the exchange can reuse it).
    src = chunks.select(*keys, *keep_cols, F.col(text_col).alias("_t"),
                        F.col(text_col).rlike("[0-9]").alias("_d"))
    found = src.select(*keys, *keep_cols, F.inline(F.array(*per_kw)))
    found = found.select(*keys, *keep_cols, "keyword",
                         F.posexplode("ctx").alias("ordinal", "context"))
    # Re-split each match (anchored, same pattern shape) into its parts.
    rest = F.substring(F.col("context"), F.length("keyword") + 1, 1 << 30)
    parts = f"^({STOP_CLASS}*?){_quantity(NUMBER)}[ \t]*({ualt})?$"
    part = lambda i: F.regexp_extract(rest, parts, i)
    dash = (part(3) == "") & part(1).rlike(_DASH)
    given = lambda i: F.nullif(part(i), F.lit(""))
    return found.select(
        *keys, *keep_cols, "keyword", "ordinal", "context",
        (F.length(part(1)) - dash.cast("int")).alias("gap"),
        F.concat(part(3), part(4)).alias("value_raw"),
        (dash | ((part(3) != "") & (part(2) != "+"))).alias("negative"),
        given(5).alias("high_raw"), given(6).alias("scale"), given(7).alias("unit"),
    )


def normalized_unit(unit: Column) -> Column:
    out = unit
    for k, v in UNIT_ALIASES.items():
        out = F.when(unit == k, F.lit(v)).otherwise(out)
    return out


def normalized_value(value_raw: Column, scale: Column, negative: Column) -> Column:
    """NORM-1: DECIMAL(38,6) of a number as written: separators dropped, scale word and sign applied; text that is no
    number, or too large, gives NULL."""
    v = F.regexp_replace(value_raw, ",", "").try_cast("decimal(38,6)")
    factor = F.lit(1)
    for k, m in SCALE.items():
        factor = F.when(scale == k, F.lit(int(m))).otherwise(factor)
    signed = F.when(negative, F.negate(factor)).otherwise(factor)
    return F.try_multiply(v, signed.cast("decimal(10,0)")).try_cast("decimal(38,6)")


def value_normalize(cands: DataFrame) -> DataFrame:
    """NORM-1 on candidate rows: adds ``value`` and ``value_high`` (of a range) DECIMAL(38,6) and ``unit_norm``."""
    value = lambda raw: normalized_value(F.col(raw), F.col("scale"), F.col("negative"))
    return cands.withColumns({"value": value("value_raw"), "value_high": value("high_raw"), "unit_norm": normalized_unit(F.col("unit"))})


# about-sign, sign, quantity (a bare fraction counts too), unit
_VALUE_WITH_UNIT = rf"^[ \t]*約?[ \t]*([-−－+]?)[ \t]*{_quantity(NUMBER + '|[0-9]*[.][0-9]+')}[ \t]*(.*?)[ \t]*$"


def split_value_unit(raw: Column) -> tuple[Column, Column]:
    """Value that stands alone -> (DECIMAL(38,6), normalised unit): '12,345 公噸CO2e', '-20%', '(5) 小時' (negative),
    '1.2萬公噸CO2e' (the scale word is read apart from the unit), '12~15 立方米' (12)."""
    part = lambda i: F.regexp_extract(raw, _VALUE_WITH_UNIT, i)
    negative = part(1).isin("-", "−", "－") | ((part(3) != "") & (part(2) != "+"))
    value = normalized_value(F.nullif(F.concat(part(3), part(4)), F.lit("")), part(6), negative)
    return value, normalized_unit(F.nullif(part(7), F.lit("")))
