"""AQI scoring and classification as native Column expressions.

All of these compile into whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ._util import as_col


def _band_value(v: Column, lo: float, hi: float, alo: float, ahi: float) -> Column:
    # ((v - lo) / (hi - lo)) * (ahi - alo) + alo, in the same operation order
    # as the reproduced formula so results are bit-identical.
    return ((v - F.lit(lo)) / (F.lit(hi) - F.lit(lo))) * (F.lit(ahi) - F.lit(alo)) + F.lit(alo)


def _sub_index(v: Column, bands) -> Column:
    expr = None
    for upper, lo, hi, alo, ahi in bands:
        val = _band_value(v, lo, hi, alo, ahi)
        if upper is None:
            expr = expr.otherwise(val)
        else:
            cond = v <= F.lit(upper)
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    # truncation toward zero, like int() on a float
    return expr.cast("int")


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _sub_index_sql(v: str, bands) -> str:
    whens, other = [], None
    for upper, lo, hi, alo, ahi in bands:
        val = f"((({v} - {_d(lo)}) / ({_d(hi)} - {_d(lo)})) * ({_d(ahi)} - {_d(alo)}) + {_d(alo)})"
        if upper is None:
            other = val
        else:
            whens.append(f"WHEN {v} <= {_d(upper)} THEN {val}")
    return f"CAST(CASE {' '.join(whens)} ELSE {other} END AS INT)"


def aqi_score_sql(pm25: str = "pm2_5", pm10: str = "pm10") -> str:
    """F1 as Spark SQL text (same operation order as the Column form)."""
    a, b = f"`{pm25}`", f"`{pm10}`"
    return (
        f"CAST(CASE WHEN {a} IS NULL OR {b} IS NULL OR isnan({a}) OR isnan({b}) THEN NULL "
        f"ELSE greatest({_sub_index_sql(a, C.PM25_BANDS)}, {_sub_index_sql(b, C.PM10_BANDS)}) END AS INT)"
    )


def aqi_score(pm25, pm10) -> Column:
    """F1: greatest of the PM2.5 and PM10 sub-indices; NULL/NaN input -> NULL."""
    if isinstance(pm25, str) and isinstance(pm10, str):
        # one parsed expression instead of ~170 client-side Column calls
        return F.expr(aqi_score_sql(pm25, pm10))
    pm25, pm10 = as_col(pm25), as_col(pm10)
    bad = pm25.isNull() | pm10.isNull() | F.isnan(pm25) | F.isnan(pm10)
    return F.when(~bad, F.greatest(_sub_index(pm25, C.PM25_BANDS), _sub_index(pm10, C.PM10_BANDS))).cast(
        "int"
    )


def _upper_inclusive(v: Column, tiers, top: str) -> Column:
    expr = None
    for bound, label in tiers:
        expr = F.when(v <= bound, label) if expr is None else expr.when(v <= bound, label)
    return expr.otherwise(top)


def _lower_inclusive(v: Column, tiers, bottom: str) -> Column:
    expr = None
    for bound, label in tiers:
        expr = F.when(v >= bound, label) if expr is None else expr.when(v >= bound, label)
    return expr.otherwise(bottom)


def aqi_category(aqi) -> Column:
    """upper-inclusive category; NULL aqi -> NULL."""
    aqi = as_col(aqi)
    return F.when(aqi.isNotNull(), _upper_inclusive(aqi, C.AQI_CATEGORIES, C.AQI_CATEGORY_TOP))


def health_message(category) -> Column:
    """health message of a category label (NULL when the label is unknown)."""
    m = F.create_map(*[x for kv in C.HEALTH_MESSAGES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.try_element_at(m, as_col(category))


def alert_level(aqi, tiers: int = 6) -> Column:
    """F4 (6 tiers) / F5 (5 tiers, no Hazardous): lower-inclusive; NULL aqi -> 'Good'."""
    levels = C.ALERT_LEVELS_6 if tiers == 6 else C.ALERT_LEVELS_5
    return _lower_inclusive(as_col(aqi), levels, C.ALERT_LEVEL_BOTTOM)


def alert_message(aqi) -> Column:
    """alert text, no tier at 50; NULL aqi -> the 'Good' text."""
    return _lower_inclusive(as_col(aqi), C.ALERT_MESSAGES, C.ALERT_MESSAGE_BOTTOM)


def has_alert(aqi) -> Column:
    """aqi >= 100, three-valued (NULL stays NULL)."""
    return as_col(aqi) >= F.lit(C.HAS_ALERT_AQI)


def health_risk_level(aqi) -> Column:
    """F8."""
    return _lower_inclusive(as_col(aqi), C.HEALTH_RISK_LEVELS, C.HEALTH_RISK_BOTTOM)


def joint_label(pm25, pm10) -> Column:
    """first tier where both concentrations are within the bounds."""
    pm25, pm10 = as_col(pm25), as_col(pm10)
    expr = None
    for a, b, label in C.JOINT_LABELS:
        cond = (pm25 <= a) & (pm10 <= b)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return F.when(pm25.isNotNull() & pm10.isNotNull(), expr.otherwise(C.JOINT_LABEL_TOP))


def risk_word(label) -> Column:
    """risk word of a label, unknown/NULL label -> 'Unknown'."""
    m = F.create_map(*[x for kv in C.RISK_WORDS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, as_col(label)), F.lit(C.UNKNOWN))


def aqi_class(aqi, ways: int = 6) -> Column:
    """colour class, 6-way or 4-way, upper-inclusive."""
    aqi = as_col(aqi)
    if ways == 6:
        body = _upper_inclusive(aqi, C.AQI_CLASSES_6, C.AQI_CLASS_6_TOP)
    else:
        body = _upper_inclusive(aqi, C.AQI_CLASSES_4, C.AQI_CLASS_4_TOP)
    return F.when(aqi.isNotNull(), body)


def battery_band(battery) -> Column:
    """lower-inclusive battery band."""
    b = as_col(battery)
    return F.when(b.isNotNull(), _lower_inclusive(b, C.BATTERY_BANDS, C.BATTERY_BAND_BOTTOM))
