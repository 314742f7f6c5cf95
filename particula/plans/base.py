"""Query registry: every registered query pairs a Spark plan builder
(spark, sf_dir) -> DataFrame with, where SQL can express it, the DuckDB text
of the same result over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..functions.numeric import round6, round6_sql
from ..sources.readings import READINGS_SQL, readings, table


@dataclass
class Query:
    name: str
    ops: str  # SURVEY ids covered
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None, means: list[str] | None = None):
    """`means`: computed means among the columns, printed with six decimals on both sides."""
    if sql and means:
        sql = round6_sql(sql, means)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def build(spark, sf):
            return round6(fn(spark, sf), means)

        REGISTRY[name] = Query(name, ops, build if means else fn, half_up_rounding(sql) if sql else None)
        return fn

    return deco


def half_up_rounding(sql: str) -> str:
    """Rewrite `round(x, n)` so DuckDB rounds like Spark: HALF_UP on the
    shortest decimal text of the double (DuckDB's own round scales in binary,
    so 26.849999999999998 would become 26.9 there and 26.8 in Spark)."""
    out, i, n = [], 0, len(sql)
    while i < n:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            break
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        out.append(sql[i:j])
        depth, k, comma = 1, j + 6, -1
        while k < n and depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner_end = k - 1
        if comma < 0:
            out.append(sql[j:k])
        else:
            arg = half_up_rounding(sql[j + 6 : comma])
            digits = sql[comma + 1 : inner_end].strip()
            out.append(
                f"CAST(round(CAST(CAST(({arg}) AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)"
            )
        i = k
    return "".join(out)


def R(spark: SparkSession, sf: str) -> DataFrame:
    # event time is UTC throughout (the driver tables store naive UTC times)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return readings(spark, sf)


# ---------------------------------------------------------------- SQL helpers


def d(x: float) -> str:
    """Double literal (plain decimals are DECIMAL in SQL)."""
    return f"{float(x)!r}e0"


def _band_sql(v: str, lo, hi, alo, ahi) -> str:
    return f"(({v} - {d(lo)}) / ({d(hi)} - {d(lo)})) * ({d(ahi)} - {d(alo)}) + {d(alo)}"


def sub_index_sql(v: str, bands) -> str:
    parts = []
    other = None
    for upper, lo, hi, alo, ahi in bands:
        if upper is None:
            other = _band_sql(v, lo, hi, alo, ahi)
        else:
            parts.append(f"WHEN {v} <= {d(upper)} THEN {_band_sql(v, lo, hi, alo, ahi)}")
    return f"CAST(trunc(CASE {' '.join(parts)} ELSE {other} END) AS INTEGER)"


def aqi_sql(pm25: str = "pm2_5", pm10: str = "pm10") -> str:
    return (
        f"CASE WHEN {pm25} IS NULL OR {pm10} IS NULL OR isnan({pm25}) OR isnan({pm10}) THEN NULL "
        f"ELSE greatest({sub_index_sql(pm25, C.PM25_BANDS)}, {sub_index_sql(pm10, C.PM10_BANDS)}) END"
    )


def with_readings(body: str, extra_ctes: str = "") -> str:
    """Oracle text over the readings view `r` (same projection as the Spark side)."""
    more = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {READINGS_SQL},\nr AS (SELECT *, {aqi_sql()} AS aqi FROM r0){more}\n{body}"


def upper_case_sql(v: str, tiers, top: str) -> str:
    whens = " ".join(f"WHEN {v} <= {b} THEN '{lab}'" for b, lab in tiers)
    return f"CASE WHEN {v} IS NULL THEN NULL {whens} ELSE '{top}' END"


def lower_case_sql(v: str, tiers, bottom: str, null_is_bottom: bool = True) -> str:
    whens = " ".join(f"WHEN {v} >= {b} THEN '{lab}'" for b, lab in tiers)
    head = "" if null_is_bottom else f"WHEN {v} IS NULL THEN NULL "
    return f"CASE {head}{whens} ELSE '{bottom}' END"


def map_sql(v: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {v} = '{k}' THEN '{val}'" for k, val in mapping.items())
    other = "NULL" if default is None else f"'{default}'"
    return f"CASE {whens} ELSE {other} END"


def num_text_sql(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN 'null' WHEN {v} = floor({v}) AND abs({v}) < 1e15 "
        f"THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"
    )


def frame(minutes: float) -> str:
    return f"RANGE BETWEEN {int(minutes * C.MICROS_PER_MINUTE)} PRECEDING AND CURRENT ROW"


W_SENSOR = "PARTITION BY sensor_id ORDER BY epoch_us(timestamp)"
