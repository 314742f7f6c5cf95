"""Data-quality operators (P3-P11): validity flags, error lists, filters.

Every rule is a Boolean Column expression, so a filter on it is a plain
`Filter` node that Catalyst merges with neighbours and pushes into the scan
where it touches raw columns.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions._util import as_col
from ..sources.readings import PARSED


def fence(df: DataFrame, cols=("aqi",)) -> DataFrame:
    """Evaluate the given derived columns once per row before a filter on them.

    To push a filter below a projection Catalyst substitutes the column
    definitions into the condition, so a rule that names `aqi` three times
    evaluates the AQI chain three times per row. A one-row `inline` generator is
    a boundary filters on its outputs are not pushed through. Rules on other
    columns come before it (see `staged`), so they reach the scan.
    """
    inner = [c for c in cols if c in df.columns]
    if not inner:
        return df
    rest = [c for c in df.columns if c not in inner]
    out = df.select(*rest, F.inline(F.array(F.struct(*[F.col(c) for c in inner]))))
    return out.select(*df.columns)


def staged(df: DataFrame, before: Column, after: Column | None = None, cols=("aqi",)) -> DataFrame:
    """Filter by the rules on measured columns, then by those on the derived ones (`cols`), evaluated once.

    On a stored table the first rules reach the scan. Where the measured columns are themselves computed from
    parsed text (their metadata says so), they are evaluated once behind the fence, and so is the text.
    """
    parsed = [f.name for f in df.schema if f.metadata.get(PARSED)]
    out = fence(df, (*parsed, *cols)).filter(before) if parsed else fence(df.filter(before), cols)
    return out if after is None else out.filter(after)


def _rules(pm25="pm2_5", pm10="pm10", aqi="aqi", temp="temperature", hum="humidity") -> dict[str, Column]:
    p25, p10, a, t, h = (as_col(x) for x in (pm25, pm10, aqi, temp, hum))
    return {
        "pm25_null": p25.isNull(),
        "pm10_null": p10.isNull(),
        "aqi_null": a.isNull(),
        "pm25_neg": p25 < C.PM_MIN,
        "pm10_neg": p10 < C.PM_MIN,
        "aqi_neg": a < C.AQI_MIN,
        "aqi_high": a > C.AQI_MAX,
        "temp_null": t.isNull(),
        "hum_null": h.isNull(),
        "temp_low": t < C.TEMP_MIN,
        "temp_high": t > C.TEMP_MAX,
        "hum_neg": h < C.HUM_MIN,
        "hum_high": h > C.HUM_MAX,
    }


def _none_broken(rules: dict[str, Column]) -> Column:
    ok = None
    for c in rules.values():
        c = F.coalesce(~c, F.lit(False))
        ok = c if ok is None else ok & c
    return ok


def is_valid(**cols) -> Column:
    """All fields present and in range. Never NULL: NULL input gives FALSE."""
    return _none_broken(_rules(**cols))


def validation_errors(**cols) -> Column:
    """Broken rules in fixed order joined by ', '; '' when valid."""
    r = _rules(**cols)
    parts = [F.when(r[rid], F.lit(msg)) for rid, msg in C.VALIDATION_MESSAGES]
    return F.concat_ws(", ", *parts)


def validate(df: DataFrame, **cols) -> DataFrame:
    """P3 + P4 as columns."""
    return df.withColumn("is_valid", is_valid(**cols)).withColumn(
        "validation_errors", F.when(~F.col("is_valid"), validation_errors(**cols)).otherwise(F.lit(""))
    )


def outlier_ok(pm25="pm2_5", pm10="pm10", temp="temperature", hum="humidity") -> Column:
    p25, p10, t, h = (as_col(x) for x in (pm25, pm10, temp, hum))
    return (
        (p25 <= C.OUTLIER_PM25_MAX)
        & (p10 <= C.OUTLIER_PM10_MAX)
        & (t >= C.OUTLIER_TEMP_MIN)
        & (t <= C.OUTLIER_TEMP_MAX)
        & (h >= C.OUTLIER_HUM_MIN)
        & (h <= C.OUTLIER_HUM_MAX)
    )


def quality_filter(df: DataFrame, **cols) -> DataFrame:
    """P5: keep valid rows, then drop extreme outliers."""
    oc = {k: v for k, v in cols.items() if k != "aqi"}
    derived = {k: r for k, r in _rules(**cols).items() if k.startswith("aqi")}
    measured = {k: r for k, r in _rules(**cols).items() if k not in derived}
    return staged(df, _none_broken(measured) & outlier_ok(**oc), _none_broken(derived))


def flat_filter(df: DataFrame) -> DataFrame:
    """P6 as a frame operation."""
    p25, p10, a = F.col("pm2_5"), F.col("pm10"), F.col("aqi")
    before = p25.isNotNull() & p10.isNotNull() & (p25 >= C.PM_MIN) & (p10 >= C.PM_MIN)
    return staged(df, before, a.isNotNull() & (a >= C.AQI_MIN) & (a <= C.AQI_MAX))


def first_error_filter(df: DataFrame) -> DataFrame:
    """P7 valid rows as a frame operation."""
    p25, p10, a = F.col("pm2_5"), F.col("pm10"), F.col("aqi")
    before = (p25 >= 0) & (p25 <= C.FIRST_ERROR_PM25_MAX) & (p10 >= 0) & (p10 <= C.FIRST_ERROR_PM10_MAX)
    for f in C.FIRST_ERROR_REQUIRED:
        if f != "aqi":
            before = F.col(f).isNotNull() & before
    return staged(df, before, (a >= C.AQI_MIN) & (a <= C.AQI_MAX))


def flat_valid(pm25="pm2_5", pm10="pm10", aqi="aqi") -> Column:
    """PM/AQI present, non-negative, aqi <= 500 (no weather rules)."""
    p25, p10, a = as_col(pm25), as_col(pm10), as_col(aqi)
    return (
        p25.isNotNull()
        & p10.isNotNull()
        & a.isNotNull()
        & (p25 >= C.PM_MIN)
        & (p10 >= C.PM_MIN)
        & (a >= C.AQI_MIN)
        & (a <= C.AQI_MAX)
    )


def _num_text(c: Column) -> Column:
    # Numbers in messages: the engine's plain text of the value.
    return c.cast("string")


def first_error(df: DataFrame) -> Column:
    """First failing check as (is_valid, reason)."""
    expr = None
    for f in C.FIRST_ERROR_REQUIRED:
        cond = F.col(f).isNull()
        msg = F.lit(f"Missing field: {f}")
        expr = F.when(cond, msg) if expr is None else expr.when(cond, msg)
    p25, p10, a = F.col("pm2_5"), F.col("pm10"), F.col("aqi")
    expr = (
        expr.when(~((p25 >= 0) & (p25 <= C.FIRST_ERROR_PM25_MAX)), F.concat(F.lit("Invalid PM2.5: "), _num_text(p25)))
        .when(~((p10 >= 0) & (p10 <= C.FIRST_ERROR_PM10_MAX)), F.concat(F.lit("Invalid PM10: "), _num_text(p10)))
        .when(~((a >= C.AQI_MIN) & (a <= C.AQI_MAX)), F.concat(F.lit("Invalid AQI: "), _num_text(a)))
        .otherwise(F.lit(C.FIRST_ERROR_VALID))
    )
    return F.struct((expr == C.FIRST_ERROR_VALID).alias("is_valid"), expr.alias("reason"))


def first_error_ok() -> Column:
    """P7 as a plain predicate (no message text built): the row would be 'Valid'."""
    ok = None
    for f in C.FIRST_ERROR_REQUIRED:
        c = F.col(f).isNotNull()
        ok = c if ok is None else ok & c
    p25, p10, a = F.col("pm2_5"), F.col("pm10"), F.col("aqi")
    return (
        ok
        & (p25 >= 0)
        & (p25 <= C.FIRST_ERROR_PM25_MAX)
        & (p10 >= 0)
        & (p10 <= C.FIRST_ERROR_PM10_MAX)
        & (a >= C.AQI_MIN)
        & (a <= C.AQI_MAX)
    )


def split_valid(df: DataFrame):
    """(valid frame, quarantine frame with reason). Both read the same plan."""
    checked = df.withColumn("_check", first_error(df))
    valid = checked.filter("_check.is_valid").drop("_check")
    quarantine = checked.filter(~F.col("_check.is_valid")).select("*", F.col("_check.reason").alias("reason")).drop(
        "_check"
    )
    return valid, quarantine


def lookback(df: DataFrame, hours: float, sensor_id: str | None = None, as_of=None, ts: str = "timestamp") -> DataFrame:
    """`sensor_id = s AND ts >= as_of - hours`.

    `as_of` is "now" of the request; it defaults to the newest timestamp of the
    input so results are deterministic. That single value is fetched first
    and used as a literal, so the cutoff reaches the Parquet scan (row-group
    skipping) and, on a date-partitioned table, prunes partitions.
    """
    micros = F.unix_micros(F.col(ts))
    if as_of is None:
        newest = df.select(F.max(micros)).first()[0]
    else:
        newest = _epoch_micros(as_of)
    if newest is None:  # empty input
        return df.filter(F.lit(False))
    cutoff = newest - round(float(hours) * 3600 * 1_000_000)
    out = df
    if sensor_id is not None:
        out = out.filter(F.col("sensor_id") == sensor_id)
    out = out.filter(F.col(ts) >= F.timestamp_micros(F.lit(cutoff)).cast(df.schema[ts].dataType))
    if "date" in df.columns:
        out = out.filter(F.col("date") >= F.to_date(F.timestamp_micros(F.lit(cutoff))))
    return out


def _epoch_micros(at: str | _dt.datetime) -> int:
    """A moment as microseconds of UTC; one without an offset is UTC, whatever the driver's zone."""
    if isinstance(at, str):
        at = _dt.datetime.fromisoformat(at.replace("Z", "+00:00"))
    if at.tzinfo is None:
        at = at.replace(tzinfo=_dt.timezone.utc)
    return (at - _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)) // _dt.timedelta(microseconds=1)


def active(df: DataFrame) -> DataFrame:
    """is_active = true; NULL is not active."""
    return df.filter(F.col("is_active") == F.lit(True))


def numeric_aqi(c) -> Column:
    """P10: lenient AQI where 0, '', 'Unknown' and non-numbers count as missing."""
    from ..functions.text import text_to_number

    v = text_to_number(as_col(c))
    return F.when(v != 0, v)


def with_defaults(df: DataFrame) -> DataFrame:
    """P11: 'Unknown' for missing/empty place and type, 0 for missing PM, 'Unknown' aqi text."""
    out = df
    for c in ("location_name", "area_type"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(C.UNKNOWN)))
    for c in ("pm2_5", "pm10"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    if "aqi" in df.columns:
        out = out.withColumn("aqi_text", F.coalesce(F.col("aqi").cast("string"), F.lit(C.UNKNOWN)))
    return out
