"""Text, id, number-coercion and time helpers as Column expressions
(F11, F12, F15-F21, P2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ._util import as_col

# Leading decimal number of a text (what a lenient number parser accepts).
LEADING_NUMBER = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def sensor_type(sensor_id, area_type=None) -> Column:
    """sensor type by id substring (or area type for the first three), first match wins."""
    sid = F.lower(as_col(sensor_id))
    area = F.lower(F.coalesce(as_col(area_type), F.lit(""))) if area_type is not None else None
    expr = None
    for sub, on_area, typ, _ in C.SENSOR_TYPES:
        cond = sid.contains(sub)
        if on_area and area is not None:
            cond = cond | area.contains(sub)
        expr = F.when(cond, typ) if expr is None else expr.when(cond, typ)
    return expr.otherwise(C.UNKNOWN)


def canonical_location(sensor_id, area_type=None, location_name=None) -> Column:
    """canonical place for the matched type; else the stored name or 'Unknown'."""
    sid = F.lower(as_col(sensor_id))
    area = F.lower(F.coalesce(as_col(area_type), F.lit(""))) if area_type is not None else None
    fallback = (
        F.coalesce(F.nullif(as_col(location_name), F.lit("")), F.lit(C.UNKNOWN))
        if location_name is not None
        else F.lit(C.UNKNOWN)
    )
    expr = None
    for sub, on_area, _, place in C.SENSOR_TYPES:
        cond = sid.contains(sub)
        if on_area and area is not None:
            cond = cond | area.contains(sub)
        expr = F.when(cond, place) if expr is None else expr.when(cond, place)
    return expr.otherwise(fallback)


def image_path(stype) -> Column:
    """F12."""
    return F.concat(F.lit(C.IMAGE_PATH_PREFIX), F.lower(as_col(stype)), F.lit(C.IMAGE_PATH_SUFFIX))


def city_token(city, sensor_id) -> Column:
    """city, else the 2nd '-' token of the id, else 'Unknown' (empty counts as missing)."""
    tok = F.try_element_at(F.split(as_col(sensor_id), "-"), F.lit(2))
    return F.coalesce(F.nullif(as_col(city), F.lit("")), F.nullif(tok, F.lit("")), F.lit(C.UNKNOWN))


def ratio_score(x, avg) -> Column:
    """F16: abs(x - avg) / avg; NULL when avg is 0 or NULL (no ANSI error)."""
    x, avg = as_col(x), as_col(avg)
    return F.try_divide(F.abs(x - avg), avg)


def text_to_number(s) -> Column:
    """leading number of a text, like a lenient float parser; NULL if none."""
    num = F.regexp_extract(as_col(s).cast("string"), LEADING_NUMBER, 1)
    return F.when(num != "", num).try_cast("double")


def lenient_int(s) -> Column:
    """Integer from text only when the text is an integer ('12.7' -> NULL)."""
    s = F.trim(as_col(s).cast("string"))
    return F.when(s.rlike(INTEGER_TEXT), s).try_cast("int")


def lenient_double(s) -> Column:
    """Double from text; non-numeric -> NULL."""
    return F.trim(as_col(s).cast("string")).try_cast("double")


def json_point(x, y) -> Column:
    """{x, y} object to JSON text."""
    return F.to_json(F.struct(as_col(x).alias("x"), as_col(y).alias("y")))


def legacy_alert_id(ts, sensor_id) -> Column:
    """alert_<epoch seconds of the event>_<sensor>, deterministic on replay."""
    return F.concat(
        F.lit("alert_"), F.unix_seconds(as_col(ts)).cast("string"), F.lit("_"), as_col(sensor_id)
    )


def hashed_id(*parts) -> Column:
    """content hash instead of a random uuid, so re-processing is idempotent."""
    return F.sha2(F.concat_ws(",", *[as_col(p).cast("string") for p in parts]), 256)


def iso_utc(ts) -> Column:
    """ISO-8601 text with milliseconds and a Z suffix."""
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_timestamp(text, default_now: bool = True) -> Column:
    """ISO text (with Z or offset) to timestamp; unparseable/missing -> now (or NULL)."""
    t = as_col(text)
    parsed = F.coalesce(
        F.try_to_timestamp(t),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]X")),
    )
    return F.coalesce(parsed, F.current_timestamp()) if default_now else parsed


def time_band(ts) -> Column:
    """rush (7-9, 17-19), night (>=22 or <=6) or regular, by hour of the event."""
    h = F.hour(as_col(ts))
    rush = None
    for lo, hi in C.RUSH_HOURS:
        c = (h >= lo) & (h <= hi)
        rush = c if rush is None else rush | c
    return F.when(rush, "rush").when((h >= C.NIGHT_FROM) | (h <= C.NIGHT_TO), "night").otherwise("regular")


def is_weekend(ts) -> Column:
    """Saturday or Sunday (weekday() is 0 for Monday)."""
    return F.weekday(as_col(ts)) >= 5
