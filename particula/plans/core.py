"""Step 1: parsing, scalar scoring/classification, data quality, per-sensor analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import aqi as FA
from ..operators import quality as Q
from ..operators import stats as ST
from ..sources import parse as PS
from ..functions.numeric import round_mean_sql
from .base import (
    R,
    lower_case_sql,
    map_sql,
    register,
    upper_case_sql,
    with_readings,
)

READING_COLS = [
    "event_id",
    "sensor_id",
    "timestamp",
    "area_type",
    "pm2_5",
    "pm10",
    "aqi",
    "temperature",
    "humidity",
    "battery_level",
    "signal_strength",
]
RC = ", ".join(READING_COLS)


@register(
    "flatten_project",
    "S4 S11 P1",
    with_readings(f"SELECT {RC}, '{C.PROCESSING_VERSION}' AS processing_version FROM r"),
)
def flatten_project(spark, sf):
    r = R(spark, sf)
    wire = r.select("event_id", PS.to_nested_json(r).alias("value"))
    nested = PS.parse_nested(wire, keep=("event_id",))
    flat = PS.flatten_nested(nested)
    return flat.select(*READING_COLS, "processing_version")


@register(
    "parse_ts",
    "P2",
    with_readings(
        "SELECT event_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_text, timestamp AS parsed FROM r"
    ),
)
def parse_ts(spark, sf):
    from ..functions.text import parse_timestamp

    r = R(spark, sf)
    txt = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return r.select("event_id", txt.alias("ts_text")).withColumn("parsed", parse_timestamp(F.col("ts_text")))


@register(
    "column_scan",
    "S13",
    with_readings("SELECT sensor_id, timestamp, pm2_5, pm10, aqi, temperature, humidity FROM r"),
)
def column_scan(spark, sf):
    return R(spark, sf).select("sensor_id", "timestamp", "pm2_5", "pm10", "aqi", "temperature", "humidity")


@register("aqi_score", "F1", with_readings("SELECT event_id, sensor_id, pm2_5, pm10, aqi FROM r"))
def aqi_score(spark, sf):
    return R(spark, sf).select("event_id", "sensor_id", "pm2_5", "pm10", "aqi")


@register(
    "aqi_category",
    "F2",
    with_readings(
        f"SELECT event_id, aqi, {upper_case_sql('aqi', C.AQI_CATEGORIES, C.AQI_CATEGORY_TOP)} AS aqi_category FROM r"
    ),
)
def aqi_category(spark, sf):
    return R(spark, sf).select("event_id", "aqi", FA.aqi_category("aqi").alias("aqi_category"))


@register(
    "health_message",
    "F3",
    with_readings(
        f"SELECT event_id, aqi_category, {map_sql('aqi_category', C.HEALTH_MESSAGES)} AS health_message FROM "
        f"(SELECT event_id, {upper_case_sql('aqi', C.AQI_CATEGORIES, C.AQI_CATEGORY_TOP)} AS aqi_category FROM r)"
    ),
)
def health_message(spark, sf):
    r = R(spark, sf).select("event_id", FA.aqi_category("aqi").alias("aqi_category"))
    return r.select("event_id", "aqi_category", FA.health_message("aqi_category").alias("health_message"))


@register("has_alert", "F7", with_readings(f"SELECT event_id, aqi, aqi >= {C.HAS_ALERT_AQI} AS has_alert FROM r"))
def has_alert(spark, sf):
    return R(spark, sf).select("event_id", "aqi", FA.has_alert("aqi").alias("has_alert"))


def _joint_sql():
    whens = " ".join(f"WHEN pm2_5 <= {a}e0 AND pm10 <= {b}e0 THEN '{lab}'" for a, b, lab in C.JOINT_LABELS)
    return f"CASE WHEN pm2_5 IS NULL OR pm10 IS NULL THEN NULL {whens} ELSE '{C.JOINT_LABEL_TOP}' END"


@register(
    "aqi_joint_label",
    "F9",
    with_readings(f"SELECT event_id, pm2_5, pm10, {_joint_sql()} AS aqi_label FROM r"),
)
def aqi_joint_label(spark, sf):
    return R(spark, sf).select("event_id", "pm2_5", "pm10", FA.joint_label("pm2_5", "pm10").alias("aqi_label"))


@register(
    "risk_word",
    "F10",
    with_readings(
        f"SELECT event_id, aqi_label, {map_sql('aqi_label', C.RISK_WORDS, C.UNKNOWN)} AS risk_word "
        f"FROM (SELECT event_id, {_joint_sql()} AS aqi_label FROM r)"
    ),
)
def risk_word(spark, sf):
    r = R(spark, sf).select("event_id", FA.joint_label("pm2_5", "pm10").alias("aqi_label"))
    return r.select("event_id", "aqi_label", FA.risk_word("aqi_label").alias("risk_word"))


@register(
    "aqi_band",
    "F13",
    with_readings(
        f"SELECT event_id, aqi, {upper_case_sql('aqi', C.AQI_CLASSES_6, C.AQI_CLASS_6_TOP)} AS aqi_class6, "
        f"{upper_case_sql('aqi', C.AQI_CLASSES_4, C.AQI_CLASS_4_TOP)} AS aqi_class4 FROM r"
    ),
)
def aqi_band(spark, sf):
    return R(spark, sf).select(
        "event_id", "aqi", FA.aqi_class("aqi", 6).alias("aqi_class6"), FA.aqi_class("aqi", 4).alias("aqi_class4")
    )


@register(
    "battery_band",
    "F14",
    with_readings(
        "SELECT event_id, battery_level, "
        f"CASE WHEN battery_level IS NULL THEN NULL "
        f"{' '.join(f'WHEN battery_level >= {b} THEN {chr(39)}{lab}{chr(39)}' for b, lab in C.BATTERY_BANDS)} "
        f"ELSE '{C.BATTERY_BAND_BOTTOM}' END AS battery_class FROM r"
    ),
)
def battery_band(spark, sf):
    return R(spark, sf).select("event_id", "battery_level", FA.battery_band("battery_level").alias("battery_class"))


@register(
    "alert_level",
    "F4",
    with_readings(
        f"SELECT event_id, aqi, {lower_case_sql('aqi', C.ALERT_LEVELS_6, C.ALERT_LEVEL_BOTTOM)} AS alert_level FROM r"
    ),
)
def alert_level(spark, sf):
    return R(spark, sf).select("event_id", "aqi", FA.alert_level("aqi", 6).alias("alert_level"))


@register(
    "alert_level5",
    "F5",
    with_readings(
        f"SELECT event_id, aqi, {lower_case_sql('aqi', C.ALERT_LEVELS_5, C.ALERT_LEVEL_BOTTOM)} AS alert_level FROM r"
    ),
)
def alert_level5(spark, sf):
    return R(spark, sf).select("event_id", "aqi", FA.alert_level("aqi", 5).alias("alert_level"))


@register(
    "alert_message",
    "F6",
    with_readings(
        f"SELECT event_id, aqi, {lower_case_sql('aqi', C.ALERT_MESSAGES, C.ALERT_MESSAGE_BOTTOM)} AS alert_message "
        "FROM r"
    ),
)
def alert_message(spark, sf):
    return R(spark, sf).select("event_id", "aqi", FA.alert_message("aqi").alias("alert_message"))


@register(
    "health_risk_level",
    "F8",
    with_readings(
        f"SELECT event_id, aqi, {lower_case_sql('aqi', C.HEALTH_RISK_LEVELS, C.HEALTH_RISK_BOTTOM)} "
        "AS health_risk_level FROM r"
    ),
)
def health_risk_level(spark, sf):
    return R(spark, sf).select("event_id", "aqi", FA.health_risk_level("aqi").alias("health_risk_level"))


# ------------------------------------------------------------------ quality

VALID_SQL = (
    "coalesce(pm2_5 IS NOT NULL AND pm10 IS NOT NULL AND aqi IS NOT NULL AND pm2_5 >= 0 AND pm10 >= 0 "
    "AND aqi >= 0 AND aqi <= 500 AND temperature IS NOT NULL AND humidity IS NOT NULL "
    "AND temperature >= -50 AND temperature <= 60 AND humidity >= 0 AND humidity <= 100, false)"
)
ERRORS_SQL = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {cond} THEN '{msg}' END"
    for cond, msg in [
        ("pm2_5 IS NULL", "PM2.5 missing"),
        ("pm10 IS NULL", "PM10 missing"),
        ("aqi IS NULL", "AQI missing"),
        ("pm2_5 < 0", "PM2.5 negative"),
        ("pm10 < 0", "PM10 negative"),
        ("aqi < 0", "AQI negative"),
        ("aqi > 500", "AQI too high"),
        ("temperature IS NULL", "Temperature missing"),
        ("humidity IS NULL", "Humidity missing"),
        ("temperature < -50", "Temperature too low"),
        ("temperature > 60", "Temperature too high"),
        ("humidity < 0", "Humidity negative"),
        ("humidity > 100", "Humidity too high"),
    ]
) + ")"
OUTLIER_SQL = "pm2_5 <= 200 AND pm10 <= 300 AND temperature >= -20 AND temperature <= 50 AND humidity >= 5 AND humidity <= 95"
FLAT_VALID_SQL = (
    "pm2_5 IS NOT NULL AND pm10 IS NOT NULL AND aqi IS NOT NULL AND pm2_5 >= 0 AND pm10 >= 0 AND aqi >= 0 AND aqi <= 500"
)


@register("validity", "P3", with_readings(f"SELECT event_id, sensor_id, {VALID_SQL} AS is_valid FROM r"))
def validity(spark, sf):
    return R(spark, sf).select("event_id", "sensor_id", Q.is_valid().alias("is_valid"))


@register(
    "validation_errors",
    "P4",
    with_readings(
        f"SELECT event_id, {VALID_SQL} AS is_valid, CASE WHEN NOT {VALID_SQL} THEN {ERRORS_SQL} ELSE '' END "
        "AS validation_errors FROM r"
    ),
)
def validation_errors(spark, sf):
    return Q.validate(R(spark, sf)).select("event_id", "is_valid", "validation_errors")


@register("quality_filter", "P5", with_readings(f"SELECT {RC} FROM r WHERE {VALID_SQL} AND {OUTLIER_SQL}"))
def quality_filter(spark, sf):
    return Q.quality_filter(R(spark, sf)).select(*READING_COLS)


@register("flat_validation", "P6", with_readings(f"SELECT {RC} FROM r WHERE {FLAT_VALID_SQL}"))
def flat_validation(spark, sf):
    return Q.flat_filter(R(spark, sf)).select(*READING_COLS)


FIRST_ERROR_SQL = (
    "CASE WHEN sensor_id IS NULL THEN 'Missing field: sensor_id' "
    "WHEN timestamp IS NULL THEN 'Missing field: timestamp' "
    "WHEN pm2_5 IS NULL THEN 'Missing field: pm2_5' "
    "WHEN pm10 IS NULL THEN 'Missing field: pm10' "
    "WHEN aqi IS NULL THEN 'Missing field: aqi' "
    "WHEN NOT (pm2_5 >= 0 AND pm2_5 <= 200) THEN 'Invalid PM2.5: ' || CAST(pm2_5 AS VARCHAR) "
    "WHEN NOT (pm10 >= 0 AND pm10 <= 300) THEN 'Invalid PM10: ' || CAST(pm10 AS VARCHAR) "
    "WHEN NOT (aqi >= 0 AND aqi <= 500) THEN 'Invalid AQI: ' || CAST(aqi AS VARCHAR) "
    "ELSE 'Valid' END"
)


@register(
    "first_error",
    "P7",
    with_readings(
        f"SELECT event_id, reason = 'Valid' AS is_valid, reason FROM (SELECT event_id, {FIRST_ERROR_SQL} AS reason FROM r)"
    ),
)
def first_error(spark, sf):
    r = R(spark, sf)
    return r.select("event_id", Q.first_error(r).alias("c")).select("event_id", "c.is_valid", "c.reason")


def _analytics_sql(where: str) -> str:
    return (
        "SELECT sensor_id, count(pm2_5) AS readings_count, min(pm2_5) AS pm25_min, max(pm2_5) AS pm25_max, "
        f"{round_mean_sql('avg(pm2_5)', 2)} AS pm25_average, min(pm10) AS pm10_min, max(pm10) AS pm10_max, "
        f"{round_mean_sql('avg(pm10)', 2)} AS pm10_average, "
        "coalesce(min(CASE WHEN aqi <> 0 THEN CAST(aqi AS DOUBLE) END), 0e0) AS aqi_min, "
        "coalesce(max(CASE WHEN aqi <> 0 THEN CAST(aqi AS DOUBLE) END), 0e0) AS aqi_max, "
        f"coalesce({round_mean_sql('avg(CASE WHEN aqi <> 0 THEN CAST(aqi AS DOUBLE) END)', 1)}, 0e0) AS aqi_average, "
        "24 AS time_period_hours, 'stable' AS trend "
        f"FROM r WHERE {where} GROUP BY sensor_id"
    )


@register(
    "sensor_analytics",
    "A1 P8 P10",
    with_readings(_analytics_sql("timestamp >= (SELECT max(timestamp) FROM r) - INTERVAL 24 HOUR")),
)
def sensor_analytics(spark, sf):
    return ST.sensor_analytics(R(spark, sf), hours=24)


@register(
    "sensor_analytics_one",
    "A1 P8",
    with_readings(
        "SELECT CASE WHEN count(*) = 0 THEN 'No data available for this sensor in the requested period' "
        "WHEN count(pm2_5) = 0 OR count(pm10) = 0 THEN 'Insufficient data for analysis' END AS error, "
        "'sensor-urban-0' AS sensor_id, count(pm2_5) AS readings_count, min(pm2_5) AS pm25_min, "
        f"max(pm2_5) AS pm25_max, {round_mean_sql('avg(pm2_5)', 2)} AS pm25_average, min(pm10) AS pm10_min, "
        f"max(pm10) AS pm10_max, {round_mean_sql('avg(pm10)', 2)} AS pm10_average, "
        "coalesce(min(CASE WHEN aqi <> 0 THEN CAST(aqi AS DOUBLE) END), 0e0) AS aqi_min, "
        "coalesce(max(CASE WHEN aqi <> 0 THEN CAST(aqi AS DOUBLE) END), 0e0) AS aqi_max, "
        f"coalesce({round_mean_sql('avg(CASE WHEN aqi <> 0 THEN CAST(aqi AS DOUBLE) END)', 1)}, 0e0) AS aqi_average, "
        "24 AS time_period_hours, CASE WHEN count(*) > 0 AND count(pm2_5) > 0 AND count(pm10) > 0 "
        "THEN 'stable' END AS trend "
        "FROM r WHERE sensor_id = 'sensor-urban-0' "
        "AND timestamp >= (SELECT max(timestamp) FROM r) - INTERVAL 24 HOUR"
    ),
)
def sensor_analytics_one(spark, sf):
    return ST.sensor_analytics(R(spark, sf), hours=24, sensor_id="sensor-urban-0")
