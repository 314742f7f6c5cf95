"""Step 3: alerts (D5-D8), summaries and top-k reads (A8, T1-T5), look-back
and defaults (P8-P12), membership join (J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import alerts as AL
from ..operators import lookup as LK
from ..operators import quality as Q
from ..operators import windows as WN
from .base import R, num_text_sql, register, with_readings
from .core import OUTLIER_SQL, READING_COLS, VALID_SQL
from .features import D1_SQL, anomaly_frame

SENSOR = "sensor-urban-0"
ALERT_COLS = ["event_id", "alert_id", "sensor_id", "timestamp", "alert_type", "severity", "message", "aqi_level"]


def _tier_sql(tiers: int, js: bool) -> str:
    p25 = "coalesce(pm2_5, 0e0)"
    p10 = "coalesce(pm10, 0e0)"
    fmt = num_text_sql if js else (lambda v: f"CAST({v} AS VARCHAR)")
    aqi_t = f"coalesce(CAST(aqi AS VARCHAR), '{C.UNKNOWN}')"
    sev, typ, msg = [], [], []
    for severity, atype, prefix, l25, l10 in C.POLLUTION_TIERS[:tiers]:
        cond = f"{p25} > {l25}e0 OR {p10} > {l10}e0"
        sev.append(f"WHEN {cond} THEN '{severity}'")
        typ.append(f"WHEN {cond} THEN '{atype}'")
        msg.append(
            f"WHEN {cond} THEN '{prefix}: PM2.5=' || {fmt(p25)} || ', PM10=' || {fmt(p10)} || ', AQI=' || {aqi_t}"
        )
    return (
        f"SELECT event_id, sensor_id, timestamp, CASE {' '.join(sev)} END AS severity, "
        f"CASE {' '.join(typ)} END AS alert_type, CASE {' '.join(msg)} END AS message, {aqi_t} AS aqi_level FROM r"
    )


def _alert_id_sql(t: str = "") -> str:
    p = f"{t}." if t else ""
    return f"sha256(concat_ws(',', {p}sensor_id, CAST(epoch_us({p}timestamp) AS VARCHAR), {p}alert_type))"


def alerts_cte(tiers: int, name: str) -> str:
    active = ", true AS is_active" if tiers >= 3 else ""
    return (
        f"{name} AS (SELECT event_id, {_alert_id_sql()} AS alert_id, sensor_id, timestamp, alert_type, severity, "
        f"message, aqi_level{active} FROM ({_tier_sql(tiers, js=tiers >= 3)}) WHERE severity IS NOT NULL)"
    )


A2_CTE = alerts_cte(2, "a2")
A3_CTE = alerts_cte(3, "a3")


def alerts3(spark, sf):
    return AL.pollution_alerts(R(spark, sf), tiers=3)


@register("alerts2", "D5 F20", with_readings(f"SELECT {', '.join(ALERT_COLS)} FROM a2", A2_CTE))
def alerts2(spark, sf):
    out = AL.pollution_alerts(R(spark, sf), tiers=2)
    # the two-tier consumer prints numbers the Python way ("60.0")
    return out.select(*ALERT_COLS)


@register("alerts3", "D6 F20", with_readings(f"SELECT {', '.join(ALERT_COLS)}, is_active FROM a3", A3_CTE))
def alerts3_q(spark, sf):
    return alerts3(spark, sf).select(*ALERT_COLS, "is_active")


def _device_sql() -> str:
    parts = []
    specs = [
        (
            f"aqi > {C.DEVICE_AQI_ALERT}",
            "air_quality_alert",
            f"CASE WHEN aqi > {C.DEVICE_AQI_CRITICAL} THEN 'critical' ELSE 'high' END",
            f"'AQI is high: ' || {num_text_sql('CAST(aqi AS DOUBLE)')}",
            "false",
            "false",
        ),
        (
            f"battery_level < {C.DEVICE_BATTERY_LOW}",
            "battery_low",
            "'medium'",
            f"'Battery is low: ' || {num_text_sql('battery_level')} || '%'",
            "true",
            "false",
        ),
        (
            f"signal_strength < {C.DEVICE_SIGNAL_WEAK}",
            "signal_weak",
            "'medium'",
            f"'Signal is weak: ' || {num_text_sql('signal_strength')} || '%'",
            "false",
            "true",
        ),
    ]
    for cond, atype, sev, msg, bl, sw in specs:
        parts.append(
            f"SELECT event_id, sensor_id, timestamp, '{atype}' AS alert_type, {sev} AS severity, {msg} AS message, "
            f"{bl} AS battery_low, {sw} AS signal_weak FROM r WHERE {cond}"
        )
    body = " UNION ALL ".join(parts)
    return f"dev AS (SELECT *, {_alert_id_sql()} AS alert_id FROM ({body}))"


DEV_CTE = _device_sql()
DEV_COLS = ["event_id", "sensor_id", "timestamp", "alert_type", "severity", "message", "battery_low", "signal_weak", "alert_id"]


@register("device_alerts", "D7 F20", with_readings(f"SELECT {', '.join(DEV_COLS)} FROM dev", DEV_CTE))
def device_alerts(spark, sf):
    return AL.device_alerts(R(spark, sf)).select(*DEV_COLS)


@register(
    "alert_defaults",
    "D8 T6 S10",
    with_readings(
        "SELECT event_id, alert_id, coalesce(sensor_id, '') AS sensor_id, timestamp, coalesce(alert_type, '') "
        f"AS alert_type, coalesce(severity, '{C.ALERT_DEFAULT_SEVERITY}') AS severity, coalesce(message, '') "
        f"AS message, coalesce(aqi_level, '{C.ALERT_DEFAULT_AQI_LEVEL}') AS aqi_level FROM ("
        "SELECT event_id, alert_id, sensor_id, timestamp, alert_type, severity, message, aqi_level FROM a2 "
        "UNION ALL SELECT event_id, alert_id, sensor_id, timestamp, alert_type, severity, message, NULL FROM dev)",
        f"{A2_CTE},\n{DEV_CTE}",
    ),
)
def alert_defaults(spark, sf):
    r = R(spark, sf)
    merged = LK.union_topics(AL.pollution_alerts(r, tiers=2), AL.device_alerts(r).drop("battery_low", "signal_weak"))
    return AL.alert_defaults(merged)


@register(
    "alert_summary",
    "A8",
    with_readings(
        "SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'HIGH') AS high_alerts, "
        "count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_alerts, "
        "count(*) FILTER (WHERE severity = 'LOW') AS low_alerts, "
        f"CAST(greatest(count(*) FILTER (WHERE severity = 'HIGH') - {C.DIGEST_TOP_HIGH}, 0) AS BIGINT) AS more_high "
        "FROM a3",
        A3_CTE,
    ),
)
def alert_summary(spark, sf):
    return AL.summary(alerts3(spark, sf))


@register(
    "top3_high",
    "T4 A8",
    with_readings(
        "SELECT alert_id, sensor_id, timestamp, message FROM a3 WHERE severity = 'HIGH' "
        f"ORDER BY timestamp, alert_id LIMIT {C.DIGEST_TOP_HIGH}",
        A3_CTE,
    ),
)
def top3_high(spark, sf):
    return AL.top_high(alerts3(spark, sf)).select("alert_id", "sensor_id", "timestamp", "message")


PROJ_SQL = (
    "SELECT alert_id AS id, alert_type AS type, severity, message, sensor_id, "
    "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, coalesce(nullif(aqi_level, ''), 'Unknown') "
    "AS aqi_level, 'active' AS status FROM a3"
)


@register(
    "active_alerts",
    "T2 P9 P12",
    with_readings(
        f"{PROJ_SQL} WHERE is_active = true ORDER BY a3.timestamp DESC, alert_id DESC LIMIT {C.ALERTS_DEFAULT_LIMIT}",
        A3_CTE,
    ),
)
def active_alerts(spark, sf):
    return AL.alert_projection(AL.latest_active(alerts3(spark, sf), C.ALERTS_DEFAULT_LIMIT))


@register("alert_projection", "P12 P9", with_readings(f"{PROJ_SQL} WHERE is_active = true", A3_CTE))
def alert_projection(spark, sf):
    return AL.alert_projection(Q.active(alerts3(spark, sf)))


@register(
    "recent_n",
    "T1",
    with_readings(
        f"SELECT {', '.join(READING_COLS)} FROM r WHERE sensor_id = '{SENSOR}' "
        f"ORDER BY timestamp DESC, event_id DESC LIMIT {C.RECENT_DEFAULT_LIMIT}"
    ),
)
def recent_n(spark, sf):
    return LK.recent(R(spark, sf).select(*READING_COLS), SENSOR, C.RECENT_DEFAULT_LIMIT)


@register(
    "first_per_sensor",
    "T5",
    with_readings(
        f"SELECT {', '.join(READING_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id "
        "ORDER BY timestamp, event_id) AS rn FROM r) WHERE rn = 1"
    ),
)
def first_per_sensor(spark, sf):
    return WN.earliest(R(spark, sf).select(*READING_COLS)).select(*READING_COLS)


LOOKBACK = "timestamp >= (SELECT max(timestamp) FROM r) - INTERVAL 24 HOUR"


@register(
    "lookback",
    "P8",
    with_readings(f"SELECT event_id, sensor_id, timestamp, pm2_5, pm10, aqi FROM r WHERE sensor_id = '{SENSOR}' AND {LOOKBACK}"),
)
def lookback(spark, sf):
    return Q.lookback(R(spark, sf), 24, sensor_id=SENSOR).select(
        "event_id", "sensor_id", "timestamp", "pm2_5", "pm10", "aqi"
    )


@register(
    "newest_first",
    "T3 P8",
    with_readings(
        f"SELECT event_id, sensor_id, timestamp, pm2_5, pm10, temperature, humidity FROM r WHERE {LOOKBACK} "
        "ORDER BY timestamp DESC, event_id DESC"
    ),
)
def newest_first(spark, sf):
    r = Q.lookback(R(spark, sf), 24)
    return LK.newest_first(r.select("event_id", "sensor_id", "timestamp", "pm2_5", "pm10", "temperature", "humidity"))


NUM_SQL = (
    "CASE WHEN TRY_CAST(regexp_extract(aqi_level, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE) "
    "<> 0 THEN TRY_CAST(regexp_extract(aqi_level, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE) END"
)


@register(
    "numeric_only",
    "P10 F18",
    with_readings(
        f"SELECT sensor_id, count(*) AS alerts, count(v) AS numeric_values, min(v) AS aqi_min, max(v) AS aqi_max, "
        f"avg(v) AS aqi_avg FROM (SELECT sensor_id, {NUM_SQL} AS v FROM a3) GROUP BY sensor_id",
        A3_CTE,
    ),
    means=["aqi_avg"],
)
def numeric_only(spark, sf):
    a = alerts3(spark, sf).select("sensor_id", Q.numeric_aqi("aqi_level").alias("v"))
    return a.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count("v").alias("numeric_values"),
        F.min("v").alias("aqi_min"),
        F.max("v").alias("aqi_max"),
        F.avg("v").alias("aqi_avg"),
    )


@register(
    "defaults",
    "P11",
    with_readings(
        "SELECT event_id, 'Unknown' AS location_name, coalesce(nullif(area_type, ''), 'Unknown') AS area_type, "
        "coalesce(pm2_5, 0e0) AS pm2_5, coalesce(pm10, 0e0) AS pm10, coalesce(CAST(aqi AS VARCHAR), 'Unknown') "
        "AS aqi_text FROM r"
    ),
)
def defaults(spark, sf):
    r = R(spark, sf).withColumn("location_name", F.lit(None).cast("string"))
    return Q.with_defaults(r).select("event_id", "location_name", "area_type", "pm2_5", "pm10", "aqi_text")


@register(
    "membership_flag",
    "J2",
    with_readings(
        "SELECT q.event_id, q.sensor_id, q.timestamp, CASE WHEN h.sensor_id IS NULL THEN 0 ELSE 1 END AS is_hit "
        f"FROM (SELECT * FROM r WHERE {VALID_SQL} AND {OUTLIER_SQL}) q LEFT JOIN "
        "(SELECT DISTINCT sensor_id, timestamp FROM d1 WHERE is_anomaly) h "
        "ON q.sensor_id = h.sensor_id AND q.timestamp = h.timestamp",
        f"d1 AS ({D1_SQL})",
    ),
)
def membership_flag(spark, sf):
    base = Q.quality_filter(R(spark, sf)).select("event_id", "sensor_id", "timestamp")
    hits = anomaly_frame(spark, sf).filter(F.col("is_anomaly") == F.lit(True))
    return LK.membership_flag(base, hits).select("event_id", "sensor_id", "timestamp", "is_hit")


_DIGEST_START = f"make_timestamp(epoch_us(timestamp) - (epoch_us(timestamp) % {30 * 60_000_000}))"


@register(
    "digest_windows",
    "ST7 A8",
    with_readings(
        f"SELECT {_DIGEST_START} AS window_start, count(*) AS total_alerts, "
        "count(*) FILTER (WHERE severity = 'HIGH') AS high_alerts, "
        "count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_alerts, "
        "count(*) FILTER (WHERE severity = 'LOW') AS low_alerts, "
        f"CAST(greatest(count(*) FILTER (WHERE severity = 'HIGH') - {C.DIGEST_TOP_HIGH}, 0) AS BIGINT) AS more_high, "
        "count(*) FILTER (WHERE severity = 'HIGH') > 0 AS deliver FROM a3 GROUP BY 1",
        A3_CTE,
    ),
)
def digest_windows(spark, sf):
    return AL.digest_windows(alerts3(spark, sf))[0]


@register(
    "digest_top_high",
    "ST7 T4",
    with_readings(
        "SELECT window_start, rank, alert_id, sensor_id, alert_type FROM (SELECT *, row_number() OVER "
        "(PARTITION BY window_start ORDER BY timestamp, alert_id) AS rank FROM "
        f"(SELECT *, {_DIGEST_START} AS window_start FROM a3 WHERE severity = 'HIGH')) "
        f"WHERE rank <= {C.DIGEST_TOP_HIGH}",
        A3_CTE,
    ),
)
def digest_top_high(spark, sf):
    return AL.digest_windows(alerts3(spark, sf))[1]


_C_US = 30 * 60_000_000
DIGEST_CHAIN_SQL = with_readings(
    "SELECT make_timestamp(c.t) AS sent_at, count(*) AS total_alerts, "
    "count(*) FILTER (WHERE m.severity = 'HIGH') AS high_alerts, "
    "count(*) FILTER (WHERE m.severity = 'MEDIUM') AS medium_alerts, "
    "count(*) FILTER (WHERE m.severity = 'LOW') AS low_alerts, "
    f"CAST(greatest(count(*) FILTER (WHERE m.severity = 'HIGH') - {C.DIGEST_TOP_HIGH}, 0) AS BIGINT) AS more_high, "
    "count(*) FILTER (WHERE m.severity = 'HIGH') > 0 AS deliver, "
    "coalesce(array_to_string(list(m.label ORDER BY m.t, m.id) FILTER (WHERE m.severity = 'HIGH')"
    f"[1:{C.DIGEST_TOP_HIGH}], '; '), '') AS top_high_text "
    "FROM (SELECT *, first_value(CASE WHEN kind = 2 THEN t END IGNORE NULLS) OVER (ORDER BY t, id, kind "
    "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS dt FROM ("
    "SELECT t, id, severity, label, 1 AS kind FROM al UNION ALL SELECT t, id, NULL, NULL, 2 FROM chain)) m "
    "JOIN chain c ON c.t = m.dt WHERE m.kind = 1 GROUP BY c.t",
    f"{A3_CTE},\n"
    "al AS (SELECT epoch_us(timestamp) AS t, alert_id AS id, severity, sensor_id || ': ' || alert_type AS label FROM a3),\n"
    "chain AS (WITH RECURSIVE ch(t, id) AS ("
    "(SELECT t, id FROM al ORDER BY t, id LIMIT 1) UNION ALL "
    f"SELECT n.t, n.id FROM ch, LATERAL (SELECT t, id FROM al WHERE al.t >= ch.t + {_C_US} ORDER BY t, id LIMIT 1) n"
    ") SELECT * FROM ch)",
)


@register("digest_chain", "ST7 A8 T4", DIGEST_CHAIN_SQL)
def digest_chain(spark, sf):
    from ..operators.digest import digest_chain as chain

    out = chain(alerts3(spark, sf))
    return out.select(
        "sent_at", "total_alerts", "high_alerts", "medium_alerts", "low_alerts", "more_high", "deliver",
        F.array_join("top_high", "; ").alias("top_high_text"),
    )


# Device envelopes derived from events: a label instead of the AQI, a bad number, and real re-deliveries.
ENVELOPE_CTE = f"""
wire AS (
  SELECT event_id, sensor_id, timestamp,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(aqi AS DOUBLE) END AS air_quality_index,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE battery_level END AS battery_level, signal_strength FROM r
),
delivered AS (SELECT DISTINCT sensor_id, timestamp, air_quality_index, battery_level, signal_strength FROM wire WHERE timestamp IS NOT NULL),
found AS (
  SELECT sensor_id, timestamp, 'air_quality_alert' AS alert_type, CASE WHEN air_quality_index > {C.DEVICE_AQI_CRITICAL} THEN 'critical' ELSE 'high' END AS severity
  FROM delivered WHERE air_quality_index > {C.DEVICE_AQI_ALERT}
  UNION ALL SELECT sensor_id, timestamp, 'battery_low', 'medium' FROM delivered WHERE battery_level < {C.DEVICE_BATTERY_LOW}
  UNION ALL SELECT sensor_id, timestamp, 'signal_weak', 'medium' FROM delivered WHERE signal_strength < {C.DEVICE_SIGNAL_WEAK}
)"""


def device_envelopes(r):
    """Readings as device messages: every fifth AQI is a label, every seventh battery no number, every third message comes twice."""
    aqi = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(F.lit("Moderate").alias("v")))).otherwise(F.to_json(F.struct(F.col("aqi").alias("v"))))
    battery = F.when(F.col("event_id") % 7 == 0, F.to_json(F.struct(F.lit("n/a").alias("v")))).otherwise(F.to_json(F.struct(F.col("battery_level").alias("v"))))
    inner = lambda c: F.coalesce(F.regexp_extract(c, '^\\{"v":(.*)\\}$', 1), F.lit(""))
    text = lambda c: F.when(inner(c) == "", "null").otherwise(inner(c))
    value = F.concat(
        F.lit('{"sensor_id":"'), "sensor_id", F.lit('","timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd\'T\'HH:mm:ss.SSSSSS\'Z\'"),
        F.lit('","air_quality_index":'), text(aqi), F.lit(',"battery_level":'), text(battery),
        F.lit(',"signal_strength":'), F.coalesce(F.col("signal_strength").cast("string"), F.lit("null")), F.lit("}"),
    )
    copies = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return r.filter(F.col("timestamp").isNotNull()).select(value.alias("value"), F.explode(copies).alias("delivery"))


@register(
    "device_envelope_alerts",
    "S6 ST9 D7 T6",
    with_readings("SELECT sensor_id, timestamp, alert_type, severity FROM found", ENVELOPE_CTE),
)
def device_envelope_alerts(spark, sf):
    from ..sources.parse import parse_device

    devices = parse_device(device_envelopes(R(spark, sf)))
    once = devices.dropDuplicates(["sensor_id", "timestamp", "air_quality_index", "battery_level", "signal_strength"])
    return AL.device_alerts(once, aqi="air_quality_index").select("sensor_id", "timestamp", "alert_type", "severity")
