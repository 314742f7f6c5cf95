"""Step 2: window features (W1-W8) and rule-based anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import ratio_score as ratio
from ..operators import anomalies as AN
from ..operators import quality as Q
from ..operators import windows as WN
from ..functions.numeric import round_mean
from .base import R, W_SENSOR, frame, register, with_readings
from .core import FIRST_ERROR_SQL, FLAT_VALID_SQL, OUTLIER_SQL, READING_COLS, VALID_SQL

KEYS = ["event_id", "sensor_id", "timestamp"]


def _r6(df, cols):
    for c in cols:
        df = df.withColumn(c, round_mean(c, 6))
    return df


def agg_sql(func: str, col: str, over: str) -> str:
    return f"{func}({col}) OVER ({over})"


W1_SQL = ", ".join(
    f"{agg_sql(a.func, a.col, f'{W_SENSOR} {frame(a.minutes)}')} AS {a.out}" for a in AN.W1_AGGS
)


@register("trailing_features", "W1 W2 W3", with_readings(f"SELECT event_id, sensor_id, timestamp, {W1_SQL} FROM r"), means=[a.out for a in AN.W1_AGGS if a.func == "avg"])
def trailing_features(spark, sf):
    out = AN.trailing_features(R(spark, sf))
    return out.select(*KEYS, *[a.out for a in AN.W1_AGGS])


@register(
    "ratio_score",
    "F16",
    with_readings(
        "SELECT event_id, round(1e-9 + abs(pm2_5 - a5) / nullif(a5, 0) + abs(aqi - q5) / nullif(q5, 0), 6) AS ratio_score "
        f"FROM (SELECT *, {agg_sql('avg', 'pm2_5', f'{W_SENSOR} {frame(5)}')} AS a5, "
        f"{agg_sql('avg', 'aqi', f'{W_SENSOR} {frame(5)}')} AS q5 FROM r)"
    ),
)
def ratio_score(spark, sf):
    f = WN.trailing(R(spark, sf), [WN.Agg("a5", "avg", "pm2_5", 5), WN.Agg("q5", "avg", "aqi", 5)])
    return f.select("event_id", round_mean(ratio("pm2_5", "a5") + ratio("aqi", "q5"), 6).alias("ratio_score"))


_RUN = f"PARTITION BY sensor_id ORDER BY epoch_us(timestamp) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
RUN_SQL = ", ".join(
    f"{agg_sql(fn, c, _RUN)} AS {c}_{fn}" for c in ("pm2_5", "pm10", "aqi") for fn in ("avg", "max", "min")
)
RUN_COLS = [f"{c}_{fn}" for c in ("pm2_5", "pm10", "aqi") for fn in ("avg", "max", "min")]


@register("running_features", "W4", with_readings(f"SELECT event_id, sensor_id, timestamp, {RUN_SQL} FROM r"), means=[c for c in RUN_COLS if c.endswith("_avg")])
def running_features(spark, sf):
    out = WN.running(R(spark, sf), ["pm2_5", "pm10", "aqi"])
    return out.select(*KEYS, *RUN_COLS)


_L10 = "PARTITION BY sensor_id ORDER BY epoch_us(timestamp), event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"
L10_SQL = ", ".join(f"{agg_sql(a.func, a.col, _L10)} AS {a.out}" for a in AN.LAST10_AGGS)
P7_VALID = f"({FIRST_ERROR_SQL}) = 'Valid'"


def _p7_valid(spark, sf):
    r = R(spark, sf)
    return Q.first_error_filter(r)


@register(
    "last10_features",
    "W5",
    with_readings(f"SELECT event_id, sensor_id, timestamp, {L10_SQL} FROM r WHERE {P7_VALID}"),
    means=[a.out for a in AN.LAST10_AGGS if a.func == "avg"],
)
def last10_features(spark, sf):
    cols = [a.out for a in AN.LAST10_AGGS]
    out = WN.last_rows(_p7_valid(spark, sf), AN.LAST10_AGGS, n=C.LAST_N_ROWS, with_count=None)
    return out.select(*KEYS, *cols)


@register(
    "anomaly_last10",
    "D4 W5 F16",
    with_readings(
        "SELECT event_id, sensor_id, timestamp, pm25_avg, round(1e-9 + score, 6) AS anomaly_score, "
        "score > 0.5 AS is_anomaly FROM (SELECT *, CASE WHEN n >= 2 AND pm25_avg > 0 "
        "THEN abs(pm2_5 - pm25_avg) / pm25_avg ELSE 0e0 END AS score FROM (SELECT *, "
        f"{agg_sql('avg', 'pm2_5', _L10)} AS pm25_avg, count(*) OVER ({_L10}) AS n FROM r WHERE {P7_VALID}))"
    ),
    means=["pm25_avg"],
)
def anomaly_last10(spark, sf):
    out = AN.last10_features(_p7_valid(spark, sf))
    return _r6(out.select(*KEYS, "pm25_avg", "anomaly_score", "is_anomaly"), ["anomaly_score"])


@register(
    "sensor_stddev",
    "W7",
    with_readings(
        "SELECT event_id, sensor_id, round(1e-9 + stddev_samp(pm2_5) OVER (PARTITION BY sensor_id), 6) AS sd_pm25, "
        "round(1e-9 + stddev_samp(aqi) OVER (PARTITION BY sensor_id), 6) AS sd_aqi FROM r"
    ),
)
def sensor_stddev(spark, sf):
    out = WN.partition_stats(
        R(spark, sf).select("event_id", "sensor_id", "pm2_5", "aqi"),
        [("sd_pm25", F.stddev_samp("pm2_5")), ("sd_aqi", F.stddev_samp("aqi"))],
    )
    return _r6(out.select("event_id", "sensor_id", "sd_pm25", "sd_aqi"), ["sd_pm25", "sd_aqi"])


LATEST_SQL = (
    f"SELECT {', '.join(READING_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id "
    "ORDER BY timestamp DESC, event_id DESC) AS rn FROM r) WHERE rn = 1"
)


@register("latest_reading", "W6 J1", with_readings(LATEST_SQL))
def latest_reading(spark, sf):
    return WN.latest(R(spark, sf).select(*READING_COLS)).select(*READING_COLS)


@register(
    "keep_last_n",
    "W8",
    with_readings(
        "SELECT event_id, sensor_id, timestamp, pm2_5 FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id "
        f"ORDER BY timestamp DESC, event_id DESC) AS rn FROM r) WHERE rn <= {C.KEEP_LAST_PER_SENSOR}"
    ),
)
def keep_last_n(spark, sf):
    r = R(spark, sf).select("event_id", "sensor_id", "timestamp", "pm2_5")
    return WN.keep_last(r, C.KEEP_LAST_PER_SENSOR)


@register(
    "keep_last_overall",
    "W8",
    with_readings(
        "SELECT event_id, sensor_id, timestamp, pm2_5 FROM r ORDER BY timestamp DESC, event_id DESC "
        f"LIMIT {C.KEEP_LAST_OVERALL}"
    ),
)
def keep_last_overall(spark, sf):
    r = R(spark, sf).select("event_id", "sensor_id", "timestamp", "pm2_5")
    return WN.keep_last(r, C.KEEP_LAST_OVERALL, key=None)


D1_SQL = (
    "SELECT event_id, sensor_id, timestamp, a5 AS pm25_5min_avg, q5 AS aqi_5min_avg, "
    "pm25_anomaly, aqi_anomaly, is_anomaly, round(1e-9 + CASE WHEN is_anomaly THEN abs(pm2_5 - a5) / nullif(a5, 0) "
    "+ abs(aqi - q5) / nullif(q5, 0) ELSE 0e0 END, 6) AS anomaly_score FROM ("
    "SELECT *, pm25_anomaly OR aqi_anomaly AS is_anomaly FROM ("
    "SELECT *, abs(pm2_5 - a5) > 2e0 * sd25 AS pm25_anomaly, abs(aqi - q5) > 2e0 * sdq AS aqi_anomaly FROM ("
    f"SELECT *, {agg_sql('avg', 'pm2_5', f'{W_SENSOR} {frame(5)}')} AS a5, "
    f"{agg_sql('avg', 'aqi', f'{W_SENSOR} {frame(5)}')} AS q5, "
    "stddev_samp(pm2_5) OVER (PARTITION BY sensor_id) AS sd25, stddev_samp(aqi) OVER (PARTITION BY sensor_id) AS sdq "
    f"FROM r WHERE {VALID_SQL} AND {OUTLIER_SQL})))"
)
D1_COLS = ["pm25_5min_avg", "aqi_5min_avg", "pm25_anomaly", "aqi_anomaly", "is_anomaly", "anomaly_score"]


def anomaly_frame(spark, sf):
    return AN.anomaly_2sigma(Q.quality_filter(R(spark, sf)))


@register("anomaly_2sigma", "D1 W1 W7 F16 P5", with_readings(D1_SQL), means=["pm25_5min_avg", "aqi_5min_avg"])
def anomaly_2sigma(spark, sf):
    out = anomaly_frame(spark, sf).select(*KEYS, *D1_COLS)
    return _r6(out, ["anomaly_score"])


@register(
    "anomaly_ratio5",
    "D2 W1 W2 P6",
    with_readings(
        "SELECT event_id, sensor_id, timestamp, a5 AS pm25_5min_avg, a15 AS pm25_15min_avg, "
        "round(1e-9 + abs(pm2_5 - a5) / nullif(a5, 0), 6) AS anomaly_score, abs(pm2_5 - a5) / nullif(a5, 0) > 0.5 "
        f"AS is_anomaly FROM (SELECT *, {agg_sql('avg', 'pm2_5', f'{W_SENSOR} {frame(5)}')} AS a5, "
        f"{agg_sql('avg', 'pm2_5', f'{W_SENSOR} {frame(15)}')} AS a15 FROM r WHERE {FLAT_VALID_SQL})"
    ),
    means=["pm25_5min_avg", "pm25_15min_avg"],
)
def anomaly_ratio5(spark, sf):
    out = AN.anomaly_ratio5(Q.flat_filter(R(spark, sf)))
    out = out.select(*KEYS, "pm25_5min_avg", "pm25_15min_avg", "anomaly_score", "is_anomaly")
    return _r6(out, ["anomaly_score"])


@register(
    "anomaly_running",
    "D3 W4 F5 P6",
    with_readings(
        "SELECT event_id, sensor_id, timestamp, a AS pm25_avg, "
        "round(1e-9 + abs(pm2_5 - a) / nullif(a, 0), 6) AS anomaly_score, abs(pm2_5 - a) / nullif(a, 0) > 0.5 AS is_anomaly, "
        f"CASE WHEN aqi >= 200 THEN 'Very Unhealthy' WHEN aqi >= 150 THEN 'Unhealthy' WHEN aqi >= 100 "
        "THEN 'Unhealthy for Sensitive Groups' WHEN aqi >= 50 THEN 'Moderate' ELSE 'Good' END AS alert_level "
        f"FROM (SELECT *, {agg_sql('avg', 'pm2_5', _RUN)} AS a FROM r WHERE {FLAT_VALID_SQL})"
    ),
    means=["pm25_avg"],
)
def anomaly_running(spark, sf):
    from ..functions.aqi import alert_level

    out = AN.anomaly_running(Q.flat_filter(R(spark, sf)))
    out = out.select(
        *KEYS,
        F.col("pm2_5_avg").alias("pm25_avg"),
        "anomaly_score",
        "is_anomaly",
        alert_level("aqi", 5).alias("alert_level"),
    )
    return _r6(out, ["anomaly_score"])
