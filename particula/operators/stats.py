"""Aggregations (A1-A11). All are hash aggregates with map-side partials;
global statistics are single-row aggregates, never collected lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.aqi import has_alert
from ..functions.numeric import round_mean
from ..functions.text import city_token, is_weekend, time_band
from .joins import null_safe_join
from .newest import extreme_row
from .quality import is_valid, lookback


def _js_round(c):
    """Math.round: half towards +infinity."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def sensor_analytics(
    df: DataFrame, hours: float = C.LOOKBACK_DEFAULT_HOURS, sensor_id: str | None = None, as_of=None
) -> DataFrame:
    """A1: look-back stats per sensor (or for one sensor, always one row with `error`)."""
    win = lookback(df, hours, sensor_id=sensor_id, as_of=as_of)
    aqi_ok = F.when(F.col("aqi") != 0, F.col("aqi").cast("double"))
    aggs = [
        F.count("pm2_5").alias("readings_count"),
        F.min("pm2_5").alias("pm25_min"),
        F.max("pm2_5").alias("pm25_max"),
        round_mean(F.avg("pm2_5"), 2).alias("pm25_average"),
        F.min("pm10").alias("pm10_min"),
        F.max("pm10").alias("pm10_max"),
        round_mean(F.avg("pm10"), 2).alias("pm10_average"),
        F.coalesce(F.min(aqi_ok), F.lit(0.0)).alias("aqi_min"),
        F.coalesce(F.max(aqi_ok), F.lit(0.0)).alias("aqi_max"),
        F.coalesce(round_mean(F.avg(aqi_ok), 1), F.lit(0.0)).alias("aqi_average"),
    ]
    if sensor_id is None:
        out = win.groupBy("sensor_id").agg(*aggs)
        return out.withColumn("time_period_hours", F.lit(int(hours))).withColumn(
            "trend", F.lit(C.ANALYTICS_TREND)
        )
    out = win.agg(F.count(F.lit(1)).alias("_rows"), F.count("pm10").alias("_n10"), *aggs)
    err = F.when(F.col("_rows") == 0, F.lit(C.NO_DATA_ERROR)).when(
        (F.col("readings_count") == 0) | (F.col("_n10") == 0), F.lit(C.INSUFFICIENT_DATA_ERROR)
    )
    return (
        out.withColumn("error", err)
        .withColumn("sensor_id", F.lit(sensor_id))
        .withColumn("time_period_hours", F.lit(int(hours)))
        .withColumn("trend", F.when(F.col("error").isNull(), F.lit(C.ANALYTICS_TREND)))
        .drop("_rows", "_n10")
    )


def system_stats(readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """A2: distinct sensors, total records, mean AQI (one pass) + active alerts (scalar subquery)."""
    active = alerts.select(F.count_if(F.col("is_active") == F.lit(True))).scalar()
    return readings.agg(
        F.count_distinct("sensor_id").alias("sensor_count"),
        F.count(F.lit(1)).alias("total_records"),
        F.avg("aqi").alias("average_aqi"),
    ).withColumn("active_alerts", active)


def sensor_statistics(df: DataFrame, aqi="aqi") -> DataFrame:
    """A3: per-sensor count, avg/max/min AQI, avg PM2.5, battery and signal of the newest reading."""
    a = F.col(aqi).cast("double")
    stats = df.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("total_readings"),
        round_mean(F.avg(aqi), 1).alias("avg_aqi"),
        F.round(F.max(a), 1).alias("max_aqi"),
        F.round(F.min(a), 1).alias("min_aqi"),
        round_mean(F.avg("pm2_5"), 2).alias("avg_pm2_5"),
    )
    newest = extreme_row(df.select("sensor_id", "timestamp", "event_id", "battery_level", "signal_strength"), ["sensor_id"], "timestamp", "event_id")
    newest = newest.select("sensor_id", F.col("battery_level").alias("current_battery"), F.col("signal_strength").alias("current_signal"))
    return null_safe_join(stats, newest, ["sensor_id"], "left")


WINDOW_AGG_COLS = ["avg_pm2_5", "max_pm2_5", "min_pm2_5", "avg_pm10", "max_pm10", "min_pm10", "total_readings"]
SMART_COLS = [
    "total_readings", "avg_aqi", "max_aqi", "min_aqi", "avg_pm2_5", "max_pm2_5", "min_pm2_5", "avg_battery", "avg_signal",
]


def window_aggregates(df: DataFrame, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """A5: tumbling (or sliding) per-sensor window aggregates of pm2_5/pm10.

    Readings are aggregated once, into panes of one slide; sliding windows
    combine the panes, so raw rows are never copied.
    """
    long, step = pd.Timedelta(size), pd.Timedelta(slide or size)
    panes_each, rest = divmod(long, step)
    if rest:
        raise ValueError("a window must be a whole number of slides")
    pane = F.window("timestamp", slide or size)
    out = df.groupBy(pane.alias("w"), "sensor_id").agg(
        *[f(c).alias(f"_{name}_{c}") for c in ("pm2_5", "pm10") for name, f in (("n", F.count), ("s", F.sum), ("max", F.max), ("min", F.min))],
        F.count(F.lit(1)).alias("_rows"),
    )
    out = out.withColumn("start", F.unix_micros("w.start"))
    step_us = step // pd.Timedelta(microseconds=1)
    if panes_each > 1:
        out = out.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(panes_each - 1)), lambda k: F.col("start") - k * F.lit(step_us))))
        out = out.groupBy("start", "sensor_id").agg(
            *[f(f"_{name}_{c}").alias(f"_{name}_{c}") for c in ("pm2_5", "pm10") for name, f in (("n", F.sum), ("s", F.sum), ("max", F.max), ("min", F.min))],
            F.sum("_rows").alias("_rows"),
        )
    values = []
    for c in ("pm2_5", "pm10"):
        values += [F.when(F.col(f"_n_{c}") > 0, F.col(f"_s_{c}") / F.col(f"_n_{c}")).alias(f"avg_{c}"), F.col(f"_max_{c}").alias(f"max_{c}"), F.col(f"_min_{c}").alias(f"min_{c}")]
    return out.select(
        "sensor_id",
        F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("start") + F.lit(step_us * panes_each)).alias("window_end"),
        *values,
        F.col("_rows").alias("total_readings"),
    )


def smart_stats(df: DataFrame, size: str = "5 minutes", aqi="aqi") -> DataFrame:
    """A4: device-sensor window stats (count, AQI and PM2.5 avg/max/min, avg battery/signal)."""
    a = F.col(aqi).cast("double")
    return (
        df.groupBy(F.window("timestamp", size).alias("w"), "sensor_id")
        .agg(
            F.count(F.lit(1)).alias("total_readings"),
            F.avg(aqi).alias("avg_aqi"),
            F.max(a).alias("max_aqi"),
            F.min(a).alias("min_aqi"),
            F.avg("pm2_5").alias("avg_pm2_5"),
            F.max("pm2_5").alias("max_pm2_5"),
            F.min("pm2_5").alias("min_pm2_5"),
            F.avg("battery_level").alias("avg_battery"),
            F.avg("signal_strength").alias("avg_signal"),
        )
        .select("sensor_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *SMART_COLS)

    )


def fleet_snapshot(latest: DataFrame, aqi="aqi") -> DataFrame:
    """Over the latest reading per sensor: count, rounded mean AQI, online, rounded mean battery."""
    return latest.agg(
        F.count(F.lit(1)).alias("total_sensors"),
        _js_round(F.avg(aqi)).alias("avg_aqi"),
        F.count_if(F.col("battery_level") > 0).alias("online_sensors"),
        _js_round(F.avg("battery_level")).alias("avg_battery"),
    )


def map_stats(latest: DataFrame, aqi="aqi") -> DataFrame:
    """Sensors, rounded mean AQI, distinct cities."""
    city = city_token(F.col("city") if "city" in latest.columns else F.lit(None).cast("string"), "sensor_id")
    return latest.agg(
        F.count(F.lit(1)).alias("total_sensors"),
        _js_round(F.avg(aqi)).alias("avg_aqi"),
        F.count_distinct(city).alias("cities_covered"),
    )


def batch_counters(validated: DataFrame, anomalies: DataFrame) -> DataFrame:
    """total/valid/invalid/alerts in one pass over the unfiltered frame;
    anomalies from the scored frame as a scalar subquery."""
    n_anom = anomalies.select(F.count_if(F.col("is_anomaly") == F.lit(True))).scalar()
    v = F.col("is_valid") if "is_valid" in validated.columns else is_valid()
    return validated.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(v).alias("valid_records"),
        F.count_if(~v).alias("invalid_records"),
        F.count_if(has_alert("aqi") == F.lit(True)).alias("alert_records"),
    ).withColumn("anomaly_records", n_anom)


def band_profile(df: DataFrame) -> DataFrame:
    """A10: mean PM/AQI by time-of-day band x weekend flag."""
    return (
        df.withColumn("time_band", time_band("timestamp"))
        .withColumn("is_weekend", is_weekend("timestamp"))
        .groupBy("time_band", "is_weekend")
        .agg(
            F.count(F.lit(1)).alias("readings"),
            F.avg("pm2_5").alias("avg_pm2_5"),
            F.avg("pm10").alias("avg_pm10"),
            F.avg("aqi").alias("avg_aqi"),
        )
    )


def sensor_ids(df: DataFrame) -> DataFrame:
    """A11."""
    return df.select("sensor_id").distinct()
