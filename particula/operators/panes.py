"""A2, A4, A5, A11 from stored panes: aggregates of five minutes that merge.

A pane row holds, for a sensor and five minutes, the rows and for each measure
count, sum, least and greatest value. Longer windows, fleet totals and sensor
lists merge panes, so a query reads sensors x panes rows, however many readings
there are. Panes live in a table of snapshots beside the readings'. `refresh`
computes anew only the hours that commits wrote to since the last one, late
rows of old hours among them, and commits panes and bookmark together: a
failed refresh is done again, a finished one never twice. An hour is computed
from the merged readings, so corrected readings correct their panes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .snapshots import Snapshots

PANE_MINUTES = 5
MEASURES = ("pm2_5", "pm10", "aqi", "battery_level", "signal_strength")
_PARTS = {"n": "count", "s": "sum", "min": "min", "max": "max"}
_MERGED = {"n": "sum", "s": "sum", "min": "min", "max": "max"}


def panes(readings: DataFrame) -> DataFrame:
    """(sensor_id, pane, rows, n/s/min/max of every measure)."""
    pane = F.window("timestamp", f"{PANE_MINUTES} minutes")["start"]
    parts = [F.expr(f"{f}(CAST(`{m}` AS DOUBLE)) AS {p}_{m}") for m in MEASURES for p, f in _PARTS.items()]
    return readings.groupBy("sensor_id", pane.alias("pane")).agg(F.count(F.lit(1)).alias("rows"), *parts)


def store(spark: SparkSession, path: str, **slots) -> Snapshots:
    """A table for panes; its hours (``slots``) should be as long as those of the readings' table."""
    return Snapshots(spark, path, key=("sensor_id", "pane"), by="pane", **slots)


def refresh(readings: Snapshots, stored: Snapshots) -> list[str]:
    """Bring the panes up to the readings' newest version; the hours that were computed."""
    version = readings.manifest()["version"]
    hours = readings.hours_since(stored.manifest().get("note", 0))
    if hours:
        stored.upsert(panes(readings.read(version, hours)), note=version)
    return hours


def _merged(stored: DataFrame, keys: list, measures: tuple[str, ...]) -> DataFrame:
    parts = [F.expr(f"{f}({p}_{m}) AS {p}_{m}") for m in measures for p, f in _MERGED.items()]
    return stored.groupBy(*keys).agg(F.sum("rows").alias("total_readings"), *parts)


def _avg(m: str) -> str:
    return f"CASE WHEN n_{m} > 0 THEN s_{m} / n_{m} END"


def _windows(stored: DataFrame, minutes: int, measures: tuple[str, ...]) -> DataFrame:
    if minutes % PANE_MINUTES:
        raise ValueError(f"a window must be a multiple of {PANE_MINUTES} minutes")
    us = minutes * C.MICROS_PER_MINUTE
    start = F.expr(f"timestamp_micros(unix_micros(pane) - pmod(unix_micros(pane), {us}L))").alias("window_start")
    out = _merged(stored, ["sensor_id", start], measures)
    return out.withColumn("window_end", F.expr(f"timestamp_micros(unix_micros(window_start) + {us}L)"))


def window_aggregates(stored: DataFrame, minutes: int) -> DataFrame:
    """A5 for any multiple of a pane."""
    out = _windows(stored, minutes, ("pm2_5", "pm10"))
    values = [x for m in ("pm2_5", "pm10") for x in (f"{_avg(m)} AS avg_{m}", f"max_{m}", f"min_{m}")]
    return out.selectExpr("sensor_id", "window_start", "window_end", *values, "total_readings")


def smart_stats(stored: DataFrame, minutes: int = PANE_MINUTES) -> DataFrame:
    """A4 for any multiple of a pane."""
    out = _windows(stored, minutes, ("aqi", "pm2_5", "battery_level", "signal_strength"))
    values = [x for m in ("aqi", "pm2_5") for x in (f"{_avg(m)} AS avg_{m}", f"max_{m}", f"min_{m}")]
    ends = [f"{_avg('battery_level')} AS avg_battery", f"{_avg('signal_strength')} AS avg_signal"]
    return out.selectExpr("sensor_id", "window_start", "window_end", "total_readings", *values, *ends)


def system_stats(stored: DataFrame, alerts: DataFrame) -> DataFrame:
    """A2: sensors, records and mean AQI from panes, active alerts from their table."""
    active = alerts.select(F.count_if(F.col("is_active") == F.lit(True))).scalar()
    out = stored.agg(F.count_distinct("sensor_id").alias("sensor_count"), F.sum("rows").alias("total_records"), F.expr("sum(s_aqi) / nullif(sum(n_aqi), 0) AS average_aqi"))
    return out.withColumn("active_alerts", active)


def sensor_ids(stored: DataFrame) -> DataFrame:
    """A11."""
    return stored.select("sensor_id").distinct()
