"""Readings view over the driver tables.

`events` is projected onto the canonical readings columns (see FIXTURES.md
section 7); every registered query starts here, so its work grows with the
`events` table. Only the columns a query later uses survive column pruning,
and filters on `timestamp`/`sensor_id` are pushed to the parquet scan where
they touch raw columns.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aqi import aqi_score

# FIXED VALUES: event_type -> sensor kind / area type of the projection.
SENSOR_KIND = {"click": "urban", "view": "industrial", "purchase": "residential", "signup": "bus"}
SENSOR_KIND_OTHER = "wearable"
AREA_TYPE = {"click": "Urban", "view": "Industrial", "purchase": "Residential"}
AREA_TYPE_OTHER = "Mobile"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, listed anew at every call."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _case_sql(col: str, mapping: dict, other: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE '{other}' END"


#: Metadata of a column that is computed from parsed text: a filter on it is no use to the scan and
#: would parse the text again for every term (see `operators.quality.staged`).
PARSED = "parsed"


def _parsed(sql: str, name: str) -> Column:
    return F.expr(sql).alias(name, metadata={PARSED: True})


def project_events(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """events -> readings (without aqi); `extra` raw columns are carried along."""
    # k is parsed in its own projection; Catalyst keeps that projection apart
    # (it does not duplicate a non-cheap expression into a consumer that
    # refers to it several times), so the JSON text is parsed once per row.
    events = events.select("*", F.get_json_object("props", "$.k").try_cast("int").alias("_k"))
    return events.select(
        "event_id",
        *extra,
        F.expr(
            f"concat('sensor-', {_case_sql('event_type', SENSOR_KIND, SENSOR_KIND_OTHER)}, '-', "
            "CAST(user_id % 2 AS STRING)) AS sensor_id"
        ),
        F.expr("CAST(ts AS TIMESTAMP) AS timestamp"),
        F.expr(f"{_case_sql('event_type', AREA_TYPE, AREA_TYPE_OTHER)} AS area_type"),
        _parsed("CASE WHEN _k = 13 THEN CAST(NULL AS DOUBLE) ELSE value END", "pm2_5"),
        _parsed(
            "CASE WHEN _k = 17 THEN CAST(NULL AS DOUBLE) WHEN _k = 19 THEN CAST(-1.0 AS DOUBLE) "
            "ELSE value * CAST(1.5 AS DOUBLE) END",
            "pm10",
        ),
        _parsed("_k * CAST(1.3 AS DOUBLE) - CAST(55.0 AS DOUBLE)", "temperature"),
        _parsed("_k * CAST(1.1 AS DOUBLE) - CAST(2.0 AS DOUBLE)", "humidity"),
        _parsed("CAST(_k AS DOUBLE)", "battery_level"),
        _parsed("CAST(99.0 AS DOUBLE) - _k", "signal_strength"),
    )


def with_aqi(df: DataFrame) -> DataFrame:
    return df.withColumn("aqi", aqi_score("pm2_5", "pm10"))


def readings(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Canonical readings (event_id, sensor_id, timestamp, ..., aqi) of a data folder."""
    return with_aqi(project_events(table(spark, sf_dir, "events"), extra))


# The same projection as DuckDB text, for the oracle side.
READINGS_SQL = """
e AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r0 AS (
SELECT event_id,
       'sensor-' || CASE event_type WHEN 'click' THEN 'urban' WHEN 'view' THEN 'industrial'
                    WHEN 'purchase' THEN 'residential' WHEN 'signup' THEN 'bus' ELSE 'wearable' END
                 || '-' || CAST(user_id % 2 AS VARCHAR)                       AS sensor_id,
       ts                                                                     AS timestamp,
       CASE event_type WHEN 'click' THEN 'Urban' WHEN 'view' THEN 'Industrial'
                    WHEN 'purchase' THEN 'Residential' ELSE 'Mobile' END      AS area_type,
       CASE WHEN k = 13 THEN NULL ELSE value END                              AS pm2_5,
       CASE WHEN k = 17 THEN NULL WHEN k = 19 THEN -1.0e0 ELSE value * 1.5e0 END AS pm10,
       k * 1.3e0 - 55e0                                                       AS temperature,
       k * 1.1e0 - 2e0                                                        AS humidity,
       CAST(k AS DOUBLE)                                                      AS battery_level,
       99e0 - k                                                               AS signal_strength
FROM e)"""
