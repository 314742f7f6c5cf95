"""Alert derivation (D5-D8), alert projections and summaries.

Each reading is scanned once; tiers are `when` chains, device alerts are one
`explode` of up to three candidate structs, ids are content hashes so a
replayed reading yields the same alert id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import hashed_id, iso_utc


def _num_text_sql(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN 'null' WHEN {v} = floor({v}) AND abs({v}) < 1e15 "
        f"THEN CAST(CAST(floor({v}) AS BIGINT) AS STRING) ELSE CAST({v} AS STRING) END"
    )


def pollution_alerts(
    df: DataFrame, tiers: int = 3, pm25="pm2_5", pm10="pm10", aqi="aqi", js_numbers: bool | None = None
) -> DataFrame:
    """D5 (tiers=2, no is_active) / D6 (tiers=3, is_active=true).

    Missing PM counts as 0, missing AQI is reported as 'Unknown'. The
    three-tier (web) form prints integral numbers without '.0', the
    two-tier (consumer) form prints every double with its decimals.
    """
    from .quality import staged

    if js_numbers is None:
        js_numbers = tiers >= 3
    fmt = _num_text_sql if js_numbers else (lambda v: f"CAST({v} AS STRING)")
    p25 = f"coalesce(`{pm25}`, CAST(0.0 AS DOUBLE))"
    p10 = f"coalesce(`{pm10}`, CAST(0.0 AS DOUBLE))"
    aqi_txt = f"coalesce(CAST(`{aqi}` AS STRING), '{C.UNKNOWN}')"
    sev, typ, msg = [], [], []
    for severity, atype, prefix, lim25, lim10 in C.POLLUTION_TIERS[:tiers]:
        cond = f"{p25} > CAST({lim25!r} AS DOUBLE) OR {p10} > CAST({lim10!r} AS DOUBLE)"
        sev.append(f"WHEN {cond} THEN '{severity}'")
        typ.append(f"WHEN {cond} THEN '{atype}'")
        msg.append(
            f"WHEN {cond} THEN concat('{prefix}: PM2.5=', {fmt(p25)}, ', PM10=', {fmt(p10)}, ', AQI=', {aqi_txt})"
        )
    keep = [c for c in ("event_id",) if c in df.columns]
    # a row has an alert where it passes the lowest tier: a plain filter on measured columns, for the scan
    low25, low10 = (min(t[i] for t in C.POLLUTION_TIERS[:tiers]) for i in (3, 4))
    out = staged(df, (F.col(pm25) > low25) | (F.col(pm10) > low10), cols=(aqi,)).select(
        *keep,
        "sensor_id",
        "timestamp",
        F.expr(f"CASE {' '.join(sev)} END").alias("severity"),
        F.expr(f"CASE {' '.join(typ)} END").alias("alert_type"),
        F.expr(f"CASE {' '.join(msg)} END").alias("message"),
        F.expr(aqi_txt).alias("aqi_level"),
    )
    out = out.filter(F.col("severity").isNotNull()).withColumn(
        "alert_id", hashed_id(F.col("sensor_id"), F.unix_micros("timestamp"), F.col("alert_type"))
    )
    cols = keep + ["alert_id", "sensor_id", "timestamp", "alert_type", "severity", "message", "aqi_level"]
    out = out.select(*cols)
    if tiers >= 3:
        out = out.withColumn("is_active", F.lit(True))
    return out


def device_alerts(df: DataFrame, aqi="aqi", battery="battery_level", signal="signal_strength") -> DataFrame:
    """0-3 alerts per reading (high AQI, low battery, weak signal), one row each."""
    a, b, s = f"`{aqi}`", f"`{battery}`", f"`{signal}`"

    def cand(cond, atype, severity, message, bat_low, sig_weak):
        return (
            f"CASE WHEN {cond} THEN named_struct('alert_type', '{atype}', 'severity', {severity}, "
            f"'message', {message}, 'battery_low', {bat_low}, 'signal_weak', {sig_weak}) END"
        )

    cands = ", ".join(
        [
            cand(
                f"{a} > {C.DEVICE_AQI_ALERT}",
                "air_quality_alert",
                f"CASE WHEN {a} > {C.DEVICE_AQI_CRITICAL} THEN 'critical' ELSE 'high' END",
                f"concat('AQI is high: ', {_num_text_sql(f'CAST({a} AS DOUBLE)')})",
                "false",
                "false",
            ),
            cand(
                f"{b} < {C.DEVICE_BATTERY_LOW}",
                "battery_low",
                "'medium'",
                f"concat('Battery is low: ', {_num_text_sql(b)}, '%')",
                "true",
                "false",
            ),
            cand(
                f"{s} < {C.DEVICE_SIGNAL_WEAK}",
                "signal_weak",
                "'medium'",
                f"concat('Signal is weak: ', {_num_text_sql(s)}, '%')",
                "false",
                "true",
            ),
        ]
    )
    keep = [c for c in ("event_id", "sensor_id", "timestamp") if c in df.columns]
    out = df.select(*keep, F.expr(f"explode(array_compact(array({cands})))").alias("_a")).select(*keep, "_a.*")
    return out.withColumn(
        "alert_id", hashed_id(F.col("sensor_id"), F.unix_micros("timestamp"), F.col("alert_type"))
    )


def alert_defaults(df: DataFrame) -> DataFrame:
    """Pass-through with defaults (severity MEDIUM, aqi_level Unknown, '' texts, now)."""
    cols = set(df.columns)

    def c(name, default):
        base = F.col(name) if name in cols else F.lit(None)
        return F.coalesce(base, default).alias(name)

    keep = [x for x in ("event_id",) if x in cols]
    return df.select(
        *keep,
        F.col("alert_id"),
        c("sensor_id", F.lit("")),
        c("timestamp", F.current_timestamp()),
        c("alert_type", F.lit("")),
        c("severity", F.lit(C.ALERT_DEFAULT_SEVERITY)),
        c("message", F.lit("")),
        c("aqi_level", F.lit(C.ALERT_DEFAULT_AQI_LEVEL)),
    )


def alert_projection(df: DataFrame) -> DataFrame:
    """API shape of an alert."""
    return df.select(
        F.col("alert_id").alias("id"),
        F.col("alert_type").alias("type"),
        "severity",
        "message",
        "sensor_id",
        iso_utc("timestamp").alias("timestamp"),
        F.coalesce(F.nullif(F.col("aqi_level"), F.lit("")), F.lit(C.UNKNOWN)).alias("aqi_level"),
        F.lit("active").alias("status"),
    )


def latest_active(df: DataFrame, limit: int = C.ALERTS_DEFAULT_LIMIT) -> DataFrame:
    """Newest `limit` active alerts (top-k: per-partition partial top-k, then merge)."""
    act = df.filter(F.col("is_active") == F.lit(True))
    return act.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(limit)


def top_high(df: DataFrame, n: int = C.DIGEST_TOP_HIGH) -> DataFrame:
    """T4: first n HIGH alerts in arrival order."""
    return df.filter(F.col("severity") == "HIGH").orderBy("timestamp", "alert_id").limit(n)


def summary(df: DataFrame, top: int = C.DIGEST_TOP_HIGH) -> DataFrame:
    """Totals per severity and the '+N more' count, one global partial aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "HIGH").alias("high_alerts"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium_alerts"),
        F.count_if(F.col("severity") == "LOW").alias("low_alerts"),
    ).withColumn("more_high", F.greatest(F.col("high_alerts") - F.lit(top), F.lit(0)).cast("bigint"))


def digest_windows(df: DataFrame, minutes: int = C.DIGEST_COOLDOWN_MINUTES, top: int = C.DIGEST_TOP_HIGH):
    """ST7 batch approximation: one digest per tumbling cooldown window.

    The exact cooldown chain (a digest when an alert comes >= 30 min after the
    previous digest) is sequential and lives in the stream operator; in batch
    the windows are fixed 30-minute buckets (documented approximation).
    Returns (digests, top_high): per-window counts, and the first `top` HIGH
    alerts of each window via a per-window group limit.
    """
    from pyspark.sql import Window

    w = F.window("timestamp", f"{minutes} minutes")
    digests = (
        df.groupBy(w.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_alerts"),
            F.count_if(F.col("severity") == "HIGH").alias("high_alerts"),
            F.count_if(F.col("severity") == "MEDIUM").alias("medium_alerts"),
            F.count_if(F.col("severity") == "LOW").alias("low_alerts"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "total_alerts",
            "high_alerts",
            "medium_alerts",
            "low_alerts",
            F.greatest(F.col("high_alerts") - F.lit(top), F.lit(0)).cast("bigint").alias("more_high"),
            (F.col("high_alerts") > 0).alias("deliver"),
        )
    )
    high = df.filter(F.col("severity") == "HIGH").withColumn("window_start", w.start)
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy("timestamp", "alert_id"))
    top_high = high.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "window_start", "rank", "alert_id", "sensor_id", "alert_type"
    )
    return digests, top_high
