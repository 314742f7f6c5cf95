"""Step 6: ML detectors (M1-M5, A12). Model outputs have no SQL form, so
these are registered without oracle text (rows-only check) and covered by
property tests. The paged series and the detector hook have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as AN
from ..operators import ml as ML
from ..operators.series import aligned_series
from .base import R, W_SENSOR, frame, register, with_readings

OUT = ["event_id", "sensor_id", "timestamp", "pm2_5", "pm10", "is_anomaly"]


@register("ml_random_forest", "M1 M4")
def ml_random_forest(spark, sf):
    return ML.detect(R(spark, sf), "random-forest", hours=None).select(*OUT, "prediction")


@register("ml_one_class", "M2 M4")
def ml_one_class(spark, sf):
    return ML.detect(R(spark, sf), "svm", hours=None).select(*OUT, "decision")


@register("ml_kmeans", "M3 M4")
def ml_kmeans(spark, sf):
    return ML.detect(R(spark, sf), "kmeans", hours=None).select(*OUT, "cluster")


@register("ml_response", "A12 J2 M3")
def ml_response(spark, sf):
    return ML.response(ML.detect(R(spark, sf), "kmeans", hours=None))


@register("ml_anomalies_only", "M1 J2")
def ml_anomalies_only(spark, sf):
    scored = ML.detect(R(spark, sf), "random-forest", hours=None)
    return scored.filter(F.col("is_anomaly")).select(*OUT)


@register("ml_lookback", "M4 M2 P8")
def ml_lookback(spark, sf):
    """The service's own call: one sensor, its last month before the newest reading."""
    scored = ML.detect(R(spark, sf), "svm", sensor_id="sensor-urban-0", hours=24.0 * 30)
    return scored.select(*OUT, "decision")


SERIES_PAGE = 500
_FLAGGED_SQL = (
    "SELECT *, coalesce(abs(pm2_5 - a5) > 2e0 * sd OR abs(aqi - q5) > 2e0 * sq, FALSE) AS flag FROM (SELECT *, "
    f"avg(pm2_5) OVER ({W_SENSOR} {frame(5)}) AS a5, avg(aqi) OVER ({W_SENSOR} {frame(5)}) AS q5, "
    "stddev_samp(pm2_5) OVER (PARTITION BY sensor_id) AS sd, stddev_samp(aqi) OVER (PARTITION BY sensor_id) AS sq FROM r)"
)


def _joined_sql(value: str) -> str:
    return f"string_agg(coalesce(CAST({value} AS VARCHAR), 'null'), ',' ORDER BY pos)"


@register(
    "analysis_series",
    "A12 D1",
    with_readings(
        f"SELECT sensor_id, pos // {SERIES_PAGE} AS page, count(*) AS readings, CAST(sum(CAST(flag AS INTEGER)) AS BIGINT) AS anomalies, "
        f"{_joined_sql('epoch_us(timestamp)')} AS timestamps, {_joined_sql('CAST(floor(pm2_5 * 1000) AS BIGINT)')} AS pm2_5, "
        f"{_joined_sql('CAST(floor(pm10 * 1000) AS BIGINT)')} AS pm10, {_joined_sql('score')} AS scores FROM ("
        "SELECT *, max(CAST(flag AS INTEGER)) OVER (PARTITION BY sensor_id, timestamp) AS score, "
        "row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp NULLS FIRST, event_id) - 1 AS pos "
        f"FROM ({_FLAGGED_SQL})) GROUP BY ALL"
    ),
)
def analysis_series(spark, sf):
    """The service's answer with its aligned arrays, printed as texts (values in thousandths, rounded down)."""
    pages = aligned_series(AN.anomaly_2sigma(R(spark, sf)), page_rows=SERIES_PAGE)

    def text(array, value):
        return F.array_join(F.transform(array, lambda x: value(x).cast("string")), ",", "null").alias(array)

    thousandths = lambda x: F.floor(x * 1000)
    return pages.select(
        "sensor_id", "page", "readings", "anomalies",
        text("timestamps", lambda x: F.unix_micros(x)), text("pm2_5", thousandths), text("pm10", thousandths), text("scores", lambda x: x),
    )


def trailing_ratio(pdf):
    """A user's detector: |pm2_5 - its mean over 5 minutes| over that mean, flagged above 0.5."""
    pdf = pdf.sort_values(["timestamp", "event_id"], ignore_index=True)
    mean = pdf.rolling("5min", on="timestamp", closed="both", min_periods=1)["pm2_5"].mean()
    out = pdf[["event_id", "sensor_id"]].assign(pm25_avg=mean, is_anomaly=((pdf["pm2_5"] - mean).abs() / mean > 0.5).astype(bool))
    return out[~pdf["is_context"]]


@register(
    "group_hook",
    "M5",
    with_readings(
        "SELECT event_id, sensor_id, pm25_avg, coalesce(abs(pm2_5 - pm25_avg) / nullif(pm25_avg, 0) > 0.5, FALSE) AS is_anomaly "
        f"FROM (SELECT *, avg(pm2_5) OVER ({W_SENSOR} {frame(5)}) AS pm25_avg FROM r)"
    ),
    means=["pm25_avg"],
)
def group_hook(spark, sf):
    cols = R(spark, sf).select("event_id", "sensor_id", "timestamp", "pm2_5")
    return ML.per_group(cols, trailing_ratio, "event_id long, sensor_id string, pm25_avg double, is_anomaly boolean", bucket_minutes=None, context_minutes=5.0)
