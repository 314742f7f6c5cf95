"""Rule-based anomaly scores (D1-D4) composed from window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import ratio_score
from .windows import Agg, last_rows, partition_stats, running, trailing

W1_AGGS = [
    Agg("pm25_5min_avg", "avg", "pm2_5", 5),
    Agg("pm25_15min_avg", "avg", "pm2_5", 15),
    Agg("pm25_1hour_avg", "avg", "pm2_5", 60),
    Agg("pm10_5min_avg", "avg", "pm10", 5),
    Agg("aqi_5min_avg", "avg", "aqi", 5),
    Agg("temp_5min_avg", "avg", "temperature", 5),
    Agg("humidity_5min_avg", "avg", "humidity", 5),
    Agg("pm25_5min_max", "max", "pm2_5", 5),
    Agg("pm25_5min_min", "min", "pm2_5", 5),
    Agg("aqi_5min_max", "max", "aqi", 5),
    Agg("aqi_5min_min", "min", "aqi", 5),
]


def trailing_features(df: DataFrame, **kw) -> DataFrame:
    """The streaming job's 5/15/60-minute trailing features."""
    return trailing(df, W1_AGGS, **kw)


def anomaly_2sigma(df: DataFrame, extra: list[Agg] | None = None, **kw) -> DataFrame:
    """|x - avg5| > 2 * whole-sensor sample stddev, for pm2_5 or aqi.

    `is_anomaly` is a three-valued OR; the score is the sum of both ratios when
    anomalous, else 0.0.
    """
    # whole-sensor spread first (partial aggregate of the input, size-checked
    # broadcast back), then one shuffle for the trailing frames
    withsd = partition_stats(df, [("_sd_pm25", F.stddev_samp("pm2_5")), ("_sd_aqi", F.stddev_samp("aqi"))])
    needed = [Agg("pm25_5min_avg", "avg", "pm2_5", 5), Agg("aqi_5min_avg", "avg", "aqi", 5)]
    more = [a for a in (extra or []) if a.out not in {n.out for n in needed}]
    feats = trailing(withsd, needed + more, measure=df, **kw)
    k = F.lit(C.SIGMA_FACTOR)
    pm25_anom = F.abs(F.col("pm2_5") - F.col("pm25_5min_avg")) > k * F.col("_sd_pm25")
    aqi_anom = F.abs(F.col("aqi") - F.col("aqi_5min_avg")) > k * F.col("_sd_aqi")
    out = (
        feats.withColumn("pm25_anomaly", pm25_anom)
        .withColumn("aqi_anomaly", aqi_anom)
        .withColumn("is_anomaly", F.col("pm25_anomaly") | F.col("aqi_anomaly"))
        .withColumn(
            "anomaly_score",
            F.when(
                F.col("is_anomaly"),
                ratio_score("pm2_5", "pm25_5min_avg") + ratio_score("aqi", "aqi_5min_avg"),
            ).otherwise(F.lit(0.0)),
        )
    )
    return out.drop("_sd_pm25", "_sd_aqi")


def anomaly_ratio5(df: DataFrame, **kw) -> DataFrame:
    """Ratio against the trailing 5-minute pm2_5 average, anomalous above 0.5."""
    feats = trailing(
        df,
        [Agg("pm25_5min_avg", "avg", "pm2_5", 5), Agg("pm25_15min_avg", "avg", "pm2_5", 15)],
        **kw,
    )
    score = ratio_score("pm2_5", "pm25_5min_avg")
    return feats.withColumn("anomaly_score", score).withColumn(
        "is_anomaly", F.col("anomaly_score") > F.lit(C.RATIO_ANOMALY_THRESHOLD)
    )


def anomaly_running(df: DataFrame, **kw) -> DataFrame:
    """D3: ratio against the running pm2_5 average, anomalous above 0.5."""
    feats = running(df, ["pm2_5"], **kw)
    score = ratio_score("pm2_5", "pm2_5_avg")
    return feats.withColumn("anomaly_score", score).withColumn(
        "is_anomaly", F.col("anomaly_score") > F.lit(C.RATIO_ANOMALY_THRESHOLD)
    )


LAST10_AGGS = [
    Agg("pm25_avg", "avg", "pm2_5"),
    Agg("pm10_avg", "avg", "pm10"),
    Agg("aqi_avg", "avg", "aqi"),
    Agg("pm25_max", "max", "pm2_5"),
    Agg("pm25_min", "min", "pm2_5"),
]


def last10_features(df: DataFrame, n: int = C.LAST_N_ROWS, **kw) -> DataFrame:
    """W5 + D4: last-n-readings features; score 0 with a single reading or avg <= 0."""
    feats = last_rows(df, LAST10_AGGS, n=n, with_count="_rows", **kw)
    score = F.when(
        (F.col("_rows") >= 2) & (F.col("pm25_avg") > 0), ratio_score("pm2_5", "pm25_avg")
    ).otherwise(F.lit(0.0))
    return (
        feats.withColumn("anomaly_score", score)
        .withColumn("is_anomaly", F.col("anomaly_score") > F.lit(C.RATIO_ANOMALY_THRESHOLD))
        .drop("_rows")
    )
