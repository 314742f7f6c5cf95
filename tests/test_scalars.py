"""Golden boundary values of the scalar functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from particula import functions as PF


def py_aqi(pm25, pm10):
    """Independent re-statement of the banded formula for the golden table."""

    def sub(v, bands):
        for up, lo, hi, alo, ahi in bands:
            if up is None or v <= up:
                return int(((v - lo) / (hi - lo)) * (ahi - alo) + alo)

    from particula import constants as C

    return max(sub(pm25, C.PM25_BANDS), sub(pm10, C.PM10_BANDS))


PM25 = [0.0, 12.0, 12.05, 12.1, 35.4, 35.45, 55.4, 150.4, 250.4, 500.4, 600.0]
PM10 = [0.0, 54.0, 54.5, 154.0, 254.0, 354.0, 424.0, 604.0, 700.0, -1.0]


def test_aqi_score_golden(spark):
    rows = [(a, b) for a in PM25 for b in PM10]
    df = spark.createDataFrame(rows, "pm25 double, pm10 double")
    got = {(r[0], r[1]): r[2] for r in df.select("pm25", "pm10", PF.aqi_score("pm25", "pm10")).collect()}
    for a, b in rows:
        assert got[(a, b)] == py_aqi(a, b), (a, b)
    # known anchors: band edges
    assert got[(12.0, 0.0)] == 50 and got[(35.4, 0.0)] == 100 and got[(12.05, 0.0)] == 50
    assert got[(500.4, 0.0)] == 500 and got[(600.0, 0.0)] > 500


def test_aqi_null_and_nan(spark):
    df = spark.createDataFrame([(None, 10.0), (10.0, None), (float("nan"), 1.0)], "pm25 double, pm10 double")
    assert [r[0] for r in df.select(PF.aqi_score("pm25", "pm10")).collect()] == [None, None, None]


def test_aqi_monotone_within_bands(spark):
    vals = [i / 10 for i in range(0, 5000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = [r[0] for r in df.orderBy("v").select(PF.aqi_score("v", F.lit(0.0))).collect()]
    # monotone except at the gaps between bands (e.g. 12.0 -> 12.05)
    drops = [i for i in range(1, len(out)) if out[i] < out[i - 1]]
    assert len(drops) <= 5


AQIS = [0, 49, 50, 51, 99, 100, 101, 149, 150, 151, 199, 200, 201, 299, 300, 301, 500, 501, None]


def _classify(spark, fn):
    df = spark.createDataFrame([(a,) for a in AQIS], "aqi int")
    return {r[0]: r[1] for r in df.select("aqi", fn(F.col("aqi"))).collect()}


def test_category_upper_inclusive(spark):
    got = _classify(spark, PF.aqi_category)
    assert got[50] == "Good" and got[51] == "Moderate" and got[100] == "Moderate"
    assert got[150] == "Unhealthy for Sensitive Groups" and got[200] == "Unhealthy"
    assert got[300] == "Very Unhealthy" and got[301] == "Hazardous" and got[None] is None


def test_alert_level_lower_inclusive_and_differs(spark):
    six = _classify(spark, lambda c: PF.alert_level(c, 6))
    five = _classify(spark, lambda c: PF.alert_level(c, 5))
    assert six[49] == "Good" and six[50] == "Moderate" and six[100] == "Unhealthy for Sensitive Groups"
    assert six[300] == "Hazardous" and five[300] == "Very Unhealthy" and six[None] == "Good"
    cat = _classify(spark, PF.aqi_category)
    assert cat[50] != six[50] and cat[100] != six[100]


def test_message_risk_and_flags(spark):
    msg = _classify(spark, PF.alert_message)
    assert msg[50] == msg[0] == "Good air quality. No health concerns."
    assert msg[100].startswith("Moderate air quality.")
    has = _classify(spark, PF.has_alert)
    assert has[99] is False and has[100] is True and has[None] is None
    risk = _classify(spark, PF.health_risk_level)
    assert risk[49] == "No Risk" and risk[50] == "Low Risk" and risk[200] == "High Risk"
    c6 = _classify(spark, lambda c: PF.aqi_class(c, 6))
    c4 = _classify(spark, lambda c: PF.aqi_class(c, 4))
    assert c6[150] == "aqi-unhealthy-sensitive" and c4[150] == "aqi-unhealthy" and c4[151] == "aqi-hazardous"


def test_joint_label_and_risk_word(spark):
    rows = [(12.0, 54.0), (12.0, 55.0), (35.5, 10.0), (300.0, 10.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    lab = [r[0] for r in df.select(PF.joint_label("a", "b")).collect()]
    assert lab == ["Good", "Moderate", "Unhealthy for Sensitive Groups", "Hazardous", None]
    words = [r[0] for r in df.select(PF.risk_word(PF.joint_label("a", "b"))).collect()]
    assert words == ["Low", "Low", "Medium", "Extreme", "Unknown"]


def test_battery_band(spark):
    df = spark.createDataFrame([(70.0,), (69.9,), (30.0,), (29.9,)], "b double")
    assert [r[0] for r in df.select(PF.battery_band("b")).collect()] == [
        "battery-high",
        "battery-medium",
        "battery-medium",
        "battery-low",
    ]


def test_sensor_type_city_image(spark):
    rows = [("sensor-urban-1", None), ("x-busline-2", "Urban"), ("drone-7", None), ("abc", "Industrial zone"), ("q", None)]
    df = spark.createDataFrame(rows, "id string, area string")
    out = df.select(
        PF.sensor_type("id", "area").alias("t"),
        PF.canonical_location("id", "area").alias("loc"),
        PF.city_token(F.lit(None).cast("string"), "id").alias("city"),
        PF.image_path(PF.sensor_type("id", "area")).alias("img"),
    ).collect()
    assert [r.t for r in out] == ["Urban", "Urban", "Drone", "Industrial", "Unknown"]
    assert out[0].loc == "City Center" and out[4].loc == "Unknown"
    assert [r.city for r in out] == ["urban", "busline", "7", "Unknown", "Unknown"]
    assert out[2].img == "/images/sensor_drone.png"


def test_text_to_number_and_lenient(spark):
    rows = [("12.7",), ("12",), ("Good",), (" 3e2x",), ("",), (None,), ("-0.5 ppm",)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select(PF.text_to_number("s").alias("n"), PF.lenient_int("s").alias("i"), PF.lenient_double("s").alias("d")).collect()
    assert [r.n for r in out] == [12.7, 12.0, None, 300.0, None, None, -0.5]
    assert [r.i for r in out] == [None, 12, None, None, None, None, None]
    assert out[0].d == 12.7 and out[2].d is None


def test_time_band_weekend(spark):
    base = dt.datetime(2024, 1, 6, 0, 0)  # a Saturday
    rows = [(base + dt.timedelta(hours=h),) for h in (6, 7, 9, 10, 16, 17, 19, 21, 22, 23 + 24 * 2)]
    df = spark.createDataFrame(rows, "ts timestamp")
    out = df.select(PF.time_band("ts").alias("b"), PF.is_weekend("ts").alias("w")).collect()
    assert [r.b for r in out] == ["night", "rush", "rush", "regular", "regular", "rush", "rush", "regular", "night", "night"]
    assert out[0].w is True and out[-1].w is False


def test_ratio_score_and_ids(spark):
    df = spark.createDataFrame([(3.0, 2.0), (1.0, 0.0), (1.0, None)], "x double, a double")
    assert [r[0] for r in df.select(PF.ratio_score("x", "a")).collect()] == [0.5, None, None]
    ts = dt.datetime(2024, 1, 1, 0, 0, 7)
    d2 = spark.createDataFrame([("s1", ts)], "s string, t timestamp")
    r = d2.select(PF.legacy_alert_id("t", "s").alias("a"), PF.hashed_id(F.col("s"), F.col("t")).alias("h")).first()
    assert r.a == "alert_1704067207_s1" and len(r.h) == 64


def test_parse_timestamp_forms(spark):
    rows = [("2024-01-01T00:00:07.5Z",), ("2024-01-01T02:00:07.5+02:00",), ("2024-01-01 00:00:07.5",), ("nope",)]
    df = spark.createDataFrame(rows, "s string")
    out = [r[0] for r in df.select(PF.parse_timestamp(F.col("s"), default_now=False)).collect()]
    want = dt.datetime(2024, 1, 1, 0, 0, 7, 500000)
    assert out[:3] == [want, want, want] and out[3] is None
    now = df.select(PF.parse_timestamp(F.col("s"))).collect()[3][0]
    assert now is not None and not math.isnan(now.timestamp())


def test_json_point_round_trip(spark):
    df = spark.createDataFrame([(1.5, -2.0)], "x double, y double")
    j = df.select(PF.json_point(F.col("x"), F.col("y")).alias("j")).first().j
    assert j == '{"x":1.5,"y":-2.0}'
