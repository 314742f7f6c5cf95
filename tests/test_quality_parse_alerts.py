"""Quality rules, wire parsing and alert derivation: properties and edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from particula.operators import alerts as AL
from particula.operators import quality as Q
from particula.operators import sinks as SK
from particula.sources import parse as PS
from particula.sources.readings import readings

from .conftest import SF_SMALL

EDGE = [
    # pm25, pm10, aqi, temp, hum
    (0.0, 0.0, 0, -50.0, 0.0),
    (None, 10.0, 10, 20.0, 50.0),
    (-0.1, 10.0, 10, 20.0, 50.0),
    (10.0, 10.0, 501, 61.0, 101.0),
    (10.0, 10.0, 50, -51.0, -1.0),
    (10.0, 10.0, None, None, None),
    (201.0, 10.0, 50, 20.0, 50.0),
    (10.0, 10.0, 50, -20.0, 5.0),
    (10.0, 10.0, 50, 50.0, 95.0),
    (10.0, 10.0, 50, 50.1, 95.0),
]


def _edge(spark):
    return spark.createDataFrame(
        [(i, f"sensor-urban-{i % 2}", dt.datetime(2024, 1, 1, 0, i), *r) for i, r in enumerate(EDGE)],
        "event_id long, sensor_id string, timestamp timestamp, pm2_5 double, pm10 double, aqi int, "
        "temperature double, humidity double",
    )


def test_validity_never_null_and_matches_errors(spark):
    v = Q.validate(_edge(spark)).collect()
    assert all(r.is_valid is not None for r in v)
    assert all(r.is_valid == (r.validation_errors == "") for r in v)
    assert v[0].is_valid and not v[1].is_valid
    assert v[3].validation_errors == "AQI too high, Temperature too high, Humidity too high"
    assert v[5].validation_errors == "AQI missing, Temperature missing, Humidity missing"


def test_quality_filter_subset_of_valid(spark):
    df = _edge(spark)
    valid = {r.event_id for r in df.filter(Q.is_valid()).collect()}
    kept = {r.event_id for r in Q.quality_filter(df).collect()}
    assert kept <= valid
    assert kept == {7, 8}


def test_first_error_order_and_split(spark):
    df = _edge(spark)
    out = {r.event_id: r.c.reason for r in df.select("event_id", Q.first_error(df).alias("c")).collect()}
    assert out[1] == "Missing field: pm2_5" and out[5] == "Missing field: aqi"
    assert out[2] == "Invalid PM2.5: -0.1" and out[3] == "Invalid AQI: 501" and out[6] == "Invalid PM2.5: 201.0"
    valid, bad = Q.split_valid(df)
    assert valid.count() + bad.count() == df.count()
    ok = {r.event_id for r in df.filter(Q.first_error_ok()).collect()}
    assert ok == {r.event_id for r in valid.collect()}


def test_parse_any_wire_shape(spark):
    rows = [
        ('{"sensor_id":"a","timestamp":"2024-01-01T00:00:00Z","pm2_5":12.5,"pm10":"30","aqi":52,'
         '"temperature":20.5,"humidity":40}',),
        ('{"sensor_id":"b","timestamp":"2024-01-01T01:00:00+01:00","location":{"lat":1.5,"name":"X"},'
         '"air_quality_data":{"pm2_5":7,"pm10":9,"aqi":"Good"},'
         '"environmental_data":{"temperature_celsius":3.5,"humidity_percent":80}}',),
        ('{"sensor_id":"c","timestamp":"2024-01-01T00:00:00","pm2_5":1,"aqi":"12.7"}',),
        ("not json",),
        ('{"sensor_id":"d"}',),
    ]
    df = spark.createDataFrame(rows, "value string")
    out = PS.parse_readings(df).collect()
    a, b, c, bad, d = out
    assert a.pm10 == 30.0 and a.aqi == 52 and a.temperature == 20.5 and a.humidity == 40.0
    assert b.latitude == 1.5 and b.location_name == "X" and b.temperature == 3.5 and b.humidity == 80.0
    assert b.aqi is None and b.aqi_category == "Good"
    assert b.timestamp == a.timestamp  # +01:00 offset and Z agree
    assert c.aqi is None and c.pm10 is None  # '12.7' is not an integer; missing -> NULL
    assert bad._corrupt and not a._corrupt
    assert d.sensor_id == "d" and d.timestamp is None


def test_alert_tiers_superset(spark):
    r = readings(spark, SF_SMALL)
    two = {x.event_id for x in AL.pollution_alerts(r, tiers=2).collect()}
    three = AL.pollution_alerts(r, tiers=3).collect()
    assert two <= {x.event_id for x in three}
    assert all(x.is_active for x in three)
    assert {x.severity for x in three} <= {"HIGH", "MEDIUM", "LOW"}


def test_device_alerts_one_row_per_alert(spark):
    df = spark.createDataFrame(
        [("s", dt.datetime(2024, 1, 1), 160, 10.0, 20.0), ("t", dt.datetime(2024, 1, 1), 50, 90.0, 90.0)],
        "sensor_id string, timestamp timestamp, aqi int, battery_level double, signal_strength double",
    )
    out = AL.device_alerts(df).orderBy("alert_type").collect()
    assert [(x.alert_type, x.severity) for x in out] == [
        ("air_quality_alert", "critical"),
        ("battery_low", "medium"),
        ("signal_weak", "medium"),
    ]
    assert out[1].message == "Battery is low: 10%" and out[1].battery_low and not out[1].signal_weak
    assert len({x.alert_id for x in out}) == 3


def test_keep_last_one_row_per_key(spark):
    df = spark.createDataFrame(
        [("s", dt.datetime(2024, 1, 1), 1.0, 1), ("s", dt.datetime(2024, 1, 1), 2.0, 2), ("t", dt.datetime(2024, 1, 1), 3.0, 1)],
        "sensor_id string, timestamp timestamp, pm2_5 double, _ingest int",
    )
    out = {r.sensor_id: r.pm2_5 for r in SK.keep_last(df).collect()}
    assert out == {"s": 2.0, "t": 3.0}


def test_align_missing_columns_null_and_now(spark):
    df = spark.createDataFrame([("s", None, 1.0)], "sensor_id string, timestamp timestamp, pm2_5 double")
    out = SK.align(df).first()
    assert out.pm10 is None and out.timestamp is not None and out.aqi is None


def test_missing_wire_time_becomes_the_arrival_time(spark):
    import datetime as dt

    from particula.sources.parse import parse_readings

    rows = [('{"sensor_id":"a","pm2_5":1}', "2024-01-01 05:00:00"), ('{"sensor_id":"b","timestamp":"2024-02-02T01:02:03Z"}', "2024-01-01 05:00:00"), ('{"sensor_id":"c"}', None)]
    env = spark.createDataFrame(rows, "value string, t string").selectExpr("value", "CAST(t AS TIMESTAMP) AS timestamp")
    got = {r.sensor_id: r.timestamp for r in parse_readings(env, arrival="timestamp").collect()}
    assert got["a"] == dt.datetime(2024, 1, 1, 5) and got["b"] == dt.datetime(2024, 2, 2, 1, 2, 3) and got["c"] is not None
    assert {r.timestamp for r in parse_readings(env.limit(1)).collect()} == {None}
