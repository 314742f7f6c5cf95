"""Device (smart) readings: a few invented sensors as exact inputs for fleet
and map statistics (A6, A7), device alerts (D7) and the battery/AQI classes
(F13, F14)."""

import json

from pyspark.sql import functions as F

from particula.functions import aqi_class, battery_band
from particula.operators import alerts as AL
from particula.operators import stats as ST
from particula.sources.parse import parse_device

# invented devices
SNAPSHOT = [
    ("smart-oakdale-101", "Oakdale", 10, 11, 30, 9.5, 71.0, 80.5),
    ("smart-elmfield-102", "Elmfield", 21, 22, 62, 24.0, 88.5, 77.0),
    ("smart-ashford-103", "Ashford", 33, 32, 48, 17.5, 59.5, 91.5),
    ("smart-pinehill-104", "Pinehill", 44, 43, 51, 19.0, 93.0, 66.0),
    ("smart-beechton-105", "Beechton", 55, 54, 39, 12.5, 80.0, 84.0),
    ("smart-willowby-106", "Willowby", 66, 65, 70, 31.5, 97.5, 58.5),
]


def _frame(spark, extra=()):
    rows = []
    for i, (sid, city, x, y, aqi, pm, bat, sig) in enumerate(list(SNAPSHOT) + list(extra)):
        rows.append(
            (json.dumps({"sensor_id": sid, "city": city, "coordinates": {"x": x, "y": y}, "air_quality_index": aqi,
                         "pm2_5": pm, "battery_level": bat, "signal_strength": sig,
                         "timestamp": f"2024-01-01T00:00:{i:02d}Z"}),)
        )
    return parse_device(spark.createDataFrame(rows, "value string"))


def test_fleet_and_map_stats_from_snapshot(spark):
    dev = _frame(spark)
    fleet = ST.fleet_snapshot(dev, aqi="air_quality_index").first()
    # mean AQI 50, mean battery 81.58 -> 82
    assert (fleet.total_sensors, fleet.avg_aqi, fleet.online_sensors, fleet.avg_battery) == (6, 50, 6, 82)
    m = ST.map_stats(dev, aqi="air_quality_index").first()
    assert (m.total_sensors, m.avg_aqi, m.cities_covered) == (6, 50, 6)


def test_device_alerts_and_classes_from_snapshot(spark):
    dev = _frame(spark, extra=[("smart-test-009", "Test", 1, 2, 160, 80.0, 25.0, 35.0)])
    alerts = AL.device_alerts(dev, aqi="air_quality_index").collect()
    assert sorted((a.sensor_id, a.alert_type, a.severity) for a in alerts) == [
        ("smart-test-009", "air_quality_alert", "critical"),
        ("smart-test-009", "battery_low", "medium"),
        ("smart-test-009", "signal_weak", "medium"),
    ]
    assert {a.message for a in alerts} == {"AQI is high: 160", "Battery is low: 25%", "Signal is weak: 35%"}
    cls = {r.sensor_id: (r.c, r.b) for r in dev.select("sensor_id", aqi_class("air_quality_index", 4).alias("c"),
                                                         battery_band("battery_level").alias("b")).collect()}
    assert cls["smart-willowby-106"] == ("aqi-moderate", "battery-high")
    assert cls["smart-ashford-103"] == ("aqi-good", "battery-medium")
    assert cls["smart-test-009"] == ("aqi-hazardous", "battery-low")


def test_coordinates_object_or_text(spark):
    rows = [('{"sensor_id":"a","coordinates":{"x":50,"y":40}}',), ('{"sensor_id":"b","coordinates":"{\\"x\\":50,\\"y\\":40}"}',)]
    out = parse_device(spark.createDataFrame(rows, "value string")).select("coordinates").collect()
    assert out[0].coordinates == out[1].coordinates == '{"x":50.0,"y":40.0}'
    back = spark.createDataFrame([(out[0].coordinates,)], "c string").select(F.get_json_object("c", "$.x")).first()[0]
    assert back == "50.0"
