"""Canonical schemas: one flat readings schema that every wire form is parsed into."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _f(name, dtype):
    return StructField(name, dtype, True)


# Flat reading (canonical). `aqi` is the numeric index; a text label, when
# delivered, lands in `aqi_category`.
READINGS = StructType(
    [
        _f("sensor_id", StringType()),
        _f("timestamp", TimestampType()),
        _f("location_name", StringType()),
        _f("area_type", StringType()),
        _f("city", StringType()),
        _f("latitude", DoubleType()),
        _f("longitude", DoubleType()),
        _f("pm2_5", DoubleType()),
        _f("pm10", DoubleType()),
        _f("aqi", IntegerType()),
        _f("aqi_category", StringType()),
        _f("health_risk", StringType()),
        _f("visibility_meters", IntegerType()),
        _f("temperature", DoubleType()),
        _f("humidity", DoubleType()),
        _f("weather_condition", StringType()),
        _f("pressure_hpa", DoubleType()),
        _f("wind_speed", DoubleType()),
        _f("wind_direction", DoubleType()),
        _f("co2", DoubleType()),
        _f("no2", DoubleType()),
        _f("o3", DoubleType()),
        _f("battery_level", DoubleType()),
        _f("signal_strength", DoubleType()),
        _f("firmware_version", StringType()),
        _f("last_calibration", StringType()),
    ]
)

# Flat wire form: same fields, timestamp as ISO text, aqi possibly text.
FLAT_WIRE = StructType(
    [
        _f(f.name, StringType()) if f.name in ("timestamp", "aqi") else f
        for f in READINGS.fields
        if f.name != "aqi_category"
    ]
)

# Lenient wire form: everything text; numbers are coerced with try_cast.
ALL_STRING = StructType([_f(f.name, StringType()) for f in FLAT_WIRE.fields])

# Nested wire form.
NESTED_WIRE = StructType(
    [
        _f("sensor_id", StringType()),
        _f("timestamp", StringType()),
        _f(
            "location",
            StructType(
                [
                    _f("lat", DoubleType()),
                    _f("lon", DoubleType()),
                    _f("name", StringType()),
                    _f("area_type", StringType()),
                    _f("city", StringType()),
                ]
            ),
        ),
        _f(
            "air_quality_data",
            StructType(
                [
                    _f("pm2_5", DoubleType()),
                    _f("pm10", DoubleType()),
                    # text on the wire: a number or a category label
                    _f("aqi", StringType()),
                    _f("health_risk", StringType()),
                    _f("visibility_meters", IntegerType()),
                    _f("co2", DoubleType()),
                    _f("no2", DoubleType()),
                    _f("o3", DoubleType()),
                ]
            ),
        ),
        _f(
            "environmental_data",
            StructType(
                [
                    _f("temperature_celsius", DoubleType()),
                    _f("humidity_percent", DoubleType()),
                    _f("weather_condition", StringType()),
                    _f("pressure_hpa", DoubleType()),
                    _f("wind_speed", DoubleType()),
                    _f("wind_direction", DoubleType()),
                ]
            ),
        ),
        _f(
            "sensor_metadata",
            StructType(
                [
                    _f("battery_level", DoubleType()),
                    _f("signal_strength", DoubleType()),
                    _f("firmware_version", StringType()),
                    _f("last_calibration", StringType()),
                ]
            ),
        ),
    ]
)

# Device ("smart") reading.
DEVICE = StructType(
    [
        _f("sensor_id", StringType()),
        _f("timestamp", TimestampType()),
        _f("air_quality_index", DoubleType()),
        _f("pm2_5", DoubleType()),
        _f("pm10", DoubleType()),
        _f("temperature", DoubleType()),
        _f("humidity", DoubleType()),
        _f("pressure", DoubleType()),
        _f("wind_speed", DoubleType()),
        _f("wind_direction", DoubleType()),
        _f("sensor_type", StringType()),
        _f("location", StringType()),
        _f("category", StringType()),
        _f("battery_level", DoubleType()),
        _f("signal_strength", DoubleType()),
        _f("city", StringType()),
        _f("coordinates", StringType()),
    ]
)

ALERTS = StructType(
    [
        _f("alert_id", StringType()),
        _f("sensor_id", StringType()),
        _f("timestamp", TimestampType()),
        _f("alert_type", StringType()),
        _f("severity", StringType()),
        _f("message", StringType()),
        _f("aqi_level", StringType()),
        _f("is_active", BooleanType()),
    ]
)

DEVICE_ALERTS = StructType(
    [
        _f("alert_id", StringType()),
        _f("sensor_id", StringType()),
        _f("timestamp", TimestampType()),
        _f("alert_type", StringType()),
        _f("severity", StringType()),
        _f("message", StringType()),
        _f("battery_low", BooleanType()),
        _f("signal_weak", BooleanType()),
    ]
)

# Message-bus envelope (the Kafka source shape).
ENVELOPE = StructType(
    [
        _f("key", StringType()),
        _f("value", StringType()),
        _f("topic", StringType()),
        _f("timestamp", TimestampType()),
    ]
)
