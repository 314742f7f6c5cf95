"""Wire-format parsing (S4-S6, S11, P1, P2): one parser for flat and nested JSON.

Everything is `from_json` / `get_json_object` / `try_cast` on the JVM side;
malformed records are kept with a `_corrupt` flag instead of failing a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import constants as C
from .. import schemas as S
from ..functions.text import lenient_double, lenient_int, parse_timestamp

# Nested path for every canonical column that the nested wire form carries.
NESTED_PATHS = {
    "latitude": "location.lat",
    "longitude": "location.lon",
    "location_name": "location.name",
    "area_type": "location.area_type",
    "city": "location.city",
    "pm2_5": "air_quality_data.pm2_5",
    "pm10": "air_quality_data.pm10",
    "aqi": "air_quality_data.aqi",
    "health_risk": "air_quality_data.health_risk",
    "visibility_meters": "air_quality_data.visibility_meters",
    "co2": "air_quality_data.co2",
    "no2": "air_quality_data.no2",
    "o3": "air_quality_data.o3",
    "temperature": "environmental_data.temperature_celsius",
    "humidity": "environmental_data.humidity_percent",
    "weather_condition": "environmental_data.weather_condition",
    "pressure_hpa": "environmental_data.pressure_hpa",
    "wind_speed": "environmental_data.wind_speed",
    "wind_direction": "environmental_data.wind_direction",
    "battery_level": "sensor_metadata.battery_level",
    "signal_strength": "sensor_metadata.signal_strength",
    "firmware_version": "sensor_metadata.firmware_version",
    "last_calibration": "sensor_metadata.last_calibration",
}

# Both shapes in one schema: nested structs next to the flat columns, all
# leaves as text so a bad value nulls one field, never the record.
_leaf_names = [f.name for f in S.FLAT_WIRE.fields] + ["temperature_celsius", "humidity_percent"]
WIRE_ANY = StructType(
    [StructField(n, StringType(), True) for n in _leaf_names]
    + [
        StructField(f.name, StructType([StructField(x.name, StringType(), True) for x in f.dataType.fields]), True)
        for f in S.NESTED_WIRE.fields
        if isinstance(f.dataType, StructType)
    ]
)

_NUMERIC_INT = {"aqi", "visibility_meters"}


def _typed(name: str, text: Column) -> Column:
    dtype = S.READINGS[name].dataType.simpleString()
    if name == "timestamp":
        return parse_timestamp(text, default_now=False)
    if name in _NUMERIC_INT:
        # numbers given as JSON numbers or integer text; '12.7' or labels -> NULL
        as_num = lenient_double(text)
        return F.when(as_num.isNotNull() & (as_num == F.floor(as_num)), as_num).try_cast("int")
    if dtype == "double":
        return lenient_double(text)
    return text


def parse_readings(df: DataFrame, value: str = "value", keep: tuple[str, ...] = (), arrival: str | None = None) -> DataFrame:
    """Any wire form (flat, short, minimal, nested) -> canonical READINGS columns.

    Missing columns become NULL; a missing time becomes that of `arrival`, a
    column of `df`, else now, when `arrival` is given (P2): the arrival time
    keeps a replayed message on its key. `aqi` that is a label goes to `aqi_category`;
    `temperature_celsius`/`humidity_percent` are accepted as aliases.
    """
    came = F.coalesce(F.col(arrival).cast("timestamp"), F.current_timestamp()) if arrival else F.lit(None).cast("timestamp")
    p = df.select(*keep, F.from_json(F.col(value), WIRE_ANY).alias("_w"), F.col(value).alias("_raw"), came.alias("_came"))
    cols = []
    for f in S.READINGS.fields:
        n = f.name
        if n == "aqi_category":
            continue
        cands = []
        if n in NESTED_PATHS:
            cands.append(F.col(f"_w.{NESTED_PATHS[n]}"))
        cands.append(F.col(f"_w.{n}"))
        if n == "temperature":
            cands.append(F.col("_w.temperature_celsius"))
        if n == "humidity":
            cands.append(F.col("_w.humidity_percent"))
        text = F.coalesce(*cands) if len(cands) > 1 else cands[0]
        typed = _typed(n, text)
        cols.append((F.coalesce(typed, F.col("_came")) if n == "timestamp" else typed).alias(n))
    aqi_text = F.coalesce(F.col(f"_w.{NESTED_PATHS['aqi']}"), F.col("_w.aqi"))
    label = F.when(lenient_double(aqi_text).isNull(), aqi_text)
    corrupt = F.col("_w").isNull() | F.col("_raw").isNull() | ~F.trim(F.col("_raw")).startswith("{")
    out = p.select(*keep, *cols, label.alias("aqi_category"), corrupt.alias("_corrupt"))
    return out


def parse_nested(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Strict nested schema, expanded as `data.*`."""
    return df.select(*keep, F.from_json(F.col(value), S.NESTED_WIRE).alias("data")).select(*keep, "data.*")


def flatten_nested(df: DataFrame, processed_at: bool = False) -> DataFrame:
    """Nested reading -> flat canonical columns + processing metadata
    (`processing_version`, and `processed_at` = now when asked for)."""
    cols = [F.col("sensor_id"), parse_timestamp(F.col("timestamp"), default_now=False).alias("timestamp")]
    for n, path in NESTED_PATHS.items():
        c = F.col(path)
        if n == "aqi":
            c = lenient_int(c)
        cols.append(c.alias(n))
    keep = [c for c in df.columns if c not in ("sensor_id", "timestamp") and c not in {p.split(".")[0] for p in NESTED_PATHS.values()}]
    out = df.select(*keep, *cols).withColumn("processing_version", F.lit(C.PROCESSING_VERSION))
    return out.withColumn("processed_at", F.current_timestamp()) if processed_at else out


def parse_flat(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat typed schema; timestamp text parsed, aqi integer."""
    p = df.select(*keep, F.from_json(F.col(value), S.FLAT_WIRE).alias("d")).select(*keep, "d.*")
    return p.withColumn("timestamp", parse_timestamp(F.col("timestamp"), default_now=False)).withColumn(
        "aqi", lenient_int(F.col("aqi"))
    )


def lenient_cast(df: DataFrame) -> DataFrame:
    """All-text record -> canonical types; bad values become NULL, never an error."""
    out = []
    for f in df.schema.fields:
        n = f.name
        if n in S.READINGS.fieldNames() and n not in ("sensor_id", "timestamp"):
            dtype = S.READINGS[n].dataType.simpleString()
            if n in _NUMERIC_INT:
                out.append(lenient_int(F.col(n)).alias(n))
            elif dtype == "double":
                out.append(lenient_double(F.col(n)).alias(n))
            else:
                out.append(F.col(n))
        else:
            out.append(F.col(n))
    return df.select(*out)


def to_nested_json(df: DataFrame) -> Column:
    """Reading -> nested wire JSON text (used to exercise S4/P1 on table data)."""
    groups: dict[str, list[Column]] = {}
    for n, path in NESTED_PATHS.items():
        top, leaf = path.split(".")
        if n in df.columns:
            groups.setdefault(top, []).append(F.col(n).alias(leaf))
    parts = [F.col("sensor_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")]
    parts += [F.struct(*v).alias(k) for k, v in groups.items()]
    return F.to_json(F.struct(*parts))


def to_envelope(df: DataFrame, topic, nested: bool = False) -> DataFrame:
    """Message-bus record keyed by sensor with the reading as JSON text."""
    t = F.lit(topic) if isinstance(topic, str) else topic
    value = to_nested_json(df) if nested else F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    extra = [c for c in ("event_id",) if c in df.columns]
    return df.select(
        *extra,
        F.col("sensor_id").alias("key"),
        value.alias("value"),
        t.alias("topic"),
        F.col("timestamp").alias("timestamp"),
    )


def parse_device(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Device ("smart") reading JSON -> DEVICE columns. `coordinates` may come
    as an object or as JSON text; both become the same JSON text (F19)."""
    schema = StructType(
        [StructField(f.name, StringType(), True) if f.name in ("timestamp", "coordinates") else f for f in S.DEVICE.fields]
    )
    p = df.select(*keep, F.from_json(F.col(value), schema).alias("d"), F.get_json_object(F.col(value), "$.coordinates").alias("_xy"))
    cols = []
    for f in S.DEVICE.fields:
        if f.name == "timestamp":
            cols.append(parse_timestamp(F.col("d.timestamp")).alias("timestamp"))
        elif f.name == "coordinates":
            xy = F.from_json(F.col("_xy"), "x double, y double")
            cols.append(F.when(xy.isNotNull(), F.to_json(xy)).alias("coordinates"))
        else:
            cols.append(F.col(f"d.{f.name}").alias(f.name))
    return p.select(*keep, *cols)
