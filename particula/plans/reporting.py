"""Step 4: fleet/window statistics (A2-A7, A9-A11), catalog and lookups
(F11, F12, F15, F17-F21, J3-J5), coercion and sinks as queries (S6, S8, S10, T6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as FT
from ..functions.numeric import round_mean_sql
from ..operators import alerts as AL
from ..operators import lookup as LK
from ..operators import quality as Q
from ..operators import panes as SP
from ..operators import sinks as SK
from ..operators import stats as ST
from ..operators import windows as WN
from ..operators.newest import extreme_row
from ..operators.snapshots import Snapshots
from ..session import scratch_path
from ..sources import parse as PS
from ..sources.readings import AREA_TYPE
from .alerting import A3_CTE, alerts3
from .base import R, register, with_readings
from .core import OUTLIER_SQL, READING_COLS, RC, VALID_SQL
from .features import D1_SQL, LATEST_SQL, anomaly_frame

US_MIN = C.MICROS_PER_MINUTE


def _bucket_sql(minutes: int) -> str:
    w = minutes * US_MIN
    return f"make_timestamp(epoch_us(timestamp) - (epoch_us(timestamp) % {w}))"


@register(
    "system_stats",
    "A2 A11 P9",
    with_readings(
        "SELECT count(DISTINCT sensor_id) AS sensor_count, count(*) AS total_records, "
        f"avg(aqi) AS average_aqi, (SELECT count(*) FROM a3 WHERE is_active) AS active_alerts FROM r",
        A3_CTE,
    ),
    means=["average_aqi"],
)
def system_stats(spark, sf):
    return ST.system_stats(R(spark, sf), alerts3(spark, sf))


@register(
    "sensor_statistics",
    "A3",
    with_readings(
        f"SELECT sensor_id, count(*) AS total_readings, {round_mean_sql('avg(aqi)', 1)} AS avg_aqi, "
        "round(CAST(max(aqi) AS DOUBLE), 1) AS max_aqi, round(CAST(min(aqi) AS DOUBLE), 1) AS min_aqi, "
        f"{round_mean_sql('avg(pm2_5)', 2)} AS avg_pm2_5, "
        "arg_max(battery_level, (epoch_us(timestamp), event_id)) AS current_battery, "
        "arg_max(signal_strength, (epoch_us(timestamp), event_id)) AS current_signal FROM r GROUP BY sensor_id"
    ),
)
def sensor_statistics(spark, sf):
    return ST.sensor_statistics(R(spark, sf))


@register(
    "smart_stats_5m",
    "A4",
    with_readings(
        f"SELECT sensor_id, {_bucket_sql(5)} AS window_start, {_bucket_sql(5)} + INTERVAL 5 MINUTE AS window_end, "
        f"count(*) AS total_readings, avg(aqi) AS avg_aqi, max(CAST(aqi AS DOUBLE)) AS max_aqi, "
        f"min(CAST(aqi AS DOUBLE)) AS min_aqi, avg(pm2_5) AS avg_pm2_5, max(pm2_5) AS max_pm2_5, "
        f"min(pm2_5) AS min_pm2_5, avg(battery_level) AS avg_battery, "
        f"avg(signal_strength) AS avg_signal FROM r GROUP BY ALL"
    ),
    means=["avg_aqi", "avg_pm2_5", "avg_battery", "avg_signal"],
)
def smart_stats_5m(spark, sf):
    return ST.smart_stats(R(spark, sf), "5 minutes")


def _window_sql(minutes: int) -> str:
    return (
        f"SELECT sensor_id, {_bucket_sql(minutes)} AS window_start, {_bucket_sql(minutes)} + INTERVAL {minutes} MINUTE "
        f"AS window_end, avg(pm2_5) AS avg_pm2_5, max(pm2_5) AS max_pm2_5, min(pm2_5) AS min_pm2_5, "
        f"avg(pm10) AS avg_pm10, max(pm10) AS max_pm10, min(pm10) AS min_pm10, count(*) AS total_readings "
        "FROM r GROUP BY ALL"
    )


def _make_window_query(minutes: int):
    @register(f"window_aggregates_{minutes}m", "A5 ST2", with_readings(_window_sql(minutes)), means=["avg_pm2_5", "avg_pm10"])
    def q(spark, sf):
        return ST.window_aggregates(R(spark, sf), f"{minutes} minutes")

    return q


for _m in (5, 15, 60):
    _make_window_query(_m)


@register(
    "sliding_aggregates",
    "A5 ST2",
    with_readings(
        f"SELECT sensor_id, make_timestamp(s) AS window_start, make_timestamp(s + {15 * US_MIN}) AS window_end, "
        f"avg(pm2_5) AS avg_pm2_5, max(pm2_5) AS max_pm2_5, min(pm2_5) AS min_pm2_5, "
        f"avg(pm10) AS avg_pm10, max(pm10) AS max_pm10, min(pm10) AS min_pm10, count(*) AS total_readings "
        f"FROM (SELECT *, epoch_us(timestamp) - (epoch_us(timestamp) % {5 * US_MIN}) - k * {5 * US_MIN} AS s "
        "FROM r, range(0, 3) t(k)) GROUP BY ALL"
    ),
    means=["avg_pm2_5", "avg_pm10"],
)
def sliding_aggregates(spark, sf):
    return ST.window_aggregates(R(spark, sf), "15 minutes", "5 minutes")


def _stored_panes(spark, sf):
    """Readings upserted in two commits, the second one with late rows of every hour, and the panes kept up after each."""
    folder = scratch_path(spark, f"panes-{uuid.uuid4().hex}")
    stored = Snapshots(spark, f"{folder}/readings", key=("sensor_id", "timestamp", "event_id"), slots=("date",))
    panes = SP.store(spark, f"{folder}/panes", slots=("date",))
    rows = R(spark, sf).select(*READING_COLS)
    for part in ("event_id % 5 <> 0", "event_id % 5 = 0"):
        stored.upsert(rows.filter(part))
        SP.refresh(stored, panes)
    return panes.read()


@register("stored_window_aggregates", "A5 S8", with_readings(_window_sql(15)), means=["avg_pm2_5", "avg_pm10"])
def stored_window_aggregates(spark, sf):
    return SP.window_aggregates(_stored_panes(spark, sf), 15)


@register(
    "stored_system_stats",
    "A2 A11 S8",
    with_readings(
        "SELECT count(DISTINCT sensor_id) AS sensor_count, count(*) AS total_records, "
        "avg(aqi) AS average_aqi, (SELECT count(*) FROM a3 WHERE is_active) AS active_alerts FROM r",
        A3_CTE,
    ),
    means=["average_aqi"],
)
def stored_system_stats(spark, sf):
    return SP.system_stats(_stored_panes(spark, sf), alerts3(spark, sf))


def _latest(spark, sf):
    return WN.latest(R(spark, sf).select(*READING_COLS))


@register(
    "fleet_snapshot",
    "A6 W6",
    with_readings(
        f"SELECT count(*) AS total_sensors, CAST(floor(avg(aqi) + 0.5) AS BIGINT) AS avg_aqi, "
        "count(*) FILTER (WHERE battery_level > 0) AS online_sensors, "
        f"CAST(floor(avg(battery_level) + 0.5) AS BIGINT) AS avg_battery FROM lt",
        f"lt AS ({LATEST_SQL})",
    ),
)
def fleet_snapshot(spark, sf):
    return ST.fleet_snapshot(_latest(spark, sf))


CITY_SQL = "coalesce(nullif(split_part(sensor_id, '-', 2), ''), 'Unknown')"


@register(
    "map_stats",
    "A7 F15 W6",
    with_readings(
        f"SELECT count(*) AS total_sensors, CAST(floor(avg(aqi) + 0.5) AS BIGINT) AS avg_aqi, "
        f"count(DISTINCT {CITY_SQL}) AS cities_covered FROM lt",
        f"lt AS ({LATEST_SQL})",
    ),
)
def map_stats(spark, sf):
    return ST.map_stats(_latest(spark, sf))


@register(
    "batch_counters",
    "A9",
    with_readings(
        f"SELECT count(*) AS total_records, count(*) FILTER (WHERE {VALID_SQL}) AS valid_records, "
        f"count(*) FILTER (WHERE NOT {VALID_SQL}) AS invalid_records, "
        f"count(*) FILTER (WHERE aqi >= {C.HAS_ALERT_AQI}) AS alert_records, "
        "(SELECT count(*) FROM d1 WHERE is_anomaly) AS anomaly_records FROM r",
        f"d1 AS ({D1_SQL})",
    ),
)
def batch_counters(spark, sf):
    return ST.batch_counters(R(spark, sf), anomaly_frame(spark, sf))


BAND_SQL = (
    "CASE WHEN hour(timestamp) BETWEEN 7 AND 9 OR hour(timestamp) BETWEEN 17 AND 19 THEN 'rush' "
    "WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 6 THEN 'night' ELSE 'regular' END"
)


@register(
    "band_profile",
    "A10 F21",
    with_readings(
        f"SELECT {BAND_SQL} AS time_band, isodow(timestamp) >= 6 AS is_weekend, count(*) AS readings, "
        f"avg(pm2_5) AS avg_pm2_5, avg(pm10) AS avg_pm10, avg(aqi) AS avg_aqi "
        "FROM r GROUP BY ALL"
    ),
    means=["avg_pm2_5", "avg_pm10", "avg_aqi"],
)
def band_profile(spark, sf):
    return ST.band_profile(R(spark, sf))


@register("time_band", "F21", with_readings(f"SELECT event_id, {BAND_SQL} AS time_band, isodow(timestamp) >= 6 AS is_weekend FROM r"))
def time_band(spark, sf):
    return R(spark, sf).select(
        "event_id", FT.time_band("timestamp").alias("time_band"), FT.is_weekend("timestamp").alias("is_weekend")
    )


@register("sensor_ids", "A11", with_readings("SELECT DISTINCT sensor_id FROM r"))
def sensor_ids(spark, sf):
    return ST.sensor_ids(R(spark, sf))


def _type_sql(id_col="sensor_id", area="area_type", pick=2):
    whens = []
    for sub, on_area, typ, place in C.SENSOR_TYPES:
        cond = f"contains(lower({id_col}), '{sub}')"
        if on_area:
            cond += f" OR contains(lower(coalesce({area}, '')), '{sub}')"
        val = typ if pick == 2 else place
        whens.append(f"WHEN {cond} THEN '{val}'")
    return f"CASE {' '.join(whens)} ELSE 'Unknown' END"


@register(
    "sensor_catalog",
    "F11 F12 J1 W6",
    with_readings(
        f"SELECT sensor_id AS id, {_type_sql()} AS type, {_type_sql(pick=3)} AS location_name, "
        f"'/images/sensor_' || lower({_type_sql()}) || '.png' AS img FROM lt",
        f"lt AS ({LATEST_SQL})",
    ),
)
def sensor_catalog(spark, sf):
    return LK.sensor_catalog(_latest(spark, sf))


@register(
    "image_path",
    "F12 F11",
    with_readings(
        f"SELECT event_id, {_type_sql()} AS sensor_type, '/images/sensor_' || lower({_type_sql()}) || '.png' AS img FROM r"
    ),
)
def image_path(spark, sf):
    st = FT.sensor_type("sensor_id", "area_type")
    return R(spark, sf).select("event_id", st.alias("sensor_type"), FT.image_path(st).alias("img"))


@register("city_token", "F15", with_readings(f"SELECT event_id, sensor_id, {CITY_SQL} AS city FROM r"))
def city_token(spark, sf):
    return R(spark, sf).select("event_id", "sensor_id", FT.city_token(F.lit(None).cast("string"), "sensor_id").alias("city"))


@register(
    "rounding",
    "F17",
    with_readings("SELECT event_id, round(pm10, 1) AS pm10_1dp, round(pm2_5 / 7e0, 2) AS pm25_2dp FROM r"),
)
def rounding(spark, sf):
    return R(spark, sf).select(
        "event_id", F.round("pm10", 1).alias("pm10_1dp"), F.round(F.col("pm2_5") / F.lit(7.0), 2).alias("pm25_2dp")
    )


@register(
    "text_to_number",
    "F18",
    with_readings(
        "SELECT event_id, txt, TRY_CAST(nullif(regexp_extract(txt, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1), '') "
        "AS DOUBLE) AS num FROM (SELECT event_id, coalesce(CAST(pm2_5 AS VARCHAR), 'n/a') || ' ug/m3' AS txt FROM r)"
    ),
)
def text_to_number(spark, sf):
    r = R(spark, sf).select(
        "event_id", F.concat(F.coalesce(F.col("pm2_5").cast("string"), F.lit("n/a")), F.lit(" ug/m3")).alias("txt")
    )
    return r.select("event_id", "txt", FT.text_to_number("txt").alias("num"))


@register(
    "json_text",
    "F19",
    with_readings(
        "SELECT event_id, CAST(to_json({'x': temperature, 'y': humidity}) AS VARCHAR) AS coordinates, "
        "temperature AS x, humidity AS y FROM r"
    ),
)
def json_text(spark, sf):
    r = R(spark, sf).select("event_id", FT.json_point(F.col("temperature"), F.col("humidity")).alias("coordinates"))
    back = F.from_json("coordinates", "x double, y double")
    return r.select("event_id", "coordinates", back.x.alias("x"), back.y.alias("y"))


@register(
    "alert_ids",
    "F20",
    with_readings(
        "SELECT event_id, 'alert_' || CAST(epoch_us(timestamp) // 1000000 AS VARCHAR) || '_' || sensor_id AS legacy_id, "
        "sha256(concat_ws(',', sensor_id, CAST(epoch_us(timestamp) AS VARCHAR), 'POOR_AIR_QUALITY')) AS alert_id FROM r"
    ),
)
def alert_ids(spark, sf):
    r = R(spark, sf)
    return r.select(
        "event_id",
        FT.legacy_alert_id("timestamp", "sensor_id").alias("legacy_id"),
        FT.hashed_id(F.col("sensor_id"), F.unix_micros("timestamp"), F.lit("POOR_AIR_QUALITY")).alias("alert_id"),
    )


SNAP_COLS = ["pm2_5", "pm10", "temperature", "humidity", "battery_level"]


def _merge_sql(cols):
    return ", ".join(
        f"arg_max({c}, (epoch_us(timestamp), event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols
    )


@register(
    "state_merge",
    "J3 ST6",
    with_readings(f"SELECT sensor_id, max(timestamp) AS last_seen, {_merge_sql(SNAP_COLS + ['aqi'])} FROM r GROUP BY sensor_id"),
)
def state_merge(spark, sf):
    return LK.state_merge(R(spark, sf), SNAP_COLS + ["aqi"])


@register(
    "dim_update",
    "J4 F11",
    with_readings(
        "SELECT c.sensor_id, c.type, c.location_name, CAST(floor(s.aqi + 0.5) AS BIGINT) AS aqi, "
        + ", ".join(f"round(s.{c}, 1) AS {c}" for c in SNAP_COLS)
        + f" FROM (SELECT sensor_id, {_type_sql()} AS type, {_type_sql(pick=3)} AS location_name FROM lt) c "
        f"LEFT JOIN (SELECT sensor_id, {_merge_sql(SNAP_COLS + ['aqi'])} FROM r GROUP BY sensor_id) s "
        "ON c.sensor_id = s.sensor_id",
        f"lt AS ({LATEST_SQL})",
    ),
)
def dim_update(spark, sf):
    cat = LK.sensor_catalog(_latest(spark, sf)).select(
        F.col("id").alias("sensor_id"), "type", "location_name"
    )
    snap = LK.state_merge(R(spark, sf), SNAP_COLS + ["aqi"]).withColumn(
        "aqi", F.floor(F.col("aqi") + F.lit(0.5)).cast("bigint")
    )
    out = LK.dim_update(cat, snap, cols=SNAP_COLS + ["aqi"], digits=1)
    return out.select("sensor_id", "type", "location_name", "aqi", *SNAP_COLS)


# FIXED VALUES: event_type -> topic of the derived message envelope (one type unmapped).
TOPIC_OF = {
    "click": "air-quality-data",
    "view": "smart-sensor-data",
    "purchase": "smart-sensor-alerts",
    "signup": "smart-sensor-stats",
}
UNMAPPED_TOPIC = "legacy-sensor-data"


def _topic_col():
    expr = None
    for k, v in TOPIC_OF.items():
        expr = F.when(F.col("event_type") == k, v) if expr is None else expr.when(F.col("event_type") == k, v)
    return expr.otherwise(UNMAPPED_TOPIC)


def _envelopes(spark, sf):
    from ..sources.readings import readings

    r = readings(spark, sf, extra=("event_type",)).withColumn("topic", _topic_col()).drop("event_type")
    return PS.to_envelope(r, F.col("topic"))


TOPIC_SQL = (
    "CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOPIC_OF.items())
    + f" ELSE '{UNMAPPED_TOPIC}' END"
)
TABLE_SQL = "CASE topic " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TOPIC_TABLES.items()) + " END"


@register(
    "topic_route",
    "J5 S3 S11",
    with_readings(
        f"SELECT event_id, sensor_id AS key, topic, {TABLE_SQL} AS table_name FROM "
        f"(SELECT event_id, {TOPIC_SQL} AS topic FROM events) t JOIN r USING (event_id) WHERE {TABLE_SQL} IS NOT NULL"
    ),
)
def topic_route(spark, sf):
    routed, _ = LK.topic_route(_envelopes(spark, sf))
    return routed.select("event_id", "key", "topic", "table_name")


@register(
    "topic_unmapped",
    "J5",
    with_readings(
        f"SELECT event_id, sensor_id AS key, topic FROM (SELECT event_id, {TOPIC_SQL} AS topic FROM events) t "
        f"JOIN r USING (event_id) WHERE {TABLE_SQL} IS NULL"
    ),
)
def topic_unmapped(spark, sf):
    _, dropped = LK.topic_route(_envelopes(spark, sf))
    return dropped.select("event_id", "key", "topic")


@register(
    "lenient_cast",
    "S6 S5",
    with_readings("SELECT event_id, sensor_id, pm2_5, pm10, aqi, temperature, humidity, battery_level FROM r"),
)
def lenient_cast(spark, sf):
    r = R(spark, sf)
    cols = ["sensor_id", "pm2_5", "pm10", "aqi", "temperature", "humidity", "battery_level"]
    as_text = r.select("event_id", F.to_json(F.struct(*cols)).alias("value"))
    schema = ", ".join(f"`{c}` string" for c in cols)
    strings = as_text.select("event_id", F.from_json("value", schema).alias("d")).select("event_id", "d.*")
    return PS.lenient_cast(strings)


# Deliveries derived from events: every reading; again, later, those with an even event_id, without
# battery and with another pm2_5; and a third time those divisible by three, battery alone.
UPSERT_SQL = f"""
deliveries AS (
  SELECT *, event_id * 3 AS seq FROM r
  UNION ALL BY NAME SELECT * REPLACE (pm2_5 + 1e0 AS pm2_5, NULL AS battery_level), event_id * 3 + 1 AS seq FROM r WHERE event_id % 2 = 0
  UNION ALL BY NAME SELECT event_id, sensor_id, timestamp, 7e0 AS battery_level, event_id * 3 + 2 AS seq FROM r WHERE event_id % 3 = 0
)"""


def _last_sql(c: str) -> str:
    return f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"


KEEP_LAST_SQL = with_readings(
        f"SELECT sensor_id, timestamp, {', '.join(_last_sql(c) for c in READING_COLS if c not in ('sensor_id', 'timestamp'))} "
        "FROM deliveries GROUP BY sensor_id, timestamp",
        UPSERT_SQL,
    )


@register("upsert_keep_last", "S8 S9 S10", KEEP_LAST_SQL)
def upsert_keep_last(spark, sf):
    return SK.keep_last(_deliveries(spark, sf), key=("sensor_id", "timestamp"), order="_ingest").select(*READING_COLS)


def _deliveries(spark, sf):
    """Every reading, every second one again with other values, every third one's battery alone."""
    r = R(spark, sf).select(*READING_COLS)
    id3 = F.col("event_id") * 3
    second = r.where("event_id % 2 = 0").withColumn("pm2_5", F.col("pm2_5") + 1.0).withColumn("battery_level", F.lit(None).cast("double"))
    third = r.where("event_id % 3 = 0").select("event_id", "sensor_id", "timestamp", F.lit(7.0).alias("battery_level"))
    deliveries = r.withColumn("_ingest", id3).unionByName(second.withColumn("_ingest", id3 + 1))
    return deliveries.unionByName(third.withColumn("_ingest", id3 + 2), allowMissingColumns=True)


@register("snapshot_upserts", "S8 S9 S10", KEEP_LAST_SQL)
def snapshot_upserts(spark, sf):
    """The same deliveries as three commits to a table of snapshots in the shared folder, read back merged."""
    store = Snapshots(spark, scratch_path(spark, f"snapshots-{uuid.uuid4().hex}"), slots=("date",))
    rows = _deliveries(spark, sf)
    for part in range(3):
        store.upsert(rows.filter(F.col("_ingest") % 3 == part).drop("_ingest"))
    return store.read().select(*READING_COLS)


SHORT_TYPES = ("click", "view")  # rows delivered in the 15-column form; the rest in the 8-column form


@register(
    "align_columns",
    "S10 S9 T6",
    with_readings(
        "SELECT r.event_id, sensor_id, timestamp, area_type, pm2_5, pm10, aqi, temperature, humidity, "
        "CASE WHEN e.event_type IN ('click', 'view') THEN battery_level END AS battery_level, "
        "CASE WHEN e.event_type IN ('click', 'view') THEN signal_strength END AS signal_strength "
        "FROM r JOIN events e USING (event_id)"
    ),
)
def align_columns(spark, sf):
    from ..sources.readings import readings

    r = readings(spark, sf, extra=("event_type",))
    short = r.filter(F.col("event_type").isin(*SHORT_TYPES)).select(*READING_COLS)
    minimal = r.filter(~F.col("event_type").isin(*SHORT_TYPES)).select(
        "event_id", "sensor_id", "timestamp", "area_type", "pm2_5", "pm10", "aqi", "temperature", "humidity"
    )
    merged = LK.union_topics(short, minimal)
    return SK.align(merged).select(*READING_COLS)


@register(
    "union_topics",
    "T6",
    with_readings(
        "SELECT 'air-quality-data' AS topic, event_id, sensor_id, timestamp, pm2_5, NULL::VARCHAR AS severity FROM r "
        "UNION ALL SELECT 'air-quality-alerts', event_id, sensor_id, timestamp, NULL, severity FROM a3",
        A3_CTE,
    ),
)
def union_topics(spark, sf):
    data = R(spark, sf).select("event_id", "sensor_id", "timestamp", "pm2_5").withColumn("topic", F.lit("air-quality-data"))
    alerts = alerts3(spark, sf).select("event_id", "sensor_id", "timestamp", "severity").withColumn(
        "topic", F.lit("air-quality-alerts")
    )
    return LK.union_topics(data, alerts).select("topic", "event_id", "sensor_id", "timestamp", "pm2_5", "severity")


@register(
    "parse_flat",
    "S5 S11",
    with_readings("SELECT event_id, sensor_id, timestamp, pm2_5, pm10, aqi, temperature, humidity FROM r"),
)
def parse_flat(spark, sf):
    r = R(spark, sf)
    wire = r.select(
        "event_id",
        F.to_json(
            F.struct(
                "sensor_id",
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
                "pm2_5",
                "pm10",
                "aqi",
                "temperature",
                "humidity",
            )
        ).alias("value"),
    )
    return PS.parse_flat(wire, keep=("event_id",)).select(
        "event_id", "sensor_id", "timestamp", "pm2_5", "pm10", "aqi", "temperature", "humidity"
    )


@register(
    "dedup_redelivery",
    "ST9 S8",
    with_readings(
        f"SELECT {RC} FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, timestamp ORDER BY delivery) AS n FROM "
        "(SELECT *, 1 AS delivery FROM r UNION ALL SELECT * REPLACE (pm2_5 + 5e0 AS pm2_5), 2 AS delivery FROM r WHERE event_id % 4 = 0)) WHERE n = 1"
    ),
)
def dedup_redelivery(spark, sf):
    """Batch twin of stream de-duplication: a quarter of the readings comes again with other values, the first delivery stays."""
    r = R(spark, sf).select(*READING_COLS)
    again = r.where("event_id % 4 = 0").withColumn("pm2_5", F.col("pm2_5") + 5.0)
    both = r.withColumn("delivery", F.lit(1)).unionByName(again.withColumn("delivery", F.lit(2)))
    return extreme_row(both, ["sensor_id", "timestamp"], "delivery", None, newest=False).select(*READING_COLS)
