"""Lookups, joins and top-k reads (J2-J5, T1, T3, T6, F11/F12 catalog)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import canonical_location, image_path, sensor_type
from .joins import lookup_map, null_safe_join
from .newest import newest_values


def recent(df: DataFrame, sensor_id: str, limit: int = C.RECENT_DEFAULT_LIMIT) -> DataFrame:
    """Newest `limit` readings of one sensor (TakeOrderedAndProject)."""
    return (
        df.filter(F.col("sensor_id") == sensor_id)
        .orderBy(F.desc("timestamp"), F.desc("event_id"))
        .limit(limit)
    )


def newest_first(df: DataFrame) -> DataFrame:
    """Readings newest first (a range-partitioned global sort)."""
    return df.orderBy(F.desc("timestamp"), F.desc("event_id"))


def membership_flag(df: DataFrame, hits: DataFrame, keys=("sensor_id", "timestamp")) -> DataFrame:
    """1 when the reading's key is in `hits`, else 0 (left join on the key,
    replacing the quadratic membership test)."""
    h = hits.select(*keys).distinct().withColumn("_hit", F.lit(1))
    j = df.join(h, list(keys), "left")
    return j.withColumn("is_hit", F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit")


def state_merge(df: DataFrame, cols: list[str], key: str = "sensor_id") -> DataFrame:
    """J3 / ST6: per key, the newest non-missing value of every field."""
    return newest_values(df, [key], cols, "timestamp", "event_id").withColumnRenamed("timestamp", "last_seen")


def sensor_catalog(latest: DataFrame) -> DataFrame:
    """F11/F12 over the latest reading per sensor: id, type, place, image."""
    area = "area_type" if "area_type" in latest.columns else None
    loc = "location_name" if "location_name" in latest.columns else None
    stype = sensor_type("sensor_id", area)
    return latest.select(
        F.col("sensor_id").alias("id"),
        stype.alias("type"),
        canonical_location("sensor_id", area, loc).alias("location_name"),
        image_path(stype).alias("img"),
    )


def dim_update(dim: DataFrame, snap: DataFrame, key: str = "sensor_id", cols=(), digits: int = 1) -> DataFrame:
    """Update dimension rows from a snapshot by id; snapshot values rounded."""
    s = snap.select(key, *[F.round(F.col(c), digits).alias(f"_new_{c}") for c in cols])
    j = null_safe_join(dim, s, [key], "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c) if c in dim.columns else F.lit(None)))
    return j.drop(*[f"_new_{c}" for c in cols])


def topic_route(df: DataFrame, mapping: dict = C.TOPIC_TABLES, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """Topic -> table name via a literal map (bounded); unmapped rows separately."""
    m = lookup_map(mapping)
    tagged = df.withColumn("table_name", F.try_element_at(m, F.col(topic)))
    return tagged.filter(F.col("table_name").isNotNull()), tagged.filter(F.col("table_name").isNull())


def union_topics(*frames: DataFrame) -> DataFrame:
    """Merge differently-shaped topic frames by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
