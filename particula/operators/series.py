"""Aligned series of a sensor's analysis (A12), as pages of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from .windows import _B, _T, _bucketed, _resolve_bucket

PAGE_ROWS = 1000


def aligned_series(
    scored: DataFrame,
    values: tuple[str, ...] = ("pm2_5", "pm10"),
    flag: str = "is_anomaly",
    key: str = "sensor_id",
    ts: str = "timestamp",
    tiebreak: str = "event_id",
    page_rows: int = PAGE_ROWS,
    bucket_minutes: float | None = None,
) -> DataFrame:
    """Per (key, page): readings, anomalies, and the aligned arrays timestamps, one for each of ``values``, scores.

    Readings are numbered from 0 in the order (time, ``tiebreak``), and a page
    holds ``page_rows`` of them, so the pages of a key put one after another
    are its whole series. A score is 1 where a flagged reading of the key has
    that time, as the reproduced service matches them by time; else 0.

    No task or group holds a whole key: readings are ranked within time buckets
    of measured length, and the counts of earlier buckets, a small table, give
    the offset. Readings without a time come first, those without a key form a
    series of their own.
    """
    rows = scored.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(tiebreak).alias("_tie"), F.coalesce(F.col(flag), F.lit(False)).cast("int").alias("_flag"), *values)
    bucketed = _bucketed(rows, "_ts", _resolve_bucket(rows, "_key", "_ts", bucket_minutes, C.MICROS_PER_MINUTE)).drop("_blen")
    before = Window.partitionBy("_key").orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_key", _B).count().select(F.col("_key").alias("_k"), F.col(_B).alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    in_bucket = Window.partitionBy("_key", _B)
    ranked = bucketed.select(
        "*",
        F.max("_flag").over(Window.partitionBy("_key", _B, _T)).alias("_score"),
        F.row_number().over(in_bucket.orderBy(_T, "_tie")).alias("_rank"),
    )
    placed = ranked.join(offsets, F.col("_key").eqNullSafe(F.col("_k")) & (F.col(_B) == F.col("_b")))
    at = (F.col("_offset") + F.col("_rank") - 1).cast("bigint")
    paged = placed.select("_key", at.alias("_at"), "_ts", "_flag", "_score", *values)
    pages = paged.groupBy("_key", F.floor(F.col("_at") / page_rows).alias("page")).agg(
        F.sum("_flag").alias("anomalies"),
        F.sort_array(F.collect_list(F.struct("_at", "_ts", "_score", *values))).alias("_rows"),
    )
    return pages.select(
        F.col("_key").alias(key),
        "page",
        F.size("_rows").cast("bigint").alias("readings"),
        "anomalies",
        F.col("_rows._ts").alias("timestamps"),
        *[F.col(f"_rows.{v}").alias(v) for v in values],
        F.col("_rows._score").alias("scores"),
    )
