"""Newest rows and newest values per key with hash aggregates.

`max_by(struct(...), struct(...))` keeps its row in a buffer that a hash
aggregate cannot hold, so it sorts all input before the shuffle. Here the
extreme order value per key comes from a hash aggregate on fixed-width
buffers; a semi-join then fetches only the rows that carry it, and the few
rows left are resolved by the tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join


def extreme_row(df: DataFrame, key: list[str], by: str, tie: str | None, newest: bool = True) -> DataFrame:
    """One row per key: the one with the largest (or smallest) `by`, ties by `tie`.

    NULL keys form a group; a NULL `by` is chosen only where the key has no other.
    """
    edge = df.groupBy(*key).agg((F.max if newest else F.min)(by).alias(by))
    rows = null_safe_join(df, edge, [*key, by], "left_semi")
    order = [(F.desc if newest else F.asc)(tie)] if tie else [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def _edges(df: DataFrame, key: list[str], cols: list[str], by: str) -> DataFrame:
    """Per key the newest `by`, and the newest at which each column is not NULL."""
    return df.groupBy(*key).agg(F.max(by).alias(by), *[F.max(F.when(F.col(c).isNotNull(), F.col(by))).alias(f"_at_{c}") for c in cols])


def carrying_rows(df: DataFrame, key: list[str], cols: list[str], by: str, edges: DataFrame | None = None) -> DataFrame:
    """The rows at which some column has its key's newest non-NULL value."""
    edges = _edges(df, key, cols, by) if edges is None else edges
    wanted = edges.select(*key, F.explode(F.array_distinct(F.array(*[F.col(f"_at_{c}") for c in cols]))).alias("_by"))
    wanted = wanted.filter(F.col("_by").isNotNull()).withColumnRenamed("_by", by)
    return null_safe_join(df, wanted, [*key, by], "left_semi")


def newest_values(df: DataFrame, key: list[str], cols: list[str], by: str, tie: str) -> DataFrame:
    """Per key and column the newest non-NULL value (order `by`, then `tie`), and the newest `by` itself.

    At most one `by` value per column reaches the second step for each key, so
    what is gathered there does not grow with the key's history. Rows without
    `by` never win.
    """
    edges = _edges(df, key, cols, by)
    rows = carrying_rows(df, key, cols, by, edges)

    def newest(c):
        held = F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(by).alias("b"), F.col(tie).alias("t"), F.col(c).alias("v"))))
        return F.get(F.sort_array(held, asc=False), F.lit(0))["v"].alias(c)

    values = rows.groupBy(*key).agg(*[newest(c) for c in cols])
    return null_safe_join(edges.select(*key, by), values, key, "left")
