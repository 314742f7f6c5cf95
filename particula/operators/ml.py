"""Anomaly detectors.

Inputs are pm2_5 ~ (pm10, temperature, humidity) with missing values as 0,
as in the reproduced service. Every detector fits on the whole frame it is
given (distributed training / aggregation) and returns the frame with an
`is_anomaly` flag, so the caller can keep the anomalous rows or join flags
back (J2).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .forest import forest_predictions
from .one_class import one_class_svm
from .quality import lookback
from .windows import _B, _T, _bucketed, bucket_length

FEATURES = ["pm2_5", "pm10", "temperature", "humidity"]
METHODS = ("random-forest", "svm", "kmeans")
SEED = 42
KMEANS_STARTS = 10


def _require(df: DataFrame) -> None:
    missing = [c for c in FEATURES if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required column: {missing[0]}")


def _filled(df: DataFrame) -> DataFrame:
    _require(df)
    return df.select("*", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"_f_{c}") for c in FEATURES])


def random_forest_residual(df: DataFrame, num_trees: int = 100, max_depth: int = 30) -> DataFrame:
    """M1: in-sample random-forest regression of pm2_5 on the other three
    features; anomalous where |pm2_5 - prediction| > 2 * sample sd(pm2_5)."""
    f = _filled(df)
    names = [f"_f_{c}" for c in FEATURES]
    n, nans = f.select(F.count(F.lit(1)), F.count_if(F.greatest(*names) == F.lit(float("nan")))).first()  # NaN is the greatest
    if n < 2:  # nothing to fit: no anomalies
        return df.withColumn("prediction", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    if nans:
        raise ValueError(f"NaN among {', '.join(FEATURES)}")
    pred = forest_predictions(f, n, names[0], names[1:], num_trees, max_depth, SEED, "prediction")
    sd = f.select(F.stddev_samp("pm2_5")).scalar()
    out = pred.withColumn(
        "is_anomaly", F.coalesce(F.abs(F.col("pm2_5") - F.col("prediction")) > F.lit(C.SIGMA_FACTOR) * sd, F.lit(False))
    )
    return out.drop(*names)


def _moved(starts: list[np.ndarray]):
    """Vectors -> per start and center the count, sum and squared distances of a task's nearest rows."""

    def add(batches):
        found = [(np.zeros(len(c)), np.zeros(c.shape), np.zeros(len(c))) for c in starts]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            for centers, (count, total, cost) in zip(starts, found, strict=True):
                far = np.stack([((x - c) ** 2).sum(axis=1) for c in centers])
                nearest = far.argmin(axis=0)
                count += np.bincount(nearest, minlength=len(centers))
                cost += np.bincount(nearest, far.min(axis=0), len(centers))
                for j in range(x.shape[1]):
                    total[:, j] += np.bincount(nearest, x[:, j], len(centers))
        for start, (count, total, cost) in enumerate(found):
            yield pa.RecordBatch.from_pydict(
                {"start": [start] * len(count), "center": np.arange(len(count)), "n": count, "total": total.tolist(), "cost": cost}
            )

    return add


def best_centers(vec: DataFrame, starts: list[np.ndarray], most: int = 20, tolerance: float = 1e-4) -> np.ndarray:
    """The centers of least cost that Lloyd's rounds lead to, as `pyspark.ml.KMeans` runs them (its limits too).

    A round of all starts that still move is one pass over ``vec`` (column ``_x``, a vector). The first of
    starts with equal cost is taken, equal but for rounding.
    """
    starts, costs, moving = list(starts), [math.inf] * len(starts), list(range(len(starts)))
    rows = vec.select(vector_to_array("_x").alias("x"))
    for _ in range(most):
        if not moving:
            break
        now = [starts[i] for i in moving]
        sums = [(np.zeros(len(c)), np.zeros(c.shape), np.zeros(len(c))) for c in now]
        # a row a task, start and center
        for r in rows.mapInArrow(_moved(now), "start long, center long, n double, total array<double>, cost double").collect():
            for of, value in zip(sums[r["start"]], (r["n"], r["total"], r["cost"]), strict=True):
                of[r["center"]] += value
        still = []
        for i, before, (count, total, cost) in zip(moving, now, sums, strict=True):
            held = count > 0
            starts[i] = np.where(held[:, None], total / np.maximum(count, 1)[:, None], before)
            costs[i] = cost.sum()
            if (((starts[i] - before) ** 2).sum(axis=1) > tolerance**2).any():
                still.append(i)
        moving = still
    return starts[next(i for i, c in enumerate(costs) if c <= min(costs) * (1 + 1e-12))]


def kmeans_minority(df: DataFrame, k: int = 2) -> DataFrame:
    """M3: 2-means on the four features; the smaller cluster is anomalous
    (ties go to the lower cluster id). Fewer than 2 rows -> nothing flagged."""
    f = _filled(df)
    n = f.select(F.count(F.lit(1))).first()[0]
    if n < 2:  # fewer than 2 rows: nothing flagged
        return df.withColumn("cluster", F.lit(None).cast("int")).withColumn("is_anomaly", F.lit(False))
    names = [f"_f_{c}" for c in FEATURES]
    # the inputs alone are kept, as every pass runs over them
    vec = VectorAssembler(inputCols=names, outputCol="_x").transform(f.select(*names)).select("_x").persist()
    try:
        # the best of several starts, as the reproduced service takes it; all move in the same passes
        starts = [KMeans(k=k, seed=SEED + i, maxIter=0, featuresCol="_x").fit(vec).clusterCenters() for i in range(KMEANS_STARTS)]
        centers = best_centers(vec, [np.array(c) for c in starts])
    finally:
        vec.unpersist()
    far = ", ".join(" + ".join(f"power(`{x}` - CAST('{float(v)!r}' AS DOUBLE), 2)" for x, v in zip(names, c, strict=True)) for c in centers)
    pred = f.withColumn("_far", F.expr(f"array({far})")).withColumn("cluster", F.expr("CAST(array_position(_far, array_min(_far)) - 1 AS INT)"))
    sizes = pred.groupBy("cluster").count()
    smallest = sizes.orderBy("count", "cluster").limit(1).select("cluster")
    flag = F.col("cluster") == smallest.select(F.first("cluster")).scalar()
    out = pred.withColumn("is_anomaly", F.coalesce(flag, F.lit(False)))
    return out.drop("_far", *names)


def detect(
    df: DataFrame,
    method: str = "random-forest",
    sensor_id: str | None = None,
    hours: float | None = C.LOOKBACK_DEFAULT_HOURS,
    as_of=None,
) -> DataFrame:
    """M4: dispatch with the service's look-back (default 24 h before `as_of`,
    which defaults to the newest reading); unknown method -> ValueError."""
    if method not in METHODS:
        raise ValueError(f"Unsupported algorithm: {method}")
    frame = df
    if hours is not None:
        frame = lookback(df, hours, sensor_id=sensor_id, as_of=as_of)
    elif sensor_id is not None:
        frame = df.filter(F.col("sensor_id") == sensor_id)
    if method == "random-forest":
        return random_forest_residual(frame)
    if method == "svm":
        _require(frame)
        return one_class_svm(frame, FEATURES)
    return kmeans_minority(frame)


def response(scored: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Per-sensor totals of the analysis (readings, anomalies). The
    aligned arrays are in pages of bounded size (`series.aligned_series`)."""
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col("is_anomaly")).alias("anomalies"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


GROUP_ROWS = 100_000  # rows of one call of a user's detector, where the bucket is measured


def per_group(df: DataFrame, fn, schema: str, key: str = "sensor_id", bucket_minutes: float | None = 60.0, context_minutes: float = 0.0) -> DataFrame:
    """M5: run a user detector (pandas in, pandas out) per (key, time bucket).

    Groups are one sensor over `bucket_minutes` of event time, so a single
    call never receives more than one bucket of one sensor however much data
    the sensor sends; None measures the rate and takes the longest bucket that
    keeps a call at `GROUP_ROWS` rows, in whole multiples of the context or
    minute. With `context_minutes` (at most a bucket) a group also gets the
    key's readings of that time before its edge, with `is_context` true; `fn`
    answers the others only, and so needs no more than a trailing look at the
    series. Readings come in no stated order. Those without a time form a group
    of their own, without context.
    """
    reach = int(context_minutes * C.MICROS_PER_MINUTE)
    if bucket_minutes is None:
        unit = max(reach, C.MICROS_PER_MINUTE)
        length = bucket_length(df, key, "timestamp", unit, target_rows=GROUP_ROWS)
    else:
        length = int(bucket_minutes * C.MICROS_PER_MINUTE)
        if reach > length:
            raise ValueError("context_minutes must not be longer than a bucket")
    d = _bucketed(df, "timestamp", length)
    if reach:
        home, after = (F.struct(b.alias("b"), F.lit(c).alias("c")) for b, c in ((F.col(_B), False), (F.col(_B) + 1, True)))
        near_edge = F.col(_T) >= (F.col(_B) + 1) * F.col("_blen") - F.lit(reach)
        d = d.withColumn("_copy", F.explode(F.when(near_edge, F.array(home, after)).otherwise(F.array(home))))
        d = d.withColumn(_B, F.col("_copy.b")).withColumn("is_context", F.col("_copy.c"))
    d = d.select(*df.columns, *(["is_context"] if reach else []), F.col(_B).alias("_bucket"))
    return d.groupBy(key, "_bucket").applyInPandas(fn, schema)
