"""Skew-safe window operators against brute force on small fixtures.

Tiny buckets force many (sensor, bucket) partitions, sparse sensors force
context rows to come from buckets further back, and ties/edge offsets check
the frame bounds.
"""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from particula.operators import windows as WN

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _rows(seed=7, n=400):
    rnd = random.Random(seed)
    rows = []
    eid = 0
    for sensor, dens in (("sensor-urban-0", 20), ("sensor-bus-1", 200), ("sensor-drone-0", 2000)):
        t = 0
        while len(rows) < n * (1 + ["sensor-urban-0", "sensor-bus-1", "sensor-drone-0"].index(sensor)) // 1:
            t += rnd.choice([0, 1, dens, dens * 3, 299_000_000 // 1_000_000, 300, 301])
            v = None if rnd.random() < 0.05 else round(rnd.uniform(0, 300), 3)
            rows.append((eid, sensor, T0 + dt.timedelta(seconds=t, microseconds=rnd.choice([0, 1])), v))
            eid += 1
            if len(rows) >= 3 * n:
                break
    # exact frame-edge rows: 300 s, 900 s, 3600 s after a base and 1 us past
    base = T0 + dt.timedelta(days=3)
    for off in (0, 300, 900, 3600):
        for us in (0, 1):
            rows.append((eid, "sensor-edge", base + dt.timedelta(seconds=off, microseconds=us), float(off + us)))
            eid += 1
    rows.append((eid, "sensor-single", T0, 5.0))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(_rows(), "event_id long, sensor_id string, timestamp timestamp, x double")
    return df


def _collect(df, cols):
    return {r["event_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("bucket", [1.0, 7.0, None])
def test_trailing_matches_plain_window(spark, frame, bucket):
    aggs = [WN.Agg("a5", "avg", "x", 5), WN.Agg("m15", "max", "x", 15), WN.Agg("n60", "count", "x", 60)]
    got = WN.trailing(frame, aggs, bucket_minutes=bucket)
    t = F.unix_micros("timestamp")
    w = lambda m: Window.partitionBy("sensor_id").orderBy(t).rangeBetween(-m * 60_000_000, 0)
    ref = frame.select(
        "event_id",
        F.avg("x").over(w(5)).alias("a5"),
        F.max("x").over(w(15)).alias("m15"),
        F.count("x").over(w(60)).alias("n60"),
    )
    g, r = _collect(got, ["a5", "m15", "n60"]), _collect(ref, ["a5", "m15", "n60"])
    assert set(g) == set(r)
    for k in r:
        assert all(_close(a, b) for a, b in zip(g[k], r[k])), (k, g[k], r[k])


@pytest.mark.parametrize("bucket", [0.5, 3.0, 60.0])
def test_last_rows_matches_plain_rows_frame(spark, frame, bucket):
    aggs = [WN.Agg("s", "sum", "x"), WN.Agg("mn", "min", "x")]
    got = WN.last_rows(frame, aggs, n=10, bucket_minutes=bucket, with_count="cnt")
    w = Window.partitionBy("sensor_id").orderBy("timestamp", "event_id").rowsBetween(-9, 0)
    ref = frame.select(
        "event_id", F.sum("x").over(w).alias("s"), F.min("x").over(w).alias("mn"), F.count(F.lit(1)).over(w).alias("cnt")
    )
    g, r = _collect(got, ["s", "mn", "cnt"]), _collect(ref, ["s", "mn", "cnt"])
    assert set(g) == set(r)
    for k in r:
        assert all(_close(a, b) for a, b in zip(g[k], r[k])), (k, g[k], r[k])


@pytest.mark.parametrize("bucket", [1.0, 30.0, 1440.0])
def test_running_matches_unbounded_range(spark, frame, bucket):
    got = WN.running(frame, ["x"], bucket_minutes=bucket, funcs=("avg", "max", "min", "count"))
    w = Window.partitionBy("sensor_id").orderBy(F.unix_micros("timestamp")).rangeBetween(
        Window.unboundedPreceding, 0
    )
    ref = frame.select(
        "event_id",
        F.avg("x").over(w).alias("x_avg"),
        F.max("x").over(w).alias("x_max"),
        F.min("x").over(w).alias("x_min"),
        F.count("x").over(w).alias("x_count"),
    )
    cols = ["x_avg", "x_max", "x_min", "x_count"]
    g, r = _collect(got, cols), _collect(ref, cols)
    assert set(g) == set(r)
    for k in r:
        assert all(_close(a, b) for a, b in zip(g[k], r[k])), (k, g[k], r[k])


def test_trailing_frame_edges_inclusive(spark, frame):
    got = WN.trailing(frame.filter("sensor_id = 'sensor-edge'"), [WN.Agg("s5", "sum", "x", 5)])
    by_val = {r["x"]: r["s5"] for r in got.collect()}
    # exactly 300 s back is inside the frame, 300 s + 1 us back is not
    assert by_val[300.0] == 0.0 + 1.0 + 300.0
    assert by_val[301.0] == 1.0 + 300.0 + 301.0
    assert by_val[3600.0] == 3600.0


def test_partition_stats_and_latest(spark, frame):
    got = WN.partition_stats(frame, [("sd", F.stddev_samp("x"))])
    ref = frame.select("event_id", F.stddev_samp("x").over(Window.partitionBy("sensor_id")).alias("sd"))
    g, r = _collect(got, ["sd"]), _collect(ref, ["sd"])
    assert all(_close(g[k][0], r[k][0]) for k in r)
    single = [v for k, v in g.items() if k == max(g)]
    assert single == [(None,)]  # one-row sensor: sample stddev is NULL

    latest = {r["sensor_id"]: r["event_id"] for r in WN.latest(frame).collect()}
    w = Window.partitionBy("sensor_id").orderBy(F.desc("timestamp"), F.desc("event_id"))
    ref2 = {
        r["sensor_id"]: r["event_id"]
        for r in frame.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()
    }
    assert latest == ref2


def test_keep_last_uses_group_limit(spark, frame):
    out = WN.keep_last(frame, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    counts = {r["sensor_id"]: r["count"] for r in out.groupBy("sensor_id").count().collect()}
    assert max(counts.values()) == 3


def test_auto_bucket_shrinks_for_hot_keys_and_stays_exact(spark, frame, monkeypatch):
    big = WN.bucket_length(frame, "sensor_id", "timestamp", 300_000_000)
    monkeypatch.setattr(WN, "TARGET_ROWS", 5)
    small = WN.bucket_length(frame, "sensor_id", "timestamp", 300_000_000)
    row = frame.select(big.alias("big"), small.alias("small")).first()
    assert row.small == 300_000_000 < row.big  # the densest 5-minute slot holds more than 5 rows
    aggs = [WN.Agg("a5", "avg", "x", 5), WN.Agg("n60", "count", "x", 60)]
    got = _collect(WN.trailing(frame, aggs), ["a5", "n60"])
    t = F.unix_micros("timestamp")
    w = lambda m: Window.partitionBy("sensor_id").orderBy(t).rangeBetween(-m * 60_000_000, 0)
    ref = _collect(frame.select("event_id", F.avg("x").over(w(5)).alias("a5"), F.count("x").over(w(60)).alias("n60")),
                   ["a5", "n60"])
    assert all(all(_close(a, b) for a, b in zip(got[k], ref[k])) for k in ref)
    got10 = _collect(WN.last_rows(frame, [WN.Agg("s", "sum", "x")], n=10), ["s"])
    w10 = Window.partitionBy("sensor_id").orderBy("timestamp", "event_id").rowsBetween(-9, 0)
    ref10 = _collect(frame.select("event_id", F.sum("x").over(w10).alias("s")), ["s"])
    assert all(_close(got10[k][0], ref10[k][0]) for k in ref10)


@pytest.mark.parametrize("slot", [0.5, 60.0])
def test_keep_last_cutoff_matches_rank(spark, frame, slot):
    got = {r.event_id for r in WN.keep_last(frame, 5, slot_minutes=slot).collect()}
    w = Window.partitionBy("sensor_id").orderBy(F.desc("timestamp"), F.desc("event_id"))
    ref = {r.event_id for r in frame.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").collect()}
    assert got == ref


ODD = "event_id long, sensor_id string, timestamp timestamp, pm2_5 double, pm10 double, aqi int"


def _odd(spark, n=160):
    import datetime as dt
    import random

    r = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        t = None if i % 11 == 0 else t0 + dt.timedelta(seconds=r.choice([0, 7, 300, 301, 3599, 3600, 9000]) + r.randint(0, 900))
        rows.append((i, None if i % 7 == 0 else r.choice(["a", "b"]), t, None if i % 13 == 0 else r.uniform(0, 99), r.uniform(0, 99), r.randint(0, 300)))
    return spark.createDataFrame(rows, ODD)


def _close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_no_row_without_time_or_sensor_is_lost(spark):
    """Every operator against the plain window on frames with NULL sensors and NULL times."""
    from pyspark.sql import Window

    from particula.operators import windows as WN

    df = _odd(spark)
    plain = Window.partitionBy("sensor_id")
    micros = F.unix_micros("timestamp")
    cases = []
    for minutes in (5, 60):
        w = plain.orderBy(micros).rangeBetween(-minutes * 60_000_000, 0)
        cases.append((WN.trailing(df, [WN.Agg("x", "avg", "pm2_5", minutes)]), F.avg("pm2_5").over(w)))
    w = plain.orderBy(micros).rangeBetween(Window.unboundedPreceding, 0)
    for minutes in ("auto", 1):
        cases.append((WN.running(df, ["pm2_5"], bucket_minutes=minutes).withColumnRenamed("pm2_5_avg", "x"), F.avg("pm2_5").over(w)))
    w = plain.orderBy(micros, "event_id").rowsBetween(-9, 0)
    for minutes in ("auto", 1):
        cases.append((WN.last_rows(df, [WN.Agg("x", "avg", "pm2_5")], n=10, bucket_minutes=minutes), F.avg("pm2_5").over(w)))
    cases.append((WN.partition_stats(df, [("x", F.stddev_samp("pm2_5"))]), F.stddev_samp("pm2_5").over(plain)))
    for got, want in cases:
        have = {r.event_id: r.x for r in got.collect()}
        expect = {r.event_id: r.x for r in df.select("event_id", want.alias("x")).collect()}
        assert have.keys() == expect.keys()
        assert all(_close(have[i], expect[i]) for i in have)
    for n in (3, 1000):
        rank = F.row_number().over(plain.orderBy(F.desc("timestamp"), F.desc("event_id")))
        want = {r.event_id for r in df.withColumn("n", rank).where(F.col("n") <= n).collect()}
        assert {r.event_id for r in WN.keep_last(df, n).collect()} == want


def test_one_minute_bounds_a_dense_hour(spark):
    """A sensor with all rows in one hour: running and last-N tasks hold a minute, not the hour."""
    from particula.operators import windows as WN

    df = spark.range(36_000).selectExpr("id AS event_id", "'hot' AS sensor_id", "timestamp_millis(id * 100) AS timestamp", "CAST(id % 97 AS DOUBLE) AS pm2_5")
    length = WN.bucket_length(df, "sensor_id", "timestamp", WN.SHORT_UNIT_US, target_rows=1000)
    assert df.limit(1).select(length.alias("n")).first().n == 60_000_000
    got = WN.running(df, ["pm2_5"], bucket_minutes=1).where("event_id % 3599 = 0")
    assert all(abs(r.pm2_5_avg - sum(i % 97 for i in range(r.event_id + 1)) / (r.event_id + 1)) < 1e-9 for r in got.collect())


def test_means_are_true_means(spark):
    from particula.operators import stats as ST

    rows = [("a", 0.0004, 1.0), ("a", 0.0004, float("nan")), ("b", 0.00001, 2.0)]
    df = spark.createDataFrame(rows, "sensor_id string, pm2_5 double, pm10 double").withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
    got = {r.sensor_id: r for r in ST.window_aggregates(df).collect()}
    assert got["a"].avg_pm2_5 == 0.0004 and got["b"].avg_pm2_5 == 0.00001
    assert got["a"].avg_pm10 != got["a"].avg_pm10  # NaN, as avg gives it


def test_lookback_offset_is_kept_under_any_driver_zone(spark, monkeypatch):
    import time

    from particula.operators import quality as Q

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        df = spark.range(24).selectExpr("id", "timestamp_seconds(1704067200 + id * 3600) AS timestamp")
        got = Q.lookback(df, 2, as_of="2024-01-01T12:00:00+05:00").agg(F.min("id")).first()[0]
        assert got == 5
        assert Q.lookback(df, 2, as_of="2024-01-01T12:00:00").agg(F.min("id")).first()[0] == 10
        assert Q.lookback(df, 2).count() == 3
    finally:
        monkeypatch.undo()
        time.tzset()


def _dense_rows(n=400, seed=5):
    """A sensor with bursts far beyond ten rows a minute, ties, rows before 1970, without a time and without values."""
    import random

    r = random.Random(seed)
    rows = []
    for i in range(n):
        sec = r.choice([r.uniform(0, 240), r.uniform(3000, 3100), r.uniform(0, 9000), 600.0])
        t = dt.datetime(1969, 12, 31, 23, 20) + dt.timedelta(seconds=round(sec, r.choice([0, 3])))
        rows.append((i, r.choice(["a", "a", "a", "b", None]), None if i % 41 == 0 else t, None if i % 7 == 0 else r.uniform(-5, 50), None if i % 11 == 0 else r.randint(0, 300)))
    return rows


DENSE_AGGS = [
    WN.Agg("a5", "avg", "x", 5),
    WN.Agg("a15", "avg", "x", 15),
    WN.Agg("a60", "avg", "x", 60),
    WN.Agg("mx5", "max", "k", 5),
    WN.Agg("mn60", "min", "x", 60),
    WN.Agg("s15", "sum", "k", 15),
    WN.Agg("c5", "count", "k", 5),
    WN.Agg("m5", "min", "k", 5),
]


@pytest.mark.parametrize("target", [10, 40, 90])
def test_trailing_in_a_dense_hour(spark, target):
    """No (sensor, block) holds more than the target (but rows of one moment); equal to the plain window; the rows move once."""
    df = spark.createDataFrame(_dense_rows(), "event_id long, sensor_id string, timestamp timestamp, x double, k int")
    out = WN.trailing(df, DENSE_AGGS, target_rows=target)
    over = {m: f"(PARTITION BY sensor_id ORDER BY unix_micros(timestamp) RANGE BETWEEN {m * 60_000_000} PRECEDING AND CURRENT ROW)" for m in (5, 15, 60)}
    want = df.select("*", *[F.expr(f"{a.func}({a.col}) OVER {over[a.minutes]}").alias(a.out) for a in DENSE_AGGS])

    def rounded(d):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in d.collect()), key=str)

    assert out.columns == want.columns and rounded(out) == rounded(want)
    assert [t for _, t in out.dtypes] == [t for _, t in want.dtypes]
    frames = [m * 60_000_000 for m in (5, 15, 60)]
    length = WN.block_length(df, frames, "sensor_id", "timestamp", target)
    assert length < 3_600_000_000 and all(f % length == 0 for f in frames)
    groups = WN.block_copies(df.filter("timestamp is not null"), frames, ["x", "k"], "sensor_id", "timestamp", length).groupBy("sensor_id", "_bucket")
    moment = df.filter("timestamp is not null").groupBy("sensor_id", "timestamp").count().agg(F.max("count")).first()[0]
    assert groups.count().agg(F.max("count")).first()[0] <= max(target, 4 * moment)


def test_dense_hour_moves_the_rows_once(spark):
    import re

    df = spark.range(5000).select(F.col("id").alias("event_id"), F.lit("s").alias("sensor_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("timestamp"), F.rand(1).alias("x"))
    aggs = [WN.Agg("a5", "avg", "x", 5), WN.Agg("m60", "max", "x", 60)]
    out = WN.trailing(df, aggs, target_rows=500)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moves = re.findall(r"Exchange hashpartitioning\(sensor_id#\d+, _bucket#\d+L?, \d+\)", plan)
    # the copies, the partial rows of the blocks, and the result of their window for the join
    assert len(moves) <= 3 and "Python" not in plan
    assert WN.trailing(df, aggs, target_rows=10**6).select("a5").count() == 5000


def test_blocks_divide_every_frame():
    assert WN._divisor(300_000_000, 299_999_999) == 150_000_000
    assert WN._divisor(300_000_000, 1) == 1
    assert WN._divisor(7, 6) == 1
