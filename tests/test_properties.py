"""Property checks from the blueprint's test strategy."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from particula import functions as PF
from particula.operators import anomalies as AN
from particula.operators import windows as WN
from particula.sources.readings import readings

from .conftest import SF_SMALL
from .test_scalars import py_aqi

conc = st.floats(min_value=0, max_value=700, allow_nan=False, allow_infinity=False)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(conc, conc), min_size=1, max_size=50))
def test_aqi_matches_banded_formula(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r[0] for r in df.select(PF.aqi_score("a", "b")).collect()]
    assert got == [py_aqi(a, b) for a, b in pairs]


def test_trailing_min_le_avg_le_max(spark):
    out = AN.trailing_features(readings(spark, SF_SMALL))
    bad = out.filter(
        (F.col("pm25_5min_min") > F.col("pm25_5min_avg") + 1e-9) | (F.col("pm25_5min_avg") > F.col("pm25_5min_max") + 1e-9)
        | (F.col("aqi_5min_min") > F.col("aqi_5min_avg") + 1e-9) | (F.col("aqi_5min_avg") > F.col("aqi_5min_max") + 1e-9)
    )
    assert bad.count() == 0


def test_latest_is_max_timestamp(spark):
    r = readings(spark, SF_SMALL)
    latest = {x.sensor_id: x.timestamp for x in WN.latest(r).collect()}
    mx = {x.sensor_id: x.m for x in r.groupBy("sensor_id").agg(F.max("timestamp").alias("m")).collect()}
    assert latest == mx


def test_frames_grow_with_length(spark):
    out = AN.trailing_features(readings(spark, SF_SMALL)).select(
        "event_id",
        F.col("pm25_5min_avg").alias("a5"),
    )
    counts = WN.trailing(
        readings(spark, SF_SMALL),
        [WN.Agg("n5", "count", "pm2_5", 5), WN.Agg("n15", "count", "pm2_5", 15), WN.Agg("n60", "count", "pm2_5", 60)],
    )
    assert counts.filter((F.col("n5") > F.col("n15")) | (F.col("n15") > F.col("n60"))).count() == 0
    assert out.count() == counts.count()
