"""Stored panes: equal to a scan of the readings, kept up hour by hour."""

import pytest
from pyspark.sql import functions as F

from particula.operators import panes as P
from particula.operators import stats as ST
from particula.operators.snapshots import Snapshots
from particula.sources.readings import readings

from .conftest import SF_SMALL

COLS = ["event_id", "sensor_id", "timestamp", "pm2_5", "pm10", "aqi", "battery_level", "signal_strength"]


def _same(a, b):
    def rows(df):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)

    assert rows(a.select(*b.columns)) == rows(b)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(readings(spark, SF_SMALL).select(*COLS).filter("sensor_id is not null and timestamp is not null").limit(400).collect(), readings(spark, SF_SMALL).select(*COLS).schema)


def test_panes_equal_the_full_scan_and_cost_only_their_hours(spark, scratch, rows, monkeypatch):
    stored, panes = Snapshots(spark, f"{scratch}/r", key=("sensor_id", "timestamp", "event_id")), P.store(spark, f"{scratch}/p")
    cut = rows.select(F.expr("percentile_approx(timestamp, 0.5)")).first()[0]
    early = rows.filter((F.col("timestamp") < cut) & (F.col("event_id") % 3 != 0))
    stored.upsert(early)
    hours = P.refresh(stored, panes)
    assert len(hours) == early.select(F.date_trunc("hour", "timestamp")).distinct().count()
    _same(P.window_aggregates(panes.read(), 60), ST.window_aggregates(early, "60 minutes"))
    # one new hour costs that hour; nothing new costs nothing
    one = rows.filter(F.col("timestamp") >= cut).orderBy("timestamp").limit(1)
    stored.upsert(one)
    assert len(P.refresh(stored, panes)) == 1 and P.refresh(stored, panes) == []
    # a refresh that fails is done again
    late = rows.filter((F.col("timestamp") >= cut) | (F.col("event_id") % 3 == 0))
    stored.upsert(late)
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_publish", lambda self, manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            P.refresh(stored, panes)
    # late rows of old hours correct their panes
    assert P.refresh(stored, panes)
    read = panes.read()
    for minutes in (5, 15, 60):
        _same(P.window_aggregates(read, minutes), ST.window_aggregates(rows, f"{minutes} minutes"))
    _same(P.smart_stats(read), ST.smart_stats(rows))
    alerts = rows.select((F.col("event_id") % 2 == 0).alias("is_active"))
    _same(P.system_stats(read, alerts), ST.system_stats(rows, alerts))
    _same(P.sensor_ids(read), ST.sensor_ids(rows))
    with pytest.raises(ValueError):
        P.window_aggregates(read, 7)
    panes.compact()
    stored.compact()
    assert P.refresh(stored, panes) == []
    _same(P.window_aggregates(panes.read(), 15), ST.window_aggregates(rows, "15 minutes"))
