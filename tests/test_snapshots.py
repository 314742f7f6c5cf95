"""The keyed table of snapshots: merges as the keyed store, commits whole or not at all."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from particula.operators import snapshots as SN
from particula.operators.sinks import keep_last, keep_last_at_once

T0 = dt.datetime(2024, 1, 1, 5)
SCHEMA = "sensor_id string, timestamp timestamp, pm2_5 double, pm10 double"


def _batch(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).coalesce(1)


def _rows(df):
    return sorted((tuple(r) for r in df.select("sensor_id", "timestamp", "pm2_5", "pm10").collect()), key=str)


def _hours(n):
    return [T0 + dt.timedelta(hours=i) for i in range(n)]


def _folders(path):
    return set(os.listdir(f"{path}/data"))


def test_upserts_merge_as_a_keyed_store(spark, scratch):
    t = SN.Snapshots(spark, f"{scratch}/t")
    with pytest.raises(ValueError):
        t.read()
    deliveries = [
        [("a", T0, 1.0, 10.0), ("a", T0, 2.0, None), ("b", T0, 4.0, None), (None, T0, 9.0, 9.0), ("c", None, 1.0, 1.0)],
        [("b", T0, None, 5.0), ("a", T0 + dt.timedelta(hours=3), 7.0, 7.0)],
        [("a", T0, 3.0, None), ("d", T0 + dt.timedelta(days=400), None, None)],
    ]
    for rows in deliveries:
        t.upsert(_batch(spark, rows))
    flat = [(*r, i) for i, r in enumerate(r for rows in deliveries for r in rows if r[0] and r[1])]
    want = keep_last(spark.createDataFrame(flat, SCHEMA + ", _ingest int"))
    assert _rows(t.read()) == _rows(want)
    # a replayed batch changes nothing, older versions stay readable
    t.upsert(_batch(spark, deliveries[2]))
    assert _rows(t.read()) == _rows(want) and t.versions() == [1, 2, 3, 4]
    assert _rows(t.read(version=1)) == [("a", T0, 2.0, 10.0), ("b", T0, 4.0, None)]
    assert _rows(t.read(hours=[f"date={T0:%Y-%m-%d}/hour=8"])) == [("a", T0 + dt.timedelta(hours=3), 7.0, 7.0)]
    # compaction and vacuum keep the content
    assert t.compact() == 5 and t.compact() is None
    assert _rows(t.read()) == _rows(want)
    t.vacuum()
    assert _rows(t.read()) == _rows(want) and t.versions() == [5]


def test_an_upsert_writes_only_its_delta(spark, scratch):
    t = SN.Snapshots(spark, f"{scratch}/t")
    t.upsert(_batch(spark, [(f"s{i}", h, 1.0, 2.0) for i in range(50) for h in _hours(3)]))
    first = _folders(t.path)
    t.upsert(_batch(spark, [("s1", T0, 5.0, None)]))
    (new,) = _folders(t.path) - first
    assert spark.read.parquet(f"{t.path}/data/{new}").count() == 1
    # hours in one folder are read as they stand: only the touched one is merged
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert t.read().count() == 150 and "Union" in plan


def test_a_failed_write_leaves_the_old_snapshot(spark, scratch, monkeypatch):
    """Killed between two hour folders, or before the manifest: the table is what it was, and the next write is whole."""
    t = SN.Snapshots(spark, f"{scratch}/t")
    t.upsert(_batch(spark, [("a", h, 1.0, 1.0) for h in _hours(2)]))
    before = _rows(t.read())

    def killed(self, manifest):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(SN.Snapshots, "_publish", killed)
        with pytest.raises(RuntimeError):
            t.upsert(_batch(spark, [("a", h, 2.0, 2.0) for h in _hours(2)]))
    assert _rows(SN.Snapshots(spark, t.path).read()) == before and len(_folders(t.path)) == 2
    # half a write: one of two hour folders stands, without a manifest
    half = f"{t.path}/data/commit=half"
    spark.range(1).select(F.lit("a").alias("sensor_id"), F.lit(T0).alias("timestamp"), F.lit(9.0).alias("pm2_5")).write.parquet(f"{half}/date=2024-01-01/hour=5")
    assert _rows(t.read()) == before
    t.upsert(_batch(spark, [("a", h, 2.0, 2.0) for h in _hours(2)]))
    assert [r[2] for r in _rows(t.read())] == [2.0, 2.0]
    assert "half" in t.vacuum() and [r[2] for r in _rows(t.read())] == [2.0, 2.0]


def test_two_writers(spark, scratch, monkeypatch):
    """A writer that finds its version taken commits on top of the other; the version itself is never overwritten."""
    t, other = (SN.Snapshots(spark, f"{scratch}/t") for _ in range(2))
    t.upsert(_batch(spark, [("a", T0, 1.0, None)]))
    taken = t.manifest() | {"version": 1}
    with pytest.raises(SN.Conflict):
        t._publish(taken)
    real, calls = SN.Snapshots._publish, []

    def late(self, manifest):
        if not calls:
            calls.append(1)
            monkeypatch.setattr(SN.Snapshots, "_publish", real)
            other.upsert(_batch(spark, [("a", T0, 2.0, 2.0)]))
        return real(self, manifest)

    monkeypatch.setattr(SN.Snapshots, "_publish", late)
    assert t.upsert(_batch(spark, [("a", T0, 3.0, None)])) == 3
    assert _rows(t.read()) == [("a", T0, 3.0, 2.0)]
    # a delta that arrives during a compaction comes after it
    monkeypatch.setattr(SN.Snapshots, "_publish", real)
    calls.clear()

    def late_delta(self, manifest):
        if not calls:
            calls.append(1)
            monkeypatch.setattr(SN.Snapshots, "_publish", real)
            other.upsert(_batch(spark, [("a", T0, 4.0, None)]))
        return real(self, manifest)

    monkeypatch.setattr(SN.Snapshots, "_publish", late_delta)
    t.compact()
    assert _rows(t.read()) == [("a", T0, 4.0, 2.0)]


def test_columns_and_types(spark, scratch):
    t = SN.Snapshots(spark, f"{scratch}/t")
    t.upsert(_batch(spark, [("a", T0, 1.0, 1.0)]))
    with pytest.raises(ValueError):
        t.upsert(_batch(spark, [("a", T0, "x", 1.0)], SCHEMA.replace("pm2_5 double", "pm2_5 string")))
    t.upsert(_batch(spark, [("b", T0, 3)], "sensor_id string, timestamp timestamp, aqi int"))
    got = {r.sensor_id: (r.pm2_5, r.aqi) for r in t.read().collect()}
    assert got == {"a": (1.0, None), "b": (None, 3)}
    t.upsert(_batch(spark, []))
    assert t.read().count() == 2


def test_days_instead_of_hours(spark, scratch):
    t = SN.Snapshots(spark, f"{scratch}/t", slots=("date",))
    t.upsert(_batch(spark, [("a", h, 1.0, 2.0) for h in _hours(30)]))
    t.upsert(_batch(spark, [("a", T0, 5.0, None)]))
    assert t.hours_since(0) == ["date=2024-01-01", "date=2024-01-02"] and t.hours_since(1) == ["date=2024-01-01"]
    assert t.read().count() == 30 and t.read(hours=["date=2024-01-02"]).count() == 11
    assert t.compact() == 3 and ("a", T0, 5.0, 2.0) in _rows(t.read())


def test_keep_last_shuffles_its_rows_once(spark):
    """One grouping and no join, with ties, NULLs and rows without order as defined."""
    rows = [
        ("a", T0, 1.0, None, 1), ("a", T0, None, 5.0, 2), ("a", T0, 2.0, None, 2), ("a", T0, 3.0, None, 2), ("a", T0, 9.0, 9.0, None),
        (None, T0, 4.0, None, 1), (None, T0, None, 6.0, 0), ("b", None, None, None, 1), ("c", T0, 1.0, 1.0, None),
    ]
    out = keep_last_at_once(spark.createDataFrame(rows, SCHEMA + ", _ingest int"))
    assert out.columns == ["sensor_id", "timestamp", "pm2_5", "pm10"]
    assert _rows(out) == _rows(keep_last(spark.createDataFrame(rows, SCHEMA + ", _ingest int"))) == sorted([("a", T0, 3.0, 5.0), (None, T0, 4.0, 6.0), ("b", None, None, None), ("c", T0, None, None)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    keys = keep_last_at_once(spark.createDataFrame([("a", T0, 1), ("a", T0, 2)], "sensor_id string, timestamp timestamp, _ingest int"))
    assert [tuple(r) for r in keys.collect()] == [("a", T0)]
