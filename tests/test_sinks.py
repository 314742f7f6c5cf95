"""Sinks: partitioned table, keyed upsert, CSV export, DDL, JSON publish, preview."""

import csv
import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from particula import schemas as S
from particula.operators import sinks as SK
from particula.sources.readings import readings

from .conftest import SF_SMALL


def test_write_table_partitioned_and_upsert_idempotent(spark, scratch):
    r = readings(spark, SF_SMALL).select("sensor_id", "timestamp", "pm2_5", "pm10", "aqi")
    path = os.path.join(scratch, "t")
    SK.write_table(r, path, mode="overwrite")
    assert any(d.startswith("date=") for d in os.listdir(path))
    back = spark.read.parquet(path)
    assert back.count() == r.count()
    # upsert of a changed slice rewrites those keys only, twice gives the same table
    first_day = back.agg(F.min("date")).first()[0]
    changed = back.filter(F.col("date") == first_day).drop("date", "hour").withColumn("pm2_5", F.lit(-1.0))
    changed = spark.createDataFrame(changed.collect(), changed.schema)  # the batch must not read the target
    SK.upsert_table(spark, changed, path)
    SK.upsert_table(spark, changed, path)
    after = spark.read.parquet(path)
    assert after.count() == r.count()
    assert after.filter(F.col("pm2_5") == -1.0).count() == changed.count()


def test_export_csv_header_and_order(spark, scratch):
    r = readings(spark, SF_SMALL)
    cols = ["sensor_id", "timestamp", "aqi", "pm2_5"]
    path = os.path.join(scratch, "csv")
    SK.export_csv(r, path, cols)
    files = glob.glob(os.path.join(path, "*.csv"))
    with open(files[0]) as fh:
        header = next(csv.reader(fh))
    assert header == cols
    assert spark.read.option("header", True).csv(path).count() == r.count()


def test_ddl_reads_what_was_written(spark, scratch):
    rows = SK.align(readings(spark, SF_SMALL), default_now=False).drop("event_id")
    for name, write in (("written", SK.write_table), ("upserted", lambda df, path: SK.upsert_table(spark, df, path))):
        loc = os.path.join(scratch, name)
        write(rows, loc)
        table = SK.attach(spark, f"particula_{name}", loc)
        assert table.columns[:3] == ["sensor_id", "timestamp", "location_name"] and table.columns[-2:] == ["date", "hour"]
        assert table.count() == rows.count() and table.agg(F.sum("pm2_5")).first()[0] == pytest.approx(rows.agg(F.sum("pm2_5")).first()[0])
        day = table.agg(F.min("date")).first()[0]
        pruned = table.filter((F.col("date") == day) & (F.col("hour") == 0))
        assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().executedPlan().toString()
        spark.sql(f"DROP TABLE particula_{name}")


def test_bucketed_tables_join_without_a_shuffle(spark, scratch):
    import uuid

    r = readings(spark, SF_SMALL).select("event_id", "sensor_id", "timestamp", "pm2_5")
    names = [f"particula_b{uuid.uuid4().hex[:8]}" for _ in range(2)]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS particula_tests LOCATION '{scratch}/db'")
    left = SK.save_bucketed(r, f"particula_tests.{names[0]}", 4)
    right = SK.save_bucketed(r.groupBy("sensor_id").agg(F.max("pm2_5").alias("top")), f"particula_tests.{names[1]}", 4)
    joined = left.hint("merge").join(right, "sensor_id").groupBy("sensor_id").agg(F.count("top").alias("n"))
    assert joined.agg(F.sum("n")).first()[0] == r.join(r.select("sensor_id").distinct(), "sensor_id").filter("sensor_id IS NOT NULL").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP DATABASE particula_tests CASCADE")


def test_publish_json_files(spark, scratch):
    r = readings(spark, SF_SMALL).limit(5)
    path = os.path.join(scratch, "pub")
    SK.publish(r, "air-quality-data", path=path, fmt="json")
    env = spark.read.json(path)
    assert set(env.columns) >= {"key", "value", "topic"} and env.count() == 5


def test_preview_prints(spark, capsys):
    SK.preview(readings(spark, SF_SMALL), ["sensor_id", "aqi"], n=3)
    out = capsys.readouterr().out
    assert "sensor_id" in out and "only showing top 3 rows" in out


KEYED = "sensor_id string, timestamp timestamp, pm2_5 double, pm10 double"


def _rows(spark, rows, schema=KEYED):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_upsert_fails_without_touching_the_table(spark, scratch):
    path = os.path.join(scratch, "safe")
    t = dt.datetime(2024, 1, 1, 5)
    SK.upsert_table(spark, _rows(spark, [(f"s{i}", t, 1.0, 2.0) for i in range(100)]), path)
    wrong = _rows(spark, [("s1", t, "x", 2.0)], KEYED.replace("pm2_5 double", "pm2_5 string"))
    with pytest.raises(ValueError):
        SK.upsert_table(spark, wrong, path)
    assert spark.read.parquet(path).count() == 100
    broken = os.path.join(scratch, "broken")
    os.makedirs(broken)
    with open(os.path.join(broken, "part-0.parquet"), "w") as fh:
        fh.write("not parquet")
    with pytest.raises(Exception):
        SK.upsert_table(spark, _rows(spark, [("s1", t, 1.0, 2.0)]), broken)
    assert os.listdir(broken) == ["part-0.parquet"]


def test_upsert_last_write_wins_and_null_keeps_old_values(spark, scratch):
    path = os.path.join(scratch, "merge")
    t = dt.datetime(2024, 1, 1, 5)
    batch = _rows(spark, [("a", t, 1.0, 10.0), ("a", t, 2.0, None), ("a", t, 3.0, None), ("b", t, 4.0, None), (None, t, 9.0, 9.0)])
    SK.upsert_table(spark, batch, path)
    got = lambda: {r.sensor_id: (r.pm2_5, r.pm10) for r in spark.read.parquet(path).collect()}
    assert got() == {"a": (3.0, 10.0), "b": (4.0, None)}
    SK.upsert_table(spark, _rows(spark, [("b", t, None, 5.0)]), path)
    SK.upsert_table(spark, _rows(spark, [("b", t, None, 5.0)]), path)
    assert got() == {"a": (3.0, 10.0), "b": (4.0, 5.0)}
    # the order of an explicit sequence, whatever the order of arrival
    seq = _rows(spark, [("a", t, 7.0, None, 2), ("a", t, 6.0, None, 1)], KEYED + ", seq long")
    SK.upsert_table(spark, seq, os.path.join(scratch, "seq"), sequence="seq")
    assert [r.pm2_5 for r in spark.read.parquet(os.path.join(scratch, "seq")).collect()] == [7.0]
