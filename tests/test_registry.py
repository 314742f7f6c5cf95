"""Registered queries: contract, plan shape and oracle agreement at sf0.001."""

import datetime as dt
import math
import os

import duckdb
from pyspark.sql import functions as F
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "is_anomaly" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_no_python_udf_in_plans(spark):
    for name in ("trailing_features", "anomaly_2sigma", "alerts3", "sensor_analytics", "running_features"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_trailing_features_single_shuffle(spark):
    import re

    df = E.queries()["trailing_features"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the input rows move once, on (sensor, bucket); the only other exchange is
    # the bucket-density measurement over partial counts
    row_moves = set(re.findall(r"Exchange hashpartitioning\(sensor_id#\d+, _bucket#\d+L?, \d+\)[^\n]*plan_id=(\d+)", plan))
    assert len(row_moves) == 1, plan


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_agreement(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sdf.columns
    srows = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert len(srows) == len(drows)
    assert srows == drows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_safe_join_keeps_null_keys(spark):
    from particula.operators.joins import null_safe_join

    big = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, x string")
    small = spark.createDataFrame([(1, 10), (None, 20)], "k int, y int")
    assert sorted(map(tuple, null_safe_join(big, small, ["k"]).collect()), key=str) == [(1, "a", 10), (2, "c", None), (None, "b", 20)]
    assert {r.x for r in null_safe_join(big, small, ["k"], "left_semi").collect()} == {"a", "b"}


@pytest.mark.parametrize("name", ["latest_reading", "state_merge", "sensor_statistics", "upsert_keep_last", "first_per_sensor", "fleet_snapshot", "dim_update"])
def test_newest_rows_need_no_sorted_aggregate(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    plan = _plan(df)
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_measured_columns_reach_the_scan_and_a_fresh_file_is_seen(spark, scratch):
    from particula.operators import quality as Q
    from particula.sources.readings import table

    path = f"{scratch}/readings.parquet"
    rows = [(1, "s", 5.0, 6.0, 20.0, 50.0, 30), (2, "s", -5.0, 6.0, 20.0, 50.0, 30)]
    df = spark.createDataFrame(rows, "event_id long, sensor_id string, pm2_5 double, pm10 double, temperature double, humidity double, aqi int")
    df.write.parquet(path)
    for f in (Q.flat_filter, Q.quality_filter):
        out = f(table(spark, scratch, "readings"))
        scan = [line for line in out._jdf.queryExecution().toString().splitlines() if "PushedFilters" in line][-1]
        assert "pm2_5" in scan.split("PushedFilters")[1] and [r.event_id for r in out.collect()] == [1]
    df.write.mode("append").parquet(path)
    assert table(spark, scratch, "readings").count() == 4


def test_queries_leave_no_persisted_frame(spark):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("running_features", "keep_last_n", "membership_flag", "dim_update", "digest_chain"):
        E.queries()[name](spark, SF_SMALL).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held


def test_map_only_and_partial_aggregate_plans(spark):
    q = E.queries()
    alerts = _plan(q["alerts3"](spark, SF_SMALL))
    assert "Exchange" not in alerts
    latest = _plan(q["latest_reading"](spark, SF_SMALL))
    assert "partial_max" in latest
    recent = _plan(q["recent_n"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in recent


def test_column_pruning_reaches_scan(spark):
    df = E.queries()["sensor_ids"](spark, SF_SMALL)
    scan = [line for line in _plan(df).splitlines() if "FileScan parquet" in line][0]
    assert "props" not in scan and "value" not in scan


@pytest.mark.parametrize(
    ("name", "parses", "scans"),
    [("quality_filter", 1, 1), ("flat_validation", 1, 1), ("first_error", 1, 1), ("alerts2", 1, 1), ("alerts3", 1, 1), ("alert_summary", 1, 1), ("trailing_features", 1, 1), ("anomaly_2sigma", 2, 2), ("anomaly_ratio5", 1, 1), ("last10_features", 4, 4), ("sensor_ids", 0, 1)],
)
def test_text_is_parsed_once_a_scan(spark, name, parses, scans):
    """Filters do not parse the JSON column again for every term, and no query scans its table more often than it needs."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") <= parses and plan.count("Relation [") <= scans


def test_stored_tables_carry_no_marks(spark, scratch):
    from particula.operators import sinks as SK
    from particula.sources.readings import PARSED, readings

    SK.write_table(readings(spark, SF_SMALL), f"{scratch}/t")
    assert not any(f.metadata.get(PARSED) for f in spark.read.parquet(f"{scratch}/t").schema)
