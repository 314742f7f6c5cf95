"""Stream = batch checks on a file source (FIXTURES section 8): readings as
JSON envelopes in time-ordered files, one file per trigger, plus a file of
re-deliveries and one of rows later than the watermark."""

import datetime as dt
import json
import math
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from particula.operators import alerts as AL
from particula.operators import anomalies as AN
from particula.operators import lookup as LK
from particula.operators import quality as Q
from particula.operators import stats as ST
from particula.sources.readings import readings
from particula.streaming import jobs as J

from .conftest import SF_SMALL

N_FILES = 6
COLS = ["event_id", "sensor_id", "area_type", "pm2_5", "pm10", "aqi", "temperature", "humidity", "battery_level",
        "signal_strength"]


def _write_files(folder, pdf, n_files, start_mtime):
    os.makedirs(folder, exist_ok=True)
    chunks = [pdf.iloc[i::1] for i in range(1)]
    bounds = [round(len(pdf) * i / n_files) for i in range(n_files + 1)]
    for i in range(n_files):
        part = pdf.iloc[bounds[i] : bounds[i + 1]]
        path = os.path.join(folder, f"part-{i:03d}.json")
        with open(path, "w") as fh:
            for r in part.itertuples(index=False):
                fh.write(json.dumps({"key": r.key, "value": r.value, "topic": r.topic, "timestamp": r.ts_text}) + "\n")
        os.utime(path, (start_mtime + i, start_mtime + i))
    del chunks


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    r = readings(spark, SF_SMALL).orderBy("timestamp", "event_id")
    ts_text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.to_json(F.struct(*[F.col(c) for c in COLS], ts_text.alias("timestamp")))
    pdf = r.select(
        F.col("sensor_id").alias("key"), payload.alias("value"), F.lit("air-quality-data").alias("topic"),
        ts_text.alias("ts_text"),
    ).toPandas()
    folder = str(tmp_path_factory.mktemp("stream_src"))
    _write_files(folder, pdf, N_FILES, time.time() - 1000)
    return folder, len(pdf)


def _memory(df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    return q.trigger(availableNow=True).start()


def _src(spark, folder, per_trigger=1):
    return J.readings_stream(spark, "json", path=folder, max_per_trigger=per_trigger)


def test_parse_stream_matches_table(spark, stream_dir, scratch):
    folder, n = stream_dir
    q = _memory(_src(spark, folder), "parsed", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = spark.table("parsed")
    assert got.count() == n
    base = readings(spark, SF_SMALL)
    diff = got.select("event_id", "sensor_id", "timestamp", "pm2_5", "aqi").exceptAll(
        base.select("event_id", "sensor_id", "timestamp", "pm2_5", "aqi")
    )
    assert diff.count() == 0


def test_windowed_aggregates_equal_batch(spark, stream_dir, scratch):
    folder, _ = stream_dir
    agg = J.windowed_aggregates(_src(spark, folder), "15 minutes")
    q = _memory(agg, "win15", "complete", os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = {(r.sensor_id, r.window_start): (r.total_readings, r.max_pm2_5, r.avg_pm2_5) for r in spark.table("win15").collect()}
    ref = {
        (r.sensor_id, r.window_start): (r.total_readings, r.max_pm2_5, r.avg_pm2_5)
        for r in ST.window_aggregates(readings(spark, SF_SMALL), "15 minutes").collect()
    }
    assert set(got) == set(ref)
    for k, (n, mx, av) in ref.items():
        g = got[k]
        assert g[0] == n and g[1] == mx
        assert (av is None and g[2] is None) or math.isclose(g[2], av, rel_tol=1e-9)


def test_watermark_drops_late_rows(spark, scratch):
    folder = os.path.join(scratch, "late")
    rows = [
        ("s", "2024-01-01T00:00:00Z", 10.0),
        ("s", "2024-01-01T00:30:00Z", 20.0),
        ("s", "2024-01-01T00:40:00Z", 30.0),
        # arrives after the watermark (10 min behind 00:40) passed its window:
        # the 00:00 window was already emitted and this row is dropped
        ("s", "2024-01-01T00:01:00Z", 99.0),
    ]
    pdf = pd.DataFrame(
        [
            {"key": k, "value": json.dumps({"sensor_id": k, "timestamp": t, "pm2_5": v, "pm10": v, "event_id": i}),
             "topic": "air-quality-data", "ts_text": t}
            for i, (k, t, v) in enumerate(rows)
        ]
    )
    _write_files(folder, pdf, 4, time.time() - 500)
    agg = J.windowed_aggregates(_src(spark, folder), "5 minutes", watermark="10 minutes")
    q = _memory(agg, "late_win", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    rows_out = spark.table("late_win").collect()
    got = {r.window_start.minute: r.max_pm2_5 for r in rows_out}
    assert got.get(0) == 10.0 and sum(1 for r in rows_out if r.window_start.minute == 0) == 1


def test_dedup_within_watermark(spark, stream_dir, scratch):
    folder, n = stream_dir
    dup = os.path.join(scratch, "dup")
    os.makedirs(dup)
    files = sorted(os.listdir(folder))
    for i, f in enumerate(files + files[:2]):  # the first two files are delivered twice
        src = os.path.join(folder, f)
        dst = os.path.join(dup, f"{i:03d}-{f}")
        with open(src) as a, open(dst, "w") as b:
            b.write(a.read())
        os.utime(dst, (time.time() - 900 + i, time.time() - 900 + i))
    q = _memory(J.dedup(_src(spark, dup), "1000 days"), "dedup", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    assert spark.table("dedup").count() == n


def test_last_n_state_equals_batch_w5(spark, stream_dir, scratch):
    folder, _ = stream_dir
    s = Q.first_error_filter(_src(spark, folder))
    q = _memory(J.last_n_features(s), "lastn", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = {r.event_id: (r.pm25_avg, r.pm25_max, r.anomaly_score) for r in spark.table("lastn").collect()}
    base = Q.first_error_filter(readings(spark, SF_SMALL))
    ref = {r.event_id: (r.pm25_avg, r.pm25_max, r.anomaly_score) for r in AN.last10_features(base).collect()}
    assert set(got) == set(ref)
    for k, v in ref.items():
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[k], v)), (k, got[k], v)


def test_latest_state_equals_batch_merge(spark, stream_dir, scratch):
    folder, _ = stream_dir
    cols = ["pm2_5", "pm10", "battery_level"]
    q = _memory(J.latest_state(_src(spark, folder), cols), "latest", "update", os.path.join(scratch, "ck"))
    q.awaitTermination()
    got_rows = spark.table("latest").collect()
    last = {}
    for r in got_rows:  # update mode appends a new version per trigger; keep the newest
        if r.sensor_id not in last or r.last_seen >= last[r.sensor_id].last_seen:
            last[r.sensor_id] = r
    ref = {r.sensor_id: r for r in LK.state_merge(readings(spark, SF_SMALL), cols).collect()}
    assert set(last) == set(ref)
    for k, r in ref.items():
        assert (last[k].pm2_5, last[k].pm10, last[k].battery_level) == (r.pm2_5, r.pm10, r.battery_level)


def _digest_reference(alerts, cooldown_us, top=3):
    out, last, buf = [], None, []
    for a in alerts:
        buf.append(a)
        if last is None or a["t"] - last >= cooldown_us:
            high = [b for b in buf if b["severity"] == "HIGH"]
            out.append((a["t"], len(buf), len(high), max(len(high) - top, 0)))
            last, buf = a["t"], []
    return out


def test_alert_digest_matches_sequential_reference(spark, stream_dir, scratch):
    folder, _ = stream_dir
    alerts = AL.pollution_alerts(_src(spark, folder), tiers=3)
    q = _memory(J.alert_digest(alerts), "digest", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = sorted(
        (int(r.sent_at.timestamp() * 1_000_000), r.total_alerts, r.high_alerts, r.more_high)
        for r in spark.table("digest").collect()
    )
    batch = AL.pollution_alerts(readings(spark, SF_SMALL), tiers=3).select(
        F.unix_micros("timestamp").alias("t"), "alert_id", "severity"
    ).orderBy("t", "alert_id").collect()
    ref = _digest_reference([r.asDict() for r in batch], 30 * 60_000_000)
    assert got == ref


def test_pipeline_idempotent_and_counted(spark, stream_dir, scratch):
    folder, n = stream_dir
    table, alerts_out = os.path.join(scratch, "table"), os.path.join(scratch, "alerts")
    ck = os.path.join(scratch, "ck")
    listener = J.CounterListener("ingest")
    spark.streams.addListener(listener)
    try:
        src = J.observe_ingest(_src(spark, folder, per_trigger=2), "ingest")
        q = J.start_stream_job(src, table, alerts_out, ck, trigger={"availableNow": True})
        q.awaitTermination()
        counters = q.counters.totals
        assert counters["total"] == n and counters["valid"] + counters["invalid"] == n
        out = spark.read.parquet(table)
        assert out.count() == out.select("sensor_id", "timestamp").distinct().count()
        first = out.count()
        # replaying the same input from a fresh checkpoint rewrites the same keys
        q2 = J.start_stream_job(_src(spark, folder, per_trigger=3), table, alerts_out, ck + "2", trigger={"availableNow": True})
        q2.awaitTermination()
        assert spark.read.parquet(table).count() == first
        time.sleep(1)
        assert listener.totals.get("records", 0) == n
    finally:
        spark.streams.removeListener(listener)


def test_router_multi_topic_and_trigger_sizes(spark, scratch):
    from particula.sources.connectors import read_batch, read_stream

    folder = os.path.join(scratch, "topics")
    topics = ["air-quality-data", "smart-sensor-data", "air-quality-alerts", "legacy-topic"]
    rows = [
        {"key": f"s{i % 3}", "value": json.dumps({"sensor_id": f"s{i % 3}", "pm2_5": float(i), "alert_id": f"x{i}", "timestamp": f"2024-01-01T00:{i:02d}:00Z"}),
         "topic": topics[i % 4], "ts_text": f"2024-01-01T00:{i:02d}:00Z"}
        for i in range(40)
    ]
    _write_files(folder, pd.DataFrame(rows), 4, time.time() - 300)
    env = read_stream(spark, "json", path=folder, max_per_trigger=1)
    q = J.start_router(env, os.path.join(scratch, "routed"), os.path.join(scratch, "ck"), trigger={"availableNow": True})
    q.awaitTermination()
    # ST4: one file per trigger -> four data batches
    assert sum(1 for p in q.recentProgress if p["numInputRows"] > 0) == 4
    counts = {t: spark.read.parquet(os.path.join(scratch, "routed", t)).count() for t in os.listdir(os.path.join(scratch, "routed"))}
    assert counts == {"air_quality_data": 10, "smart_virtual_sensors": 10, "air_quality_alerts": 10}
    assert q.dropped["rows"] == 10
    # Bounded read of one topic from the same files
    assert read_batch(spark, "json", path=folder, topics="smart-sensor-data").count() == 10


def test_run_available_now_poll(spark, stream_dir, scratch):
    folder, n = stream_dir
    out = os.path.join(scratch, "poll_out")
    ck = os.path.join(scratch, "ck")

    def writer():
        return _src(spark, folder, per_trigger=3).select("event_id", "sensor_id").writeStream.format("parquet").option(
            "path", out
        )

    J.run_available_now(writer, ck)
    assert spark.read.parquet(out).count() == n
    J.run_available_now(writer, ck)  # second poll: nothing new, nothing duplicated
    assert spark.read.parquet(out).count() == n


@pytest.mark.parametrize("rows", [None, 1, 40])
def test_batch_digest_chain_matches_sequential_reference(spark, monkeypatch, rows):
    from particula.operators import digest
    from particula.operators.digest import digest_chain

    if rows:  # many blocks, some of which no digest falls in
        monkeypatch.setattr(digest, "BLOCK_ROWS", rows)
    alerts = AL.pollution_alerts(readings(spark, SF_SMALL), tiers=3)
    got = sorted(
        (int(r.sent_at.timestamp() * 1_000_000), r.total_alerts, r.high_alerts, r.more_high)
        for r in digest_chain(alerts).collect()
    )
    batch = alerts.select(F.unix_micros("timestamp").alias("t"), "alert_id", "severity").orderBy("t", "alert_id").collect()
    ref = _digest_reference([r.asDict() for r in batch], 30 * 60_000_000)
    assert got == ref


def test_last_n_state_expires_idle_sensors(spark, scratch):
    folder = os.path.join(scratch, "ttl")
    rows = [
        {"key": "s", "value": json.dumps({"sensor_id": f"s{i % 2}", "event_id": i, "timestamp": f"2024-01-01T00:{i:02d}:00Z",
                                          "pm2_5": 10.0 + i, "pm10": 20.0, "aqi": 30}),
         "topic": "air-quality-data", "ts_text": "2024-01-01T00:00:00Z"}
        for i in range(20)
    ]
    _write_files(folder, pd.DataFrame(rows), 2, time.time() - 100)
    s = Q.first_error_filter(_src(spark, folder))
    # processing-time timeouts run in idle no-data batches, so this query uses
    # a processing-time trigger and is stopped once the output is complete
    q = (
        J.last_n_features(s, ttl_minutes=0.02).writeStream.format("memory").queryName("ttl_out").outputMode("append")
        .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(processingTime="1 second").start()
    )
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("ttl_out").count() < 20:
            time.sleep(1)
        assert spark.table("ttl_out").count() == 20
        deadline = time.time() + 30
        state_rows = None
        while time.time() < deadline:
            time.sleep(2)
            prog = q.lastProgress
            state_rows = prog["stateOperators"][0]["numRowsTotal"] if prog and prog["stateOperators"] else None
            if state_rows == 0:
                break
        assert state_rows == 0  # both sensors went idle and their history was dropped
    finally:
        q.stop()


def test_last_n_drops_rows_older_than_state(spark, scratch):
    folder = os.path.join(scratch, "ooo")
    times = ["2024-01-01T10:00:00Z", "2024-01-01T10:05:00Z", "2024-01-01T09:00:00Z", "2024-01-01T10:10:00Z"]
    rows = [
        {"key": "s", "value": json.dumps({"sensor_id": "s", "event_id": i, "timestamp": t, "pm2_5": 10.0 + i,
                                          "pm10": 20.0, "aqi": 30}),
         "topic": "air-quality-data", "ts_text": t}
        for i, t in enumerate(times)
    ]
    _write_files(folder, pd.DataFrame(rows), 4, time.time() - 100)
    q = _memory(J.last_n_features(Q.first_error_filter(_src(spark, folder))), "ooo", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = spark.table("ooo").collect()
    assert sorted(r.event_id for r in got if not r.is_late) == [0, 1, 3]
    # the 09:00 reading came after 10:05 was answered: it comes out, marked and without features
    assert [(r.event_id, r.pm25_avg) for r in got if r.is_late] == [(2, None)]


def test_trailing_features_stream_equal_batch(spark, stream_dir, scratch):
    folder, n = stream_dir
    q = _memory(J.trailing_features_stream(_src(spark, folder)), "trail", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    cols = [a.out for a in AN.W1_AGGS]
    got = {r.event_id: tuple(r[c] for c in cols) for r in spark.table("trail").collect()}
    ref = {r.event_id: tuple(r[c] for c in cols) for r in AN.trailing_features(readings(spark, SF_SMALL)).collect()}
    assert len(got) == n and set(got) == set(ref)
    same = lambda a, b: a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    assert all(same(a, b) for k in ref for a, b in zip(got[k], ref[k], strict=True))


@pytest.mark.parametrize("job, frame", [("trailing_features_stream", "trailing_features"), ("last_n_features", "last10_features")])
def test_out_of_order_within_the_lateness_equals_batch(spark, scratch, job, frame):
    """Rows shuffled within ten minutes over several triggers: with that lateness all but the waiting tail are answered as in batch."""
    import random

    r, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, r.choice("ab"), t0 + dt.timedelta(seconds=20 * i + r.randint(0, 15)), r.uniform(1, 99), r.uniform(1, 99), r.randint(1, 300), 20.0, 50.0) for i in range(400)]
    schema = "event_id long, sensor_id string, timestamp timestamp, pm2_5 double, pm10 double, aqi int, temperature double, humidity double"
    mixed = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.randint(0, 500)))
    folder = os.path.join(scratch, "ooo_in")
    for k in range(0, 400, 80):
        spark.createDataFrame(mixed[k : k + 80], schema).coalesce(1).write.mode("append").parquet(folder)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = _memory(getattr(J, job)(src, lateness="10 minutes"), f"late_{job}", "append", os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = spark.table(f"late_{job}").collect()
    assert not any(x.is_late for x in got)
    ref = {x.event_id: x for x in getattr(AN, frame)(spark.createDataFrame(rows, schema)).collect()}
    newest = {k: max(x[2] for x in rows if x[1] == k) for k in "ab"}
    assert {x.event_id for x in got} == {x[0] for x in rows if x[2] <= newest[x[1]] - dt.timedelta(minutes=10)}
    for x in got:
        for c in ("pm25_5min_avg", "pm25_5min_max", "aqi_5min_min") if job.startswith("trail") else ("pm25_avg", "pm25_max", "anomaly_score"):
            assert math.isclose(x[c], ref[x.event_id][c], rel_tol=1e-9, abs_tol=1e-9)


def test_device_job_is_idempotent_and_merges_state(spark, scratch):
    t = lambda m: f"2024-01-01T10:{m:02d}:00Z"
    rows = [
        {"sensor_id": "a", "timestamp": t(1), "air_quality_index": 160, "battery_level": 90, "signal_strength": 80, "pm2_5": 10.0},
        {"sensor_id": "a", "timestamp": t(3), "air_quality_index": "Good", "battery_level": 10, "signal_strength": 80, "pm2_5": 20.0},
        {"sensor_id": "a", "timestamp": t(3), "air_quality_index": "Good", "battery_level": 10, "signal_strength": 80, "pm2_5": 20.0},
        {"sensor_id": "b", "timestamp": t(2), "air_quality_index": 20, "battery_level": "bad", "signal_strength": 5},
        {"sensor_id": "a", "timestamp": t(2), "air_quality_index": 30, "signal_strength": 80, "pm2_5": 30.0},
    ]
    base = os.path.join(scratch, "dev")
    frame = lambda part: J.PS.parse_device(spark.createDataFrame([(json.dumps(r),) for r in part], "value string"))
    tables = ("readings", "alerts", "stats", "state")
    for part in (rows[:3], rows[3:], rows[3:], rows[:3]):
        J.device_batch(spark, frame(part), base)
    got = {n: spark.read.parquet(f"{base}/{n}") for n in tables}
    assert got["readings"].count() == 4
    assert sorted((r.sensor_id, r.alert_type) for r in got["alerts"].collect()) == [("a", "air_quality_alert"), ("a", "battery_low"), ("b", "signal_weak")]
    stats = {r.sensor_id: r for r in got["stats"].collect()}
    assert (stats["a"].total_readings, stats["a"].avg_pm2_5, stats["a"].avg_aqi) == (3, 20.0, 95.0) and stats["b"].total_readings == 1
    state = {r.sensor_id: r for r in J.device_state(spark, base).collect()}
    # the label and the late row leave the newest number in place
    assert (state["a"].air_quality_index, state["a"].battery_level, state["a"].pm2_5) == (30.0, 10.0, 20.0)
    assert (state["b"].battery_level, state["b"].signal_strength) == (None, 5.0)


def test_polls_read_each_row_once_and_again_after_a_failure(spark, scratch):
    from particula.sources.connectors import poll, read_stream

    folder, bookmark = os.path.join(scratch, "log"), os.path.join(scratch, "bookmark")
    got = []

    def add(first, last):
        rows = [(str(i), f"v{i}", "t", dt.datetime(2024, 1, 1)) for i in range(first, last)]
        spark.createDataFrame(rows, "key string, value string, topic string, timestamp timestamp").write.mode("append").json(folder)

    def keep(rows, batch_id):
        got.extend(sorted(r.key for r in rows.collect()))

    def fail(rows, batch_id):
        raise RuntimeError("store is down")

    def new():
        return read_stream(spark, "json", path=folder)

    add(0, 5)
    assert poll(new(), keep, bookmark) == 5 and got == ["0", "1", "2", "3", "4"]
    assert poll(new(), keep, bookmark) == 0
    add(5, 8)
    with pytest.raises(Exception, match="store is down"):
        poll(new(), fail, bookmark)
    add(8, 9)
    got.clear()
    assert poll(new(), keep, bookmark) == 4 and sorted(got) == ["5", "6", "7", "8"]
