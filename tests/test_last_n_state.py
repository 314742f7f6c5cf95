"""ST5 on chunked state: equal to the batch W5 on shuffled input; what a trigger touches does not grow with ``keep``."""

import datetime as dt
import math
import os
import random
import time

import pandas as pd
import pytest

from particula.operators import anomalies as AN
from particula.streaming import last_n_state as L
from particula.streaming.digest_timers import STATE_STORE

SCHEMA = "event_id long, sensor_id string, timestamp timestamp, pm2_5 double, pm10 double, aqi int"
FEATURES = ["pm25_avg", "pm10_avg", "aqi_avg", "pm25_max", "pm25_min", "anomaly_score"]


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _List(_Value):
    def get(self):
        return iter(self.held or [])

    def put(self, rows):
        self.held = list(rows)

    def appendValue(self, row):
        self.held = [*(self.held or []), row]


class _Map:
    def __init__(self):
        self.held, self.bytes = {}, 0

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        self.bytes += len(self.held[k][0])
        return self.held[k]

    def updateValue(self, k, v):
        self.bytes += len(v[0])
        self.held[k] = v

    def removeKey(self, k):
        del self.held[k]


class _Handle:
    def getValueState(self, *_):
        return _Value()

    def getListState(self, *_):
        return _List()

    def getMapState(self, *_):
        return _Map()


def _triggers(keep, sizes, n=10):
    work, r, i, touched = L.LastN(n, keep, 0), random.Random(1), 0, []
    work.init(_Handle())
    out = []
    for size in sizes:
        rows = pd.DataFrame({"t": range(i, i + size), "event_id": range(i, i + size), **{c: [r.random() for _ in range(size)] for c in ("pm2_5", "pm10", "aqi")}})
        before = work.chunks.bytes
        out += list(work.handleInputRows(("s",), iter([rows]), None))
        touched.append(work.chunks.bytes - before)
        i += size
    return pd.concat(out, ignore_index=True), touched, work


@pytest.mark.parametrize("sizes", [[3] * 400, [1] * 300, [200, 1, 500, 31, 32, 33]])
def test_bytes_of_a_trigger_do_not_grow_with_keep(sizes):
    got = {keep: _triggers(keep, sizes) for keep in (10, 100, 1000)}
    assert got[10][0].equals(got[1000][0]) and got[10][0].equals(got[100][0])
    one = L.CHUNK * L._READING.itemsize
    for keep, (_, touched, work) in got.items():
        assert all(b <= 4 * one + 2 * size * L._READING.itemsize for b, size in zip(touched, sizes, strict=True))
        held = sum(len(v[0]) for v in work.chunks.held.values()) // L._READING.itemsize
        assert min(keep, sum(sizes)) <= held < keep + 2 * L.CHUNK
        assert max(k for (k,) in work.chunks.held) == (sum(sizes) - 1) // L.CHUNK
        for (k,), (raw,) in work.chunks.held.items():
            assert L._read(raw)["id"].tolist() == list(range(k * L.CHUNK, min((k + 1) * L.CHUNK, sum(sizes))))


def test_forgotten_chunks_end_the_history():
    frame, _, work = _triggers(100, [40])
    work.chunks.held.clear()
    rows = pd.DataFrame({"t": [100, 101], "event_id": [100, 101], "pm2_5": [1.0, 3.0], "pm10": [1.0, 1.0], "aqi": [1.0, 1.0]})
    (out,) = work.handleInputRows(("s",), iter([rows]), None)
    assert out["pm25_avg"].tolist() == [1.0, 2.0]
    rows = rows.assign(t=[102, 50], event_id=[102, 50])
    late, out = work.handleInputRows(("s",), iter([rows]), None)
    assert late["event_id"].tolist() == [50] and late["is_late"].all() and late["pm25_avg"].isna().all()
    assert math.isclose(out["pm25_avg"][0], 5 / 3)


@pytest.fixture
def rocks(spark):
    name, value = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize("ttl", [None, 60])
def test_shuffled_readings_equal_the_batch(rocks, scratch, ttl):
    r, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, r.choice("ab"), t0 + dt.timedelta(seconds=20 * i + r.randint(0, 15)), r.uniform(1, 99), r.uniform(1, 99), r.randint(1, 300)) for i in range(400)]
    mixed = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.randint(0, 500)))
    folder = os.path.join(scratch, "readings_in")
    for k in range(0, 400, 100):
        rocks.createDataFrame(mixed[k : k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"stored_{ttl}"
    q = L.last_n_stored(source, lateness="10 minutes", ttl_minutes=ttl).writeStream.format("memory").queryName(name).outputMode("append")
    q = q.option("checkpointLocation", os.path.join(scratch, "ck"))
    newest = {k: max(x[2] for x in rows if x[1] == k) for k in "ab"}
    due = [x[0] for x in rows if x[2] <= newest[x[1]] - dt.timedelta(minutes=10)]
    # with a TTL there is always another batch to run, so such a query is stopped
    q = q.trigger(processingTime="1 second").start() if ttl else q.trigger(availableNow=True).start()
    end = time.time() + 120
    while q.isActive and time.time() < end and rocks.table(name).count() < len(due):
        time.sleep(0.5)
    q.stop() if ttl else q.awaitTermination(120)
    assert q.exception() is None
    got = rocks.table(name).collect()
    assert not any(x.is_late for x in got)
    assert sorted(x.event_id for x in got) == due
    want = {x.event_id: x for x in AN.last10_features(rocks.createDataFrame(rows, SCHEMA)).collect()}
    for x in got:
        for c in FEATURES[:1] + FEATURES[3:4] + FEATURES[5:]:
            assert math.isclose(x[c], want[x.event_id][c], rel_tol=1e-9, abs_tol=1e-9)
