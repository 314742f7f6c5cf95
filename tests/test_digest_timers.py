"""ST7 with event-time timers: equal to the batch digest on shuffled input, and to a walk over the alerts however they are cut."""

import datetime as dt
import os
import random

import pandas as pd
import pytest

from particula.operators.digest import digest_chain
from particula.streaming import digest_timers as D

SCHEMA = "alert_id string, sensor_id string, area string, timestamp timestamp, alert_type string, severity string"
COLS = ["digest_key", "sent_at", "total_alerts", "high_alerts", "medium_alerts", "low_alerts", "top_high", "more_high", "deliver"]


def _walk(rows, cooldown, top):
    out, last, held = [], None, []
    for t, _, severity, label in rows:
        held.append((severity, label))
        if last is None or t - last >= cooldown:
            highs = [x for s, x in held if s == "HIGH"]
            out.append((t, len(held), len(highs), sum(s == "MEDIUM" for s, _ in held), sum(s == "LOW" for s, _ in held), highs[:top]))
            last, held = t, []
    return out


@pytest.mark.parametrize("seed", range(20))
def test_digests_of_any_cuts_equal_a_walk_over_the_alerts(seed):
    r = random.Random(seed)
    rows = sorted((r.randint(0, 400), f"{i:03d}", r.choice(["HIGH", "HIGH", "MEDIUM", "LOW", None]), f"s{i}: x") for i in range(r.randint(1, 150)))
    frame = pd.DataFrame(rows, columns=["t", "id", "severity", "label"])
    cuts = sorted({0, len(rows), *(r.randint(0, len(rows)) for _ in range(4))})
    got, counters = [], None
    for a, b in zip(cuts, cuts[1:], strict=False):
        more, counters = D.cut_digests(frame.iloc[a:b], counters, 25, 3)
        got += more
    assert got == _walk(rows, 25, 3)
    assert D.cut_digests(frame.iloc[:0], counters, 25, 3) == ([], counters)


@pytest.fixture
def rocks(spark):
    name, value = D.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize("key", [None, "area"])
def test_shuffled_alerts_equal_the_batch_digest(rocks, scratch, key):
    r, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [
        (f"a{i:04d}", f"s{r.randint(1, 5)}", r.choice(["east", "west"]), t0 + dt.timedelta(seconds=45 * i + r.randint(0, 40)), "pm25", r.choice(["HIGH", "MEDIUM", "LOW"]))
        for i in range(400)
    ]
    mixed = sorted(rows, key=lambda x: x[3] + dt.timedelta(seconds=r.randint(0, 500)))
    assert [x[0] for x in mixed] != sorted(x[0] for x in mixed)
    # far later, so that the watermark passes all others; it waits for good itself
    mixed.append(("last", "s1", "east", t0 + dt.timedelta(days=2), "pm25", "HIGH"))
    folder = os.path.join(scratch, "alerts_in")
    for k in range(0, len(mixed), 90):
        rocks.createDataFrame(mixed[k : k + 90], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"timed_{key}"
    q = D.timed_digest(source, "10 minutes", key=key).writeStream.format("memory").queryName(name).outputMode("append")
    q = q.option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None

    def plain(df):
        return sorted(tuple(x[c] for c in COLS) for x in df.collect())

    want = plain(digest_chain(rocks.createDataFrame(rows, SCHEMA), key=key))
    assert len(want) > 5
    assert plain(rocks.table(name)) == want


def test_needs_the_state_store(spark):
    source = spark.readStream.format("rate").load().selectExpr("cast(value as string) alert_id", "'s' sensor_id", "timestamp", "'x' alert_type", "'LOW' severity")
    with pytest.raises(ValueError, match="RocksDB"):
        D.timed_digest(source)


def test_successors_use_running_frames_only(spark):
    """A frame from the row to the end of its bucket reads the rest of the bucket at every row."""
    from particula.operators import digest

    rows = [("a", i * 7, f"x{i % 90:03d}", "HIGH", "s: t") for i in range(300)] + [("a", 10_000, "y", "LOW", "s: t"), ("b", 5, "z", "LOW", "s: t")]
    a = spark.createDataFrame(rows, "k string, t long, id string, severity string, label string").selectExpr("*", "t div 50 AS b")
    succ = digest.successors(a, 50)
    assert "unboundedfollowing" not in succ._jdf.queryExecution().optimizedPlan().toString()

    def following(k, t):
        return min(((r[1], r[2]) for r in rows if r[0] == k and r[1] >= t + 50), default=(None, None))

    assert sorted((r.k, r.t, r.id, r.nt, r.nid) for r in succ.collect() if r.nid) == sorted((k, t, i, *following(k, t)) for k, t, i, *_ in rows if following(k, t)[0] is not None)
    assert succ.count() == len(rows)
