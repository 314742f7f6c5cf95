"""Structured Streaming forms (ST1-ST9, S1/S3/S4 on streams, S8/S11/S15 sinks).

* ST1  `start_stream_job`: foreachBatch micro-batch pipeline (validate -> filter
       -> features -> anomalies -> alerts -> keyed upsert), batch persisted
       once, counters by `Observation`, idempotent on replay.
* ST2  `windowed_aggregates`: event-time windows with a watermark.
* ST3  `run_available_now`: process what is there, then stop (poll loop).
* ST4  `max_per_trigger` on the source.
* ST5  `last_n_features`: keyed state of the last `keep` readings per sensor
       (bounded), emits last-n features per reading, late readings marked;
       `last_n_state.last_n_stored` writes new readings only.
* ST6  `latest_state`: keyed newest non-missing value per field (update mode).
* ST7  `alert_digest`: 30-minute cooldown digest, bounded state per key;
       `digest_timers.timed_digest` takes alerts out of order.
* ST8  `CounterListener` + observed metrics.
* ST9  `dedup`: drop re-deliveries within the watermark.
* W1-W3 on a stream: `trailing_features_stream`, keyed state of the last
       frame length of readings, equal to the batch features.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from .. import schemas as S
from ..functions.aqi import aqi_score
from ..operators import alerts as AL
from ..operators import anomalies as AN
from ..operators import newest as NW
from ..operators import quality as Q
from ..operators import sinks as SK
from ..operators import stats as ST
from ..sources import parse as PS
from ..session import cut_lineage
from ..sources.connectors import read_stream

# ----------------------------------------------------------------- sources


def readings_stream(
    spark: SparkSession,
    fmt: str = "kafka",
    *,
    topics=("air-quality-data",),
    bootstrap: str | None = None,
    path: str | None = None,
    max_per_trigger: int | None = None,
    starting: str = "latest",
) -> DataFrame:
    """S1 + S4: envelope stream -> canonical readings (any wire shape).

    `event_id` is taken from the payload when present, else a hash of the
    record, so replays keep the same id.
    """
    env = read_stream(
        spark, fmt, topics=list(topics), bootstrap=bootstrap, path=path, max_per_trigger=max_per_trigger,
        starting=starting,
    )
    env = env.withColumn(
        "event_id",
        F.coalesce(F.get_json_object("value", "$.event_id").try_cast("bigint"), F.xxhash64("key", "value")),
    )
    out = PS.parse_readings(env, keep=("event_id", "topic"), arrival="timestamp")
    return out.withColumn("aqi", F.coalesce(F.col("aqi"), aqi_score("pm2_5", "pm10")))


# ----------------------------------------------------------------- ST1


def process_batch(batch: DataFrame) -> dict[str, DataFrame]:
    """The micro-batch transformation (pure, so it is tested in batch too).

    As in the reproduced job, trailing features see only the rows of the
    batch; ST2/ST5 give the event-time-correct forms.
    """
    validated = Q.validate(batch).withColumn("processed_at", F.current_timestamp())
    filtered = Q.quality_filter(validated)
    # trailing features and 2-sigma scores in one window pass over the batch
    feats = AN.anomaly_2sigma(filtered, extra=AN.W1_AGGS)
    from ..functions.aqi import alert_level, alert_message, has_alert

    scored = (
        feats.withColumn("alert_level", alert_level("aqi"))
        .withColumn("alert_message", alert_message("aqi"))
        .withColumn("has_alert", has_alert("aqi"))
        .withColumn("processing_version", F.lit(C.PROCESSING_VERSION))
    )
    alerts = AL.pollution_alerts(batch, tiers=3)
    return {"validated": validated, "scored": scored, "alerts": alerts}


class BatchCounters:
    """ST8 in foreachBatch: totals across batches from one observed pass each."""

    def __init__(self):
        self.lock = threading.Lock()
        self.totals = {"batches": 0, "total": 0, "valid": 0, "invalid": 0, "alerts": 0}

    def add(self, metrics: dict):
        with self.lock:
            self.totals["batches"] += 1
            for k in ("total", "valid", "invalid", "alerts"):
                self.totals[k] += int(metrics.get(k, 0) or 0)


def start_stream_job(
    stream: DataFrame,
    table_path: str,
    alerts_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    counters: BatchCounters | None = None,
    query_name: str | None = None,
    upsert=SK.upsert_table,
):
    """ST1: start the micro-batch pipeline. Re-running an epoch rewrites the
    same keys (keep-last upsert), so recovery after a lost executor or a
    restart from the checkpoint is idempotent. `upsert=snapshots.upsert` writes each batch as one commit of a delta."""
    counters = counters or BatchCounters()

    def handle(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        b = batch.persist()
        try:
            parts = process_batch(b)
            obs = Observation(f"batch_{epoch_id}")
            validated = parts["validated"].observe(
                obs,
                F.count(F.lit(1)).alias("total"),
                F.count_if(F.col("is_valid")).alias("valid"),
                F.count_if(~F.col("is_valid")).alias("invalid"),
                F.count_if(F.col("aqi") >= C.HAS_ALERT_AQI).alias("alerts"),
            )
            validated.write.format("noop").mode("overwrite").save()
            counters.add(obs.get)
            scored = parts["scored"]
            upsert(spark, scored.drop("topic"), table_path)
            upsert(spark, parts["alerts"], alerts_path, key=("alert_id",))
        finally:
            b.unpersist()

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"processingTime": "10 seconds"}))
    q = w.start()
    q.counters = counters  # type: ignore[attr-defined]
    return q


# ----------------------------------------------------------------- S3 on streams


def _typed(fields) -> Callable[[DataFrame], DataFrame]:
    """Parser of a JSON value with the given columns; a missing time becomes now."""
    wire = T.StructType([T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType) for f in fields])

    def parse(rows: DataFrame) -> DataFrame:
        d = rows.select(F.from_json("value", wire).alias("d")).select("d.*")
        return d.withColumn("timestamp", PS.parse_timestamp(F.col("timestamp")))

    return parse


# table of a topic: its parser and its key
TYPED_TABLES = {
    "air_quality_data": (lambda rows: SK.align(PS.parse_readings(rows, arrival="timestamp")), SK.READINGS_KEY),
    "smart_virtual_sensors": (PS.parse_device, SK.READINGS_KEY),
    "smart_sensor_alerts": (_typed(S.DEVICE_ALERTS.fields), ("alert_id",)),
    "air_quality_alerts": (_typed(S.ALERTS.fields), ("alert_id",)),
    "smart_sensor_stats": (
        _typed([*(T.StructField(c, T.StringType()) for c in ("sensor_id",)), T.StructField("timestamp", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ST.SMART_COLS)]),
        SK.READINGS_KEY,
    ),
}


def route_typed(batch: DataFrame, mapping: dict = C.TOPIC_TABLES) -> dict[str, DataFrame]:
    """Each mapped topic's records parsed into its table's columns."""
    return {table: TYPED_TABLES[table][0](batch.filter(F.col("topic") == topic)) for topic, table in mapping.items()}


def start_router(
    envelopes: DataFrame,
    base_path: str,
    checkpoint: str,
    mapping: dict = C.TOPIC_TABLES,
    trigger: dict | None = None,
):
    """One subscription over several topics, each record parsed and
    upserted into the typed table of its topic (`base_path/<table>`), so a
    replayed batch changes nothing. Rows of unmapped topics are counted."""
    dropped = {"rows": 0}

    def handle(batch: DataFrame, epoch_id: int):
        batch = batch.persist()
        try:
            topics = {r.topic: r["count"] for r in batch.groupBy("topic").count().collect()}
            for table, rows in route_typed(batch, {t: v for t, v in mapping.items() if t in topics}).items():
                SK.upsert_table(batch.sparkSession, rows, f"{base_path}/{table}", key=TYPED_TABLES[table][1])
            dropped["rows"] += sum(n for t, n in topics.items() if t not in mapping)
        finally:
            batch.unpersist()

    w = envelopes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    q = w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    q.dropped = dropped  # type: ignore[attr-defined]
    return q


DEVICE_STATE_COLS = ["air_quality_index", "pm2_5", "pm10", "battery_level", "signal_strength", "city", "coordinates"]


def device_batch(spark: SparkSession, devices: DataFrame, base_path: str) -> None:
    """One micro-batch of parsed device readings, landed in four tables.

    `readings` and `alerts` by key; `stats`, the 5-minute windows that the batch
    touches, computed again from the stored readings of their hours; `state`,
    the rows that carry each sensor's newest values, at most one a field.
    """
    devices = devices.dropna(subset=["sensor_id", "timestamp"])
    SK.upsert_table(spark, devices, f"{base_path}/readings")
    alerts = AL.device_alerts(devices, aqi="air_quality_index")
    if not alerts.isEmpty():
        SK.upsert_table(spark, alerts, f"{base_path}/alerts", key=("alert_id",))
    hours = devices.select(F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour")).distinct()
    stored = spark.read.parquet(f"{base_path}/readings").join(hours, ["date", "hour"], "left_semi")
    touched = devices.select("sensor_id", F.window("timestamp", "5 minutes")["start"].alias("window_start")).distinct()
    stats = ST.smart_stats(stored, "5 minutes", aqi="air_quality_index").join(touched, ["sensor_id", "window_start"], "left_semi")
    SK.upsert_table(spark, stats, f"{base_path}/stats", key=("sensor_id", "window_start"), by="window_start")
    rows = devices.select("sensor_id", "timestamp", *DEVICE_STATE_COLS)
    path = f"{base_path}/state"
    if SK.table_exists(spark, path):
        rows = spark.read.parquet(path).unionByName(rows)
    carrying = NW.carrying_rows(rows, ["sensor_id"], DEVICE_STATE_COLS, "timestamp").distinct()
    # materialised before the folder it was read from is overwritten
    cut_lineage(carrying).write.mode("overwrite").parquet(path)


def device_state(spark: SparkSession, base_path: str) -> DataFrame:
    """The newest non-missing value of every field per device (J3) from the state table."""
    rows = spark.read.parquet(f"{base_path}/state").withColumn("_tie", F.lit(0))
    return NW.newest_values(rows, ["sensor_id"], DEVICE_STATE_COLS, "timestamp", "_tie")


def start_device_job(envelopes: DataFrame, base_path: str, checkpoint: str, trigger: dict | None = None):
    """Device readings off the bus: parse, land, alert, 5-minute stats and latest state; replays change nothing."""

    def handle(batch: DataFrame, epoch_id: int):
        devices = PS.parse_device(batch).persist()
        try:
            device_batch(batch.sparkSession, devices, base_path)
        finally:
            devices.unpersist()

    w = envelopes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


# ----------------------------------------------------------------- ST2 / ST9


def windowed_aggregates(
    stream: DataFrame, size: str = "5 minutes", slide: str | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """ST2: per-sensor event-time window aggregates; a window is emitted once
    the watermark passes its end, rows later than the watermark are dropped."""
    w = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    return (
        stream.withWatermark("timestamp", watermark)
        .groupBy(w.alias("w"), "sensor_id")
        .agg(
            F.avg("pm2_5").alias("avg_pm2_5"),
            F.max("pm2_5").alias("max_pm2_5"),
            F.min("pm2_5").alias("min_pm2_5"),
            F.avg("pm10").alias("avg_pm10"),
            F.max("pm10").alias("max_pm10"),
            F.min("pm10").alias("min_pm10"),
            F.count(F.lit(1)).alias("total_readings"),
        )
        .select("sensor_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[
            "avg_pm2_5", "max_pm2_5", "min_pm2_5", "avg_pm10", "max_pm10", "min_pm10", "total_readings"
        ])
    )


def dedup(stream: DataFrame, watermark: str = "10 minutes", key=("sensor_id", "timestamp")) -> DataFrame:
    """ST9: drop re-delivered readings (same key) within the watermark."""
    return stream.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(list(key))


# ----------------------------------------------------------------- ST3


def run_available_now(writer_factory, checkpoint: str):
    """ST3: one 'poll': process everything available now, then stop."""
    q = writer_factory().option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ----------------------------------------------------------------- ST5

# Keyed event-time state, shared by ST5 and the streamed W1-W3. A key's readings are kept as arrays in the
# order (time, id): first those already answered, then those that wait for the lateness to pass.
KEYED_STATE = "ts array<long>, ids array<long>, vals array<array<double>>, frontier long"
LATE_OUT = ", is_late boolean"


def _over(op, values: np.ndarray, low: np.ndarray, high: np.ndarray, empty: float) -> np.ndarray:
    """op over values[low:high] for every pair (low < high), NaN counting as `empty`."""
    padded = np.append(np.where(np.isnan(values), empty, values), empty)
    return op.reduceat(padded, np.column_stack([low, high]).ravel())[::2]


def _frame_stats(values: np.ndarray, low: np.ndarray, high: np.ndarray, func: str) -> np.ndarray:
    """avg, max or min of the non-NaN values of every frame; NaN where there is none."""
    n = _over(np.add, np.where(np.isnan(values), 0.0, 1.0), low, high, 0.0)
    if func == "avg":
        total = _over(np.add, values, low, high, 0.0)
        return np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
    found = _over(np.maximum if func == "max" else np.minimum, values, low, high, -np.inf if func == "max" else np.inf)
    return np.where(n > 0, found, np.nan)


def _keyed_fn(inputs: list[str], answer, retain, lateness_us: int, columns: list[str], ttl_ms: int | None = None):
    """A keyed function with out-of-order tolerance.

    A reading is answered once the key has seen a time `lateness_us` later
    (at once when that is 0). One that is older than a reading already answered
    is late: it comes out with `is_late` true and without features, and changes
    nothing. `answer(ts, vals, rows)` gives the feature columns of the rows
    (positions in the arrays); `retain(ts, n, frontier)` the first position kept.
    """

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # idle longer than the TTL: drop the key's history
            state.remove()
            return
        if state.exists:
            ts, ids, vals, frontier = state.get
            ts, ids = np.array(ts, np.int64), np.array(ids, np.int64)
            vals = np.array(vals, float).reshape(len(ts), len(inputs))
        else:
            ts, ids, vals, frontier = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(inputs))), None
        waiting = np.zeros(len(ts), bool) if frontier is None else ts > frontier
        parts = []
        for batch in pdfs:  # one Arrow batch at a time
            t = batch["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
            late = np.zeros(len(t), bool) if frontier is None else t < frontier
            if late.any():
                out = batch.loc[late, ["event_id", "timestamp"]].assign(sensor_id=key[0], is_late=True)
                parts.append(out.reindex(columns=columns))
            ts, ids = np.append(ts, t[~late]), np.append(ids, batch["event_id"].to_numpy(np.int64)[~late])
            vals = np.concatenate([vals, batch[inputs].to_numpy(float)[~late]])
            waiting = np.append(waiting, np.ones(int((~late).sum()), bool))
        order = np.lexsort((ids, ts))
        ts, ids, vals, waiting = ts[order], ids[order], vals[order], waiting[order]
        if len(ts):
            ripe = waiting & (ts <= ts[-1] - lateness_us)
            rows = np.flatnonzero(ripe)
            if len(rows):
                out = pd.DataFrame(answer(ts, vals, rows))
                out["sensor_id"], out["event_id"], out["is_late"] = key[0], ids[rows], False
                out["timestamp"] = pd.to_datetime(ts[rows], unit="us")
                parts.append(out.reindex(columns=columns))
                frontier = int(ts[rows[-1]])
        first = retain(ts, int((~waiting).sum()) + (len(rows) if len(ts) else 0), frontier) if frontier is not None else 0
        state.update((ts[first:].tolist(), ids[first:].tolist(), vals[first:].tolist(), frontier))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield from parts

    return fn


def microseconds(text: str) -> int:
    """Microseconds of an interval like '10 minutes'."""
    return int(pd.Timedelta(text) // pd.Timedelta(microseconds=1))


LAST_N_OUT = (
    "sensor_id string, event_id long, timestamp timestamp, pm2_5 double, pm25_avg double, pm10_avg double, "
    "aqi_avg double, pm25_max double, pm25_min double, anomaly_score double, is_anomaly boolean"
) + LATE_OUT


def last_n_columns() -> list[str]:
    return [c.split()[0] for c in LAST_N_OUT.split(", ")]


def last_n_answer(n: int):
    def answer(ts, vals, rows):
        low, high = np.maximum(rows - n + 1, 0), rows + 1
        p25, p10, aqi = vals.T
        avg = _frame_stats(p25, low, high, "avg")
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.abs(p25[rows] - avg) / avg
        score = np.where((high - low >= 2) & (avg > 0), ratio, 0.0)
        return {
            "pm2_5": p25[rows],
            "pm25_avg": avg,
            "pm10_avg": _frame_stats(p10, low, high, "avg"),
            "aqi_avg": _frame_stats(aqi, low, high, "avg"),
            "pm25_max": _frame_stats(p25, low, high, "max"),
            "pm25_min": _frame_stats(p25, low, high, "min"),
            "anomaly_score": score,
            "is_anomaly": score > C.RATIO_ANOMALY_THRESHOLD,
        }

    return answer


def last_n_features(
    stream: DataFrame, n: int = C.LAST_N_ROWS, keep: int = C.KEEP_LAST_PER_SENSOR, ttl_minutes: float | None = None, lateness: str = "0 minutes"
) -> DataFrame:
    """ST5 (+W5/D4 on a stream): per-sensor state of the newest `keep` readings.

    Rows are answered in the order (timestamp, event_id); out-of-order rows
    within `lateness` are put in their place first, later ones come out with
    `is_late` (see `_keyed_fn`). The state holds `keep` answered readings and
    those of the last `lateness`. Input is expected to be validated (P7)
    upstream. With `ttl_minutes` the history of a sensor silent for that long
    (processing time) is dropped; timeouts need a processing-time trigger.
    """
    cols = stream.select("sensor_id", "event_id", "timestamp", "pm2_5", "pm10", F.col("aqi").cast("double").alias("aqi"))
    ttl_ms = int(ttl_minutes * 60_000) if ttl_minutes else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    fn = _keyed_fn(["pm2_5", "pm10", "aqi"], last_n_answer(n), lambda ts, done, _: max(0, done - keep), microseconds(lateness), last_n_columns(), ttl_ms)
    return cols.groupBy("sensor_id").applyInPandasWithState(fn, LAST_N_OUT, KEYED_STATE, "append", timeout)


# ----------------------------------------------------------------- W1-W3 on a stream

_TRAIL_IN = ["pm2_5", "pm10", "aqi", "temperature", "humidity"]
TRAIL_OUT = "sensor_id string, event_id long, timestamp timestamp, " + ", ".join(f"{a.out} double" for a in AN.W1_AGGS) + LATE_OUT
_TRAIL_COLS = [c.split()[0] for c in TRAIL_OUT.split(", ")]


def _trailing_answer(ts, vals, rows):
    high = np.searchsorted(ts, ts[rows], "right")  # readings of the same time share their frames
    out = {}
    for a in AN.W1_AGGS:
        low = np.searchsorted(ts, ts[rows] - int(a.minutes * C.MICROS_PER_MINUTE))
        out[a.out] = _frame_stats(vals[:, _TRAIL_IN.index(a.col)], low, high, a.func)
    return out


def trailing_features_stream(stream: DataFrame, reach_minutes: float = 60.0, lateness: str = "0 minutes") -> DataFrame:
    """W1-W3 on a stream with event-time frames (the batch `trailing_features`).

    Per-sensor state holds the readings of the last `reach_minutes` and of
    `lateness`; late readings come out with `is_late` (see `_keyed_fn`).
    """
    reach = int(reach_minutes * C.MICROS_PER_MINUTE)
    cols = stream.select("sensor_id", "event_id", "timestamp", *[F.col(c).cast("double").alias(c) for c in _TRAIL_IN])
    fn = _keyed_fn(_TRAIL_IN, _trailing_answer, lambda ts, done, frontier: int(np.searchsorted(ts, frontier - reach)), microseconds(lateness), _TRAIL_COLS)
    return cols.groupBy("sensor_id").applyInPandasWithState(fn, TRAIL_OUT, KEYED_STATE, "append", GroupStateTimeout.NoTimeout)


# ----------------------------------------------------------------- ST6


def latest_state(stream: DataFrame, cols: list[str]) -> DataFrame:
    """ST6: newest non-missing value per field per sensor, as a streaming
    aggregate in update mode (state is one row per sensor)."""
    aggs = [
        F.expr(f"max_by(`{c}`, struct(`timestamp`, `event_id`)) FILTER (WHERE `{c}` IS NOT NULL)").alias(c)
        for c in cols
    ]
    return stream.groupBy("sensor_id").agg(F.max("timestamp").alias("last_seen"), *aggs)


# ----------------------------------------------------------------- ST7

DIGEST_OUT = (
    "digest_key string, sent_at timestamp, total_alerts long, high_alerts long, medium_alerts long, "
    "low_alerts long, top_high array<string>, more_high long, deliver boolean"
)
DIGEST_STATE = "last_sent long, total long, high long, medium long, low long, top array<string>"


def _digest_fn(cooldown_us: int, top: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last_sent, total, high, medium, low, tops = state.get
            tops = list(tops)
        else:
            last_sent, total, high, medium, low, tops = None, 0, 0, 0, 0, []
        batch = pd.concat(list(pdfs), ignore_index=True)
        out = []
        if len(batch):
            t_us = batch["timestamp"].astype("datetime64[us]").astype("int64")
            batch = batch.assign(t_us=t_us).sort_values(["t_us", "alert_id"], kind="stable")
            for r in batch.itertuples(index=False):
                total += 1
                sev = r.severity
                if sev == "HIGH":
                    high += 1
                    if len(tops) < top:
                        tops.append(f"{r.sensor_id}: {r.alert_type}")
                elif sev == "MEDIUM":
                    medium += 1
                elif sev == "LOW":
                    low += 1
                # an alert arriving after the cooldown flushes the buffer
                if last_sent is None or r.t_us - last_sent >= cooldown_us:
                    out.append(
                        (key[0], pd.Timestamp(r.t_us, unit="us"), total, high, medium, low, list(tops),
                         max(high - top, 0), high > 0)
                    )
                    last_sent, total, high, medium, low, tops = int(r.t_us), 0, 0, 0, 0, []
        state.update((last_sent, total, high, medium, low, tops))
        yield pd.DataFrame(
            out,
            columns=["digest_key", "sent_at", "total_alerts", "high_alerts", "medium_alerts", "low_alerts",
                     "top_high", "more_high", "deliver"],
        )

    return fn


def alert_digest(
    alerts: DataFrame, cooldown_minutes: float = C.DIGEST_COOLDOWN_MINUTES, key=None, top: int = C.DIGEST_TOP_HIGH
) -> DataFrame:
    """ST7: batched alert digest with a cooldown on event time.

    A digest is emitted when an alert arrives at least `cooldown` after the
    previous digest (the first alert always flushes); it summarises every
    alert buffered since. `deliver` is true when it holds a HIGH alert. State
    per key is a fixed set of counters plus at most `top` labels.
    """
    k = F.lit("all") if key is None else F.col(key)
    cols = alerts.select(
        k.alias("digest_key"), "alert_id", "sensor_id", "timestamp", "alert_type", "severity"
    )
    return cols.groupBy("digest_key").applyInPandasWithState(
        _digest_fn(int(cooldown_minutes * C.MICROS_PER_MINUTE), top),
        DIGEST_OUT,
        DIGEST_STATE,
        "append",
        GroupStateTimeout.NoTimeout,
    )


# ----------------------------------------------------------------- ST8


class CounterListener(StreamingQueryListener):
    """ST8: totals of observed metrics across micro-batches (driver-side counters only)."""

    def __init__(self, name: str = "ingest"):
        super().__init__()
        self.name = name
        self.totals: dict[str, int] = {}
        self.batches = 0
        self.lock = threading.Lock()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        m = event.progress.observedMetrics.get(self.name)
        if m is None:
            return
        with self.lock:
            self.batches += 1
            for k, v in m.asDict().items():
                self.totals[k] = self.totals.get(k, 0) + int(v or 0)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def observe_ingest(stream: DataFrame, name: str = "ingest") -> DataFrame:
    """ST8: per-batch counters on the stream itself (reported to listeners)."""
    return stream.observe(
        name,
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("_corrupt")).alias("corrupt"),
        F.count_if(F.col("aqi") >= C.HAS_ALERT_AQI).alias("alerts"),
    )


# ----------------------------------------------------------------- sinks on streams


def publish_stream(stream: DataFrame, topic: str, checkpoint: str, fmt: str = "kafka", path=None, bootstrap=None):
    """Stream rows out as JSON keyed by sensor."""
    env = PS.to_envelope(stream.drop("event_id", "_corrupt", "topic"), topic)
    w = env.writeStream.option("checkpointLocation", checkpoint)
    if fmt == "kafka":
        w = w.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic)
        return w.start()
    return w.format("json").option("path", path).start()


def console(stream: DataFrame, columns: list[str] | None = None, n: int = 20):
    """Preview each micro-batch on the console."""
    df = stream.select(*columns) if columns else stream
    return df.writeStream.format("console").option("numRows", n).option("truncate", False).start()
