"""ST7 on event time: the cooldown digest of alerts that arrive out of order.

Alerts wait in a list state of their key until the watermark has passed them;
an event-time timer per started minute wakes the key. What the watermark has
passed is put in the order (timestamp, alert_id) and cut into digests: the work
in Python is one array search a digest, not one step an alert. Appending writes
the new alerts only; a timer writes back those that still wait, at most the
alerts of ``lateness``.

Alerts that come later than ``lateness`` are dropped by the watermark, and the
query's progress counts them (``numRowsDroppedByWatermark``). A key's counters
are a fixed set beside at most ``top`` labels. The state store must be RocksDB
(``STATE_STORE``), as Spark's arbitrary state requires.

Defined cases: NULL times never pass a watermark, so such alerts are left out;
a NULL key is a key; NULL severities count in the total only; alerts of one
moment are taken by alert_id, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C

#: Setting and value that a session needs before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DIGEST_OUT = (
    "digest_key string, sent_at timestamp, total_alerts long, high_alerts long, medium_alerts long, "
    "low_alerts long, top_high array<string>, more_high long, deliver boolean"
)
_COLS = [c.split()[0] for c in DIGEST_OUT.split(", ")]
_WAITING = "t long, id string, severity string, label string"
_COUNTERS = "last_sent long, total long, high long, medium long, low long, top array<string>"
_LEVELS = ("HIGH", "MEDIUM", "LOW")
_MINUTE_MS = 60_000


def cut_digests(rows: pd.DataFrame, counters: tuple | None, cooldown_us: int, top: int) -> tuple[list[tuple], tuple]:
    """Digests (sent, total, high, medium, low, labels) of alerts in order, and the counters of what follows the last one."""
    last, total, *levels, labels = counters or (None, 0, 0, 0, 0, [])
    t = rows["t"].to_numpy(np.int64)
    severity = rows["severity"].to_numpy(object)
    upto = np.zeros((len(t) + 1, len(_LEVELS)), np.int64)  # alerts of a level before each position
    for k, level in enumerate(_LEVELS):
        np.cumsum(severity == level, out=upto[1:, k])
    high, names = np.flatnonzero(severity == "HIGH"), rows["label"].to_numpy(object)
    levels, labels, out, start = np.array(levels, np.int64), list(labels), [], 0

    def taken(end: int):
        more = high[upto[start, 0] : upto[end, 0]][: max(0, top - len(labels))]
        return total + end - start, levels + upto[end] - upto[start], labels + names[more].tolist()

    while start < len(t):
        # the first alert at least a cooldown after the last digest sends the next one
        at = start if last is None else max(start, int(np.searchsorted(t, last + cooldown_us)))
        if at >= len(t):
            break
        n, by_level, shown = taken(at + 1)
        out.append((int(t[at]), n, *by_level.tolist(), shown))
        last, total, levels, labels, start = int(t[at]), 0, np.zeros_like(levels), [], at + 1
    n, by_level, shown = taken(len(t))
    return out, (last, int(n), *by_level.tolist(), shown)


class _Digests(StatefulProcessor):
    def __init__(self, cooldown_us: int, top: int):
        self.cooldown_us, self.top = cooldown_us, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.settled = handle.getValueState("settled", "watermark long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        minutes: set[int] = set()
        for batch in rows:
            self.waiting.appendList(list(batch[["t", "id", "severity", "label"]].astype(object).itertuples(index=False, name=None)))
            minutes.update(np.unique(batch["t"].to_numpy(np.int64) // (_MINUTE_MS * 1000)).tolist())
        for m in sorted(minutes):
            self.handle.registerTimer((m + 1) * _MINUTE_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.settled.exists() and self.settled.get()[0] == watermark:
            return  # another timer of this key has done it
        self.settled.update((watermark,))
        held = pd.DataFrame(list(self.waiting.get()), columns=["t", "id", "severity", "label"])
        passed = held["t"].to_numpy(np.int64) <= watermark * 1000
        left = held[~passed]
        if len(left):
            self.waiting.put(list(left.astype(object).itertuples(index=False, name=None)))
        else:
            self.waiting.clear()
        rows = held[passed].sort_values(["t", "id"], kind="stable")
        counters = tuple(self.counters.get()) if self.counters.exists() else None
        digests, counters = cut_digests(rows, counters, self.cooldown_us, self.top)
        self.counters.update(counters)
        if digests:
            out = [
                (key[0], pd.Timestamp(t, unit="us"), n, high, medium, low, shown, max(high - self.top, 0), high > 0)
                for t, n, high, medium, low, shown in digests
            ]
            yield pd.DataFrame(out, columns=_COLS)

    def close(self) -> None:
        pass


def timed_digest(
    alerts: DataFrame,
    lateness: str = "10 minutes",
    cooldown_minutes: float = C.DIGEST_COOLDOWN_MINUTES,
    key=None,
    top: int = C.DIGEST_TOP_HIGH,
) -> DataFrame:
    """ST7: the digests of ``operators.digest.digest_chain`` on a stream whose alerts are up to ``lateness`` out of order.

    A digest comes out once the watermark has passed the minute of the alert
    that sends it. Without ``key`` there is one cooldown for all alerts, so one
    group; name a key (area, sensor) to spread the work.
    """
    name, setting = STATE_STORE
    if alerts.sparkSession.conf.get(name, "") != setting:
        raise ValueError(f"set {name} to {setting}")
    k = F.lit("all") if key is None else F.col(key).cast("string")
    cols = alerts.filter(F.col("timestamp").isNotNull()).withWatermark("timestamp", lateness).select(
        k.alias("digest_key"),
        "timestamp",
        F.unix_micros("timestamp").alias("t"),
        F.col("alert_id").alias("id"),
        "severity",
        F.concat(F.col("sensor_id"), F.lit(": "), F.col("alert_type")).alias("label"),
    )
    work = _Digests(int(cooldown_minutes * C.MICROS_PER_MINUTE), top)
    return cols.groupBy("digest_key").transformWithStateInPandas(work, DIGEST_OUT, "append", "eventTime")
