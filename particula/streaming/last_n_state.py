"""ST5 on list and map state: a trigger reads the last readings it needs and writes the new ones only.

Answered readings of a sensor lie in numbered chunks of ``CHUNK`` readings, a
map state. New readings fill the last chunk and open others; chunks that hold
none of the newest ``keep`` are removed. So the bytes a trigger reads and writes
depend on its rows, on ``n`` and on ``CHUNK``, not on ``keep``. Readings that
still wait for others (``lateness``) are appended to a list state, and written
back only when some of them can be answered.

The state store must be RocksDB (``digest_timers.STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from .digest_timers import STATE_STORE
from .jobs import LAST_N_OUT, last_n_answer, last_n_columns, microseconds

#: Readings of a chunk.
CHUNK = 32
_INPUTS = ["pm2_5", "pm10", "aqi"]
_READING = np.dtype([("t", "<i8"), ("id", "<i8"), ("v", "<f8", len(_INPUTS))])


def _readings(batch: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(batch), _READING)
    out["t"] = batch["t"].to_numpy(np.int64)
    out["id"] = batch["event_id"].to_numpy(np.int64)
    out["v"] = batch[_INPUTS].to_numpy(float)
    return out


def _read(raw) -> np.ndarray:
    return np.frombuffer(bytes(raw), _READING)


class LastN(StatefulProcessor):
    def __init__(self, n: int, keep: int, lateness_us: int, ttl_ms: int | None = None):
        self.n, self.keep, self.lateness_us, self.ttl_ms = n, max(keep, n - 1), lateness_us, ttl_ms
        self.answer, self.columns = last_n_answer(n), last_n_columns()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "done long, frontier long", self.ttl_ms)
        self.chunks = handle.getMapState("chunks", "chunk long", "data binary", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "data binary", self.ttl_ms)

    def _chunk(self, k: int) -> np.ndarray | None:
        return _read(self.chunks.getValue((k,))[0]) if self.chunks.containsKey((k,)) else None

    def _newest(self, done: int) -> np.ndarray:
        """The newest n - 1 answered readings; those that a TTL took end the list."""
        parts, need, k = [np.zeros(0, _READING)], self.n - 1, (done - 1) // CHUNK
        while need > 0 and k >= 0 and (got := self._chunk(k)) is not None:
            parts.append(got[-need:])
            need -= len(parts[-1])
            k -= 1
        return np.concatenate(parts[::-1])

    def _store(self, done: int, ripe: np.ndarray) -> int:
        """Adds answered readings, removes chunks beyond ``keep``; returns how many there are now."""
        first, upto = done // CHUNK, done + len(ripe)
        open_chunk = self._chunk(first) if done % CHUNK else None
        if open_chunk is None and done % CHUNK:  # taken by a TTL: numbers go on with a new chunk
            first, upto = first + 1, (first + 1) * CHUNK + len(ripe)
        rows = ripe if open_chunk is None else np.concatenate([open_chunk, ripe])
        oldest = max(0, upto - self.keep) // CHUNK
        for i in range(0, len(rows), CHUNK):
            if first + i // CHUNK >= oldest:
                self.chunks.updateValue((first + i // CHUNK,), (rows[i : i + CHUNK].tobytes(),))
        for k in range(max(0, done - self.keep) // CHUNK, min(oldest, first + 1)):
            if self.chunks.containsKey((k,)):
                self.chunks.removeKey((k,))
        return upto

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, frontier = self.head.get() if self.head.exists() else (0, None)
        new = [np.zeros(0, _READING)]
        for batch in rows:
            got = _readings(batch)
            if frontier is not None and (late := got["t"] < frontier).any():
                yield self._frame(key, got[late], True)
                got = got[~late]
            new.append(got)
        fresh = np.concatenate(new)
        old = [_read(x[0]) for x in self.waiting.get()] if self.lateness_us and self.waiting.exists() else []
        held = np.concatenate([*old, fresh])
        if not len(held):
            return
        ready = held["t"] <= held["t"].max() - self.lateness_us
        if not ready.any():
            if len(fresh):
                self.waiting.appendValue((fresh.tobytes(),))
            return
        if self.lateness_us:
            self.waiting.put([(held[~ready].tobytes(),)])
        ripe = held[ready]
        ripe = ripe[np.lexsort((ripe["id"], ripe["t"]))]
        before = self._newest(done)
        both = np.concatenate([before, ripe])
        yield self._frame(key, ripe, False, self.answer(both["t"], both["v"], np.arange(len(before), len(both))))
        self.head.update((self._store(done, ripe), int(ripe["t"][-1])))

    def _frame(self, key, readings: np.ndarray, late: bool, features: dict | None = None) -> pd.DataFrame:
        out = pd.DataFrame(features or {}, index=range(len(readings)))
        out["sensor_id"], out["event_id"], out["is_late"] = key[0], readings["id"], late
        out["timestamp"] = pd.to_datetime(readings["t"], unit="us")
        return out.reindex(columns=self.columns)

    def close(self) -> None:
        pass


def last_n_stored(
    stream: DataFrame, n: int = C.LAST_N_ROWS, keep: int = C.KEEP_LAST_PER_SENSOR, ttl_minutes: float | None = None, lateness: str = "0 minutes"
) -> DataFrame:
    """ST5: the rows of ``jobs.last_n_features``, with state written by the reading.

    A reading is answered once its sensor has seen a time ``lateness`` later;
    one older than a reading already answered comes out with ``is_late`` and no
    features. With ``ttl_minutes`` a reading is forgotten that long (processing
    time) after it was written; such a query needs a processing-time trigger,
    since with available-now Spark always finds another batch to run and does not end. Input is expected to be validated upstream (P7),
    with a timestamp in every row; a NULL sensor is a sensor.
    """
    name, setting = STATE_STORE
    if stream.sparkSession.conf.get(name, "") != setting:
        raise ValueError(f"set {name} to {setting}")
    ttl_ms = int(ttl_minutes * 60_000) if ttl_minutes else None
    cols = stream.select("sensor_id", "event_id", F.unix_micros("timestamp").alias("t"), *[F.col(c).cast("double").alias(c) for c in _INPUTS])
    work = LastN(n, keep, microseconds(lateness), ttl_ms)
    return cols.groupBy("sensor_id").transformWithStateInPandas(work, LAST_N_OUT, "append", "processingTime" if ttl_ms else "none")
