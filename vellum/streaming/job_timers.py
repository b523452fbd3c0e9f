"""Job state with an end: replays, stuck jobs and late events.

One ``transformWithState`` operator keeps, per job, the fold of its events, the ids of the events
it has seen, and a timer.

* An event id counts once, however often it is delivered (map state).
* A job without an event for ``stuck_ms`` is closed with an error row: by its timer, or by the next
  event when that comes in the same batch, so the outcome does not depend on how the stream
  was cut into batches.
* A closed job (completed, error, timed out) stays closed: later events are ignored.  After
  ``expiry_ms`` its state shrinks to a tombstone (status and time), and the event ids go: a
  late event cannot move the job back even then.

In event time (default) timers follow the watermark, which suits replays and tests.  In
processing time they follow the clock, and ``ttl_ms`` drops tombstones and event ids for good, for
those who accept that a job older than that may begin anew.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C
from ..session import ship_code

STUCK_MS = 24 * 3600 * 1000
EXPIRY_MS = 7 * 24 * 3600 * 1000
STUCK_MESSAGE = C.MSG_ERROR_PREFIX + "no event for {s} s"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE = ("status string, message string, progress double, file_path string, current_chapter int, "
         "total_chapters int, last_ms long, last_id long, closed boolean, n_events long")
OUT = ("job_id long, status string, message string, progress double, file_path string, current_chapter int, "
       "total_chapters int, closed boolean, n_events long")
FIELDS = [c.split()[0] for c in STATE.split(", ")]
SHOWN = [c.split()[0] for c in OUT.split(", ")]
EVENT_COLUMNS = ["job_id", "event_id", "ts", "status", "message", "progress", "file_path", "current_chapter", "total_chapters"]


_WHOLE = ("event_id", "us", "current_chapter", "total_chapters")


def _value(name: str, v):
    """A cell as Python's own: pandas makes a column of numbers with gaps a float column."""
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    return int(v) if name in _WHOLE else v


def apply_event(state: dict | None, event: dict, stuck_ms: int) -> tuple[dict, bool]:
    """(new state, whether the event was taken)."""
    s = dict(state) if state else {**dict.fromkeys(FIELDS), "closed": False, "n_events": 0}
    if not s["closed"] and s["last_ms"] is not None and event["ms"] - s["last_ms"] > stuck_ms:
        s = time_out(s, stuck_ms)
    if s["closed"]:
        return s, False
    s["n_events"] += 1
    newer = s["last_ms"] is None or (event["ms"], event["event_id"]) > (s["last_ms"], s["last_id"])
    for c in ("progress", "file_path", "current_chapter", "total_chapters"):
        if event[c] is not None and (newer or s[c] is None):
            s[c] = event[c]
    if newer:
        s.update(status=event["status"], message=event["message"], last_ms=event["ms"], last_id=event["event_id"])
        s["closed"] = event["status"] in (C.STATUS_COMPLETED, C.STATUS_ERROR)
    return s, True


def time_out(state: dict, stuck_ms: int) -> dict:
    return {**state, "status": C.STATUS_ERROR, "message": STUCK_MESSAGE.format(s=stuck_ms // 1000), "closed": True}


class JobTimers(StatefulProcessor):
    def __init__(self, stuck_ms: int, expiry_ms: int, ttl_ms: int | None):
        self.stuck_ms, self.expiry_ms, self.ttl_ms = stuck_ms, expiry_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE, self.ttl_ms)
        self.seen = handle.getMapState("seen", "event_id long", "ms long", self.ttl_ms)

    def _load(self) -> dict | None:
        held = self.state.get()
        return dict(zip(FIELDS, held)) if held is not None else None

    def _store(self, s: dict, base_ms: int, known: bool) -> None:
        """Keeps the state and its one timer: stuck while open, expiry once closed.  A job that
        was not ``known`` before has no timer yet."""
        self.state.update(tuple(s[c] for c in FIELDS))
        for t in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(base_ms + (self.expiry_ms if s["closed"] else self.stuck_ms))

    def _row(self, key, s: dict) -> pd.DataFrame:
        row = {"job_id": key[0], **{c: s[c] for c in SHOWN[1:]}}
        row["progress"] = row["progress"] if row["progress"] is not None else 0.0
        for c in ("current_chapter", "total_chapters"):
            row[c] = row[c] if row[c] is not None else 0
        return pd.DataFrame([row])[SHOWN]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Each call on a state goes to the state store's process: none is made that cannot matter.
        # A job that is closed reads no event, a new one has seen none, and only an open one has
        # use for the ids of this batch later.
        old = self._load()
        if old and old["closed"]:
            return
        # A job's events of one batch, in order; the batch bounds them (maxFilesPerTrigger).
        events = []
        for pdf in rows:
            for r in pdf.drop(columns="ts").to_dict("records"):
                events.append({**{k: _value(k, v) for k, v in r.items()}, "ms": int(r["us"]) // 1000})
        events.sort(key=lambda e: (e["us"], e["event_id"]))
        s, new = old, {}
        for e in events:
            if (s and s["closed"]) or e["event_id"] in new or (old and self.seen.containsKey((e["event_id"],))):
                continue
            s, taken = apply_event(s, e, self.stuck_ms)
            if taken:
                new[e["event_id"]] = e["ms"]
        if s is old:
            return
        if not s["closed"]:
            for i, ms in new.items():
                self.seen.updateValue((i,), (ms,))
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else s["last_ms"]
        self._store(s, now, old is not None)
        yield self._row(key, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s is None:
            return
        if s["closed"]:
            self.seen.clear()
            self.state.update(tuple(s[c] if c in ("status", "last_ms", "last_id", "closed", "n_events") else None for c in FIELDS))
            return
        s = time_out(s, self.stuck_ms)
        self._store(s, expiredTimerInfo.getExpiryTimeInMs(), True)
        yield self._row(key, s)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that timers and map state need, for queries started inside."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_KEY, before) if before else spark.conf.unset(PROVIDER_KEY)


def timed_job_stream(events: DataFrame, delay: str = "1 hour", stuck_ms: int = STUCK_MS, expiry_ms: int = EXPIRY_MS,
                     ttl_ms: int | None = None) -> DataFrame:
    """A row for a job whenever its state changes.  ``events``: a stream of EVENT_COLUMNS;
    ``delay`` is how late an event may come.  With ``ttl_ms`` time is processing time."""
    ship_code(events.sparkSession)
    e = events.select(*EVENT_COLUMNS, F.unix_micros("ts").alias("us"))
    mode = "processingTime" if ttl_ms else "eventTime"
    if not ttl_ms:
        e = e.withWatermark("ts", delay)
    return e.groupBy("job_id").transformWithStateInPandas(JobTimers(stuck_ms, expiry_ms, ttl_ms), OUT, "Update", mode)


def last_rows(batches: DataFrame) -> DataFrame:
    """The last row of every job from rows with ``batch_id`` (two in one batch: the closed one)."""
    cols = [c for c in SHOWN if c != "job_id"]
    return batches.groupBy("job_id").agg(F.max_by(F.struct(*cols), F.struct("batch_id", "closed", "n_events")).alias("s")).select(
        "job_id", "s.*")
