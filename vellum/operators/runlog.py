"""The engine's log of its own runs: a start row and a finish or failure row per stage, with
seconds and counts.  The counts are taken by the pass that does the work (``Observation``): no
second scan."""
from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..store import RunStore

STARTED, FINISHED, FAILED = "started", "finished", "failed"
SCHEMA = ("job string, stage string, subject string, status string, at timestamp, seconds double, error string, "
          "metrics map<string,bigint>")
#: Characters of an error that the log keeps.
ERROR_CHARS = 2000


class Stage:
    def __init__(self, name: str):
        self.name, self.observed = name, []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df`` with the counts attached; they are known once an action has run over it, which
        the stage must do before it ends."""
        o = Observation(f"{self.name}-{len(self.observed)}")
        self.observed.append(o)
        return df.observe(o, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(k) for k, c in counts.items()])

    def metrics(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for o in self.observed:
            out.update(o.get)
        return out


class RunLog:
    """Rows go to ``store`` by (run, stage, subject, start or end), so a stage done again replaces its rows."""

    def __init__(self, store: RunStore, run: str):
        self.store, self.run = store, run

    def _put(self, stage: str, subject: str, end: str, row: tuple) -> None:
        df = self.store.spark.createDataFrame([(self.run, stage, subject, *row)], SCHEMA)
        self.store.put(f"{self.run}/{stage}/{subject}/{end}", log=df.coalesce(1))

    @contextmanager
    def stage(self, name: str, subject: str) -> Iterator[Stage]:
        """Times what runs inside; an exception is logged and goes on."""
        st, t0 = Stage(name), time.perf_counter()
        now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)      # noqa: E731
        self._put(name, subject, "start", (STARTED, now(), None, None, None))
        try:
            yield st
        except BaseException as e:
            self._put(name, subject, "end", (FAILED, now(), time.perf_counter() - t0, str(e)[:ERROR_CHARS], None))
            raise
        seconds = time.perf_counter() - t0
        self._put(name, subject, "end", (FINISHED, now(), seconds, None, st.metrics()))

    def read(self) -> DataFrame:
        """The rows of all runs in the store."""
        return self.store.read("log", SCHEMA)


class ProgressLog(StreamingQueryListener):
    """A row per micro-batch of the queries of a session (``spark.streams.addListener``), kept until
    ``flush`` hands them to the log's store."""

    def __init__(self, log: RunLog):
        self.log, self.rows = log, []

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.name or event.id), "-", STARTED, None, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {"n_input": int(p.numInputRows), "n_state": sum(int(s.numRowsTotal) for s in p.stateOperators)}
        self.rows.append((str(p.name or p.id), str(p.batchId), FINISHED, p.batchDuration / 1000, None, counts))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        status = FAILED if event.exception else FINISHED
        self.rows.append((str(event.id), "-", status, None, (event.exception or "")[:ERROR_CHARS] or None, None))

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        for k, (query, batch, status, seconds, error, counts) in enumerate(rows):
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            self.log._put(query, batch, f"{status}-{k}", (status, now, seconds, error, counts))
