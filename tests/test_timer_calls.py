"""How often a job's timers and seen ids are asked for: each call is a trip to the state store."""
from types import SimpleNamespace

import pandas as pd

from vellum.streaming import job_timers as J


class Counted:
    """A processor's states and timers, in memory, counting calls."""

    def __init__(self):
        self.value, self.ids, self.timers, self.calls = None, {}, [], 0

    def _count(self, x=None):
        self.calls += 1
        return x

    def processor(self):
        p = J.JobTimers(J.STUCK_MS, J.EXPIRY_MS, None)
        p.state = SimpleNamespace(get=lambda: self._count(self.value), exists=lambda: self._count(self.value is not None),
                                  update=lambda v: self._count(setattr(self, "value", v)))
        p.seen = SimpleNamespace(containsKey=lambda k: self._count(k in self.ids),
                                 updateValue=lambda k, v: self._count(self.ids.__setitem__(k, v)))
        p.handle = SimpleNamespace(listTimers=lambda: self._count(list(self.timers)),
                                   deleteTimer=lambda t: self._count(self.timers.remove(t)),
                                   registerTimer=lambda t: self._count(self.timers.append(t)))
        return p


def rows(n, status="queued", start=0):
    return [{"job_id": 1, "event_id": i, "ts": None, "status": status, "message": "m", "progress": None, "file_path": None,
             "current_chapter": None, "total_chapters": None, "us": i * 1000} for i in range(start, start + n)]


def handle(p, events):
    return [r for pdf in p.handleInputRows((1,), iter([pd.DataFrame(events)]), None) for r in pdf.itertuples()]


def test_calls_do_not_go_with_events_that_cannot_matter():
    c = Counted()
    p = c.processor()
    out = handle(p, rows(50) + rows(50) + rows(1, "completed", 50))
    assert [(r.closed, r.n_events) for r in out] == [(True, 51)] and c.timers == [50 + J.EXPIRY_MS]
    assert c.calls <= 4                                      # read, state, timer
    c.calls = 0
    assert not handle(p, rows(100, start=60)) and c.calls == 1


def test_an_open_job_still_counts_a_replay_once():
    c = Counted()
    p = c.processor()
    assert [r.n_events for r in handle(p, rows(3) + rows(3))] == [3] and len(c.ids) == 3
    assert not handle(p, rows(3))
    assert [r.n_events for r in handle(p, rows(4))] == [4] and c.timers == [3 + J.STUCK_MS]
