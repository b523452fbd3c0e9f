"""Models with injected faults, for the registered queries and the bench."""
from __future__ import annotations

import time
from typing import Callable

from ..operators.translate import LetterModel, TextModel


class FlakyModel:
    """Fails the first ``failures(key)`` attempts of each chunk, then delegates."""

    def __init__(self, failures: Callable[[object], int], inner: TextModel | None = None):
        self.failures = failures
        self.inner = inner or LetterModel()

    def translate(self, text, target_language, *, key=None, attempt=1):
        if attempt <= self.failures(key):
            raise RuntimeError(f"injected failure on attempt {attempt}")
        return self.inner.translate(text, target_language, key=key, attempt=attempt)


class DelayModel:
    """Adds a fixed delay per call, in place of a model's latency."""

    def __init__(self, seconds: float, inner: TextModel | None = None):
        self.seconds = seconds
        self.inner = inner or LetterModel()

    def translate(self, text, target_language, *, key=None, attempt=1):
        time.sleep(self.seconds)
        return self.inner.translate(text, target_language, key=key, attempt=attempt)


def fail_first_by_key(k: int):
    """Failure count ``key % k`` (deterministic, keyed by a column)."""
    return lambda key: int(key) % k


def fail_listed(keys, times: int):
    """Failure count ``times`` for the listed keys, 0 for the others."""
    listed = frozenset(keys)
    return lambda key: times if key in listed else 0
