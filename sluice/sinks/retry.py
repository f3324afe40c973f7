"""Retries with exponential, jittered delays."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")


class Retryable(RuntimeError):
    """A failure that may pass."""


@dataclass
class Policy:
    """``attempts`` counts the first one. ``max_elapsed`` 0 sets no limit."""

    attempts: int = 5
    base: float = 0.025
    max: float = 2.0
    jitter: float = 0.2
    max_elapsed: float = 0.0

    def delay(self, failed: int, rand: Callable[[], float] = random.random) -> float:
        """Seconds to wait after the ``failed``-th failure."""
        full = min(self.max, self.base * 2 ** (failed - 1))
        return full - rand() * self.jitter * full

    def run(self, work: Callable[[], T], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, on_retry: Callable[[], None] = lambda: None) -> T:
        """Result of ``work``; only Retryable is tried again."""
        began = clock()
        for n in range(1, self.attempts + 1):
            try:
                return work()
            except Retryable:
                wait = self.delay(n)
                if n == self.attempts or (self.max_elapsed and clock() - began + wait > self.max_elapsed):
                    raise
                on_retry()
                sleep(wait)
        raise AssertionError("attempts has to be 1 or more")
