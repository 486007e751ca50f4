"""Retries, progress, cancelling and events around a run."""

from __future__ import annotations

import logging
import re
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .model import ErrorPolicy

log = logging.getLogger("tidemark")

# SQL states and error codes of failures that may pass.
RETRYABLE_STATES = ("08", "40", "53", "S1", "HYT00", "HYT01", "70100")
RETRYABLE_CODES = (1205, 1213, 2006, 2013, 1040)
MOST_BACKOFF_MS = 60_000


def is_retryable(error: BaseException | None) -> bool:
    """By SQL state, error code or class of the Java exception below; broken constraints never are."""
    e = getattr(error, "java_exception", None)
    seen = 0
    while e is not None and seen < 20:
        name = e.getClass().getSimpleName()
        if re.search("Transient|Recoverable|Timeout", name) and "NonTransient" not in name:
            return True
        if "NonTransient" in name:
            return False
        if hasattr(e, "getSQLState") and "SQL" in name:
            return retryable_state(e.getSQLState(), e.getErrorCode())
        e, seen = e.getCause(), seen + 1
    return isinstance(error, TimeoutError | ConnectionError)


def retryable_state(state: str | None, code: int = 0) -> bool:
    if state and state.startswith("23"):
        return False
    return bool(state and state.startswith(RETRYABLE_STATES)) or code in RETRYABLE_CODES


def backoff_ms(base: int, attempt: int) -> int:
    return min(MOST_BACKOFF_MS, base * 2 ** min(10, max(0, attempt - 1)))


def with_retries(work: Callable, policy: ErrorPolicy, sleep: Callable[[float], None] = time.sleep):
    """The result of work; failures that may pass are tried again after a growing pause."""
    for attempt in range(1, policy.max_retries + 2):
        try:
            return work()
        except Exception as e:
            if attempt > policy.max_retries or not is_retryable(e):
                raise
            log.warning("attempt %d failed, trying again: %s", attempt, str(e)[:200])
            sleep(backoff_ms(policy.backoff_ms, attempt) / 1000)


@dataclass(frozen=True)
class Progress:
    """Totals so far, never differences."""

    phase: str
    read_rows: int = 0
    written_rows: int = 0
    skipped_rows: int = 0
    cursor: str | None = None


class AsyncListener:
    """Hands progress to a slow listener on a thread of its own; a full queue drops its oldest, the last one arrives."""

    def __init__(self, listener: Callable[[Progress], None], capacity: int = 64) -> None:
        self._listener, self._queue, self._ready, self._closed = listener, deque(maxlen=capacity), threading.Condition(), False
        self.dropped = 0
        self._thread = threading.Thread(target=self._run, daemon=True, name="tidemark-progress")
        self._thread.start()

    def __call__(self, progress: Progress) -> None:
        with self._ready:
            self.dropped += len(self._queue) == self._queue.maxlen
            self._queue.append(progress)
            self._ready.notify()

    def _run(self) -> None:
        while True:
            with self._ready:
                self._ready.wait_for(lambda: self._queue or self._closed)
                if not self._queue:
                    return
                item = self._queue.popleft()
            try:
                self._listener(item)
            except Exception:
                log.exception("a progress listener failed")

    def close(self, timeout: float = 5.0) -> None:
        with self._ready:
            self._closed = True
            self._ready.notify()
        self._thread.join(timeout)


class EventBus:
    """Publish and subscribe; a subscriber that raises does not disturb the others."""

    def __init__(self) -> None:
        self._subscribers: list[Callable[[str], None]] = []

    def subscribe(self, f: Callable[[str], None]) -> None:
        self._subscribers.append(f)

    def unsubscribe(self, f: Callable[[str], None]) -> None:
        self._subscribers = [x for x in self._subscribers if x is not f]

    def publish(self, message: str) -> None:
        for f in list(self._subscribers):
            try:
                f(message)
            except Exception:
                log.exception("a subscriber failed")

    def count(self) -> int:
        return len(self._subscribers)

    def clear(self) -> None:
        self._subscribers = []


class Cancelled(Exception):
    pass


class Cancellation:
    """Cooperative: the flag is looked at between phases, and Spark jobs of the task's tag are interrupted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._asked = spark, set()

    @staticmethod
    def tag(task_id: int) -> str:
        return f"tidemark-task-{task_id}"

    def cancel(self, task_id: int) -> None:
        self._asked.add(task_id)
        self.spark.sparkContext.cancelJobsWithTag(self.tag(task_id))

    def check(self, task_id: int) -> None:
        if task_id in self._asked:
            raise Cancelled(f"task {task_id} was cancelled")

    def done(self, task_id: int) -> None:
        self._asked.discard(task_id)
