"""Tasks, run records and errors in a folder that driver and cluster share; one run per task at a time."""

from __future__ import annotations

import datetime as dt
import logging
import random
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Status, SyncResult
from .runtime import Cancellation
from .sources.parquet import Conflict, ParquetTables

T = TypeVar("T")
log = logging.getLogger("tidemark")

RECORD = "id long, task_id long, run_key string, start_time timestamp_ntz, end_time timestamp_ntz, status string, read_rows long, write_rows long, skipped_rows long, error_rows long, start_cursor string, end_cursor string, total_millis long, error_message string, trigger_type string"
ERROR = "id long, record_id long, task_id long, phase string, row_key string, message string, row_data string, retryable boolean, created_at timestamp_ntz"
CURSOR = "task_id long, cursor_value string, updated_at timestamp_ntz"


class TaskRunning(Exception):
    """TASK_RUNNING: another run of the task holds its lock."""


class LeaseLost(RuntimeError):
    """LEASE_LOST: a run was given up as dead, and may write no more."""


class StateStore:
    """A run holds a lease on its task: a lock that names its owner and record, and that the owner renews while it lives.

    A lease that was not renewed for lease_seconds has run out: recover() closes the run, and another may begin. The
    numbers of records grow, so a run that stalled and comes back finds another's number, or none, in the lock: it can
    neither write to its target nor move the cursor.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str | None = None, lease_seconds: float = 300) -> None:
        self.spark, self.store = spark, ParquetTables(spark, root, keep_seconds=60)
        self.owner, self.lease_seconds = owner or uuid.uuid4().hex, lease_seconds
        self._held: dict[int, int] = {}
        self._renewing: threading.Thread | None = None
        for name, schema in (("sync_record", RECORD), ("sync_error", ERROR), ("sync_cursor", CURSOR)):
            if not self.store.exists(name):
                self.store.create(name, spark.createDataFrame([], schema))

    def records(self) -> DataFrame:
        return self.store.read("sync_record")

    def errors(self) -> DataFrame:
        return self.store.read("sync_error")

    def cursor(self, task_id: int) -> str | None:
        found = self.store.read("sync_cursor").where(F.col("task_id") == task_id).select("cursor_value").head(1)
        return found[0][0] if found else None

    def _lock(self, task_id: int):
        return self.store._path(f"RUNNING-{task_id}")

    def lease(self, task_id: int) -> tuple[str, int, float] | None:
        """Owner, record and age in seconds of a task's lease; None if nobody holds it."""
        fs, place = self.store._fs(), self._lock(task_id)
        try:
            age = time.time() - fs.getFileStatus(place).getModificationTime() / 1000
            stream = fs.open(place)
            try:
                told = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise
        owner, _, record = told.partition(" ")
        return owner, int(record or 0), age

    def _write_lease(self, task_id: int, record: int) -> None:
        out = self.store._fs().create(self._lock(task_id), True)
        out.write(bytearray(f"{self.owner} {record}".encode()))
        out.close()

    def check_lease(self, task_id: int, record: int) -> None:
        """Raises LeaseLost unless this store holds the task's lease for that record."""
        found = self.lease(task_id)
        if found is None or found[:2] != (self.owner, record):
            raise LeaseLost(f"record {record} of task {task_id} has lost its lease")

    def renew(self) -> None:
        """Renew the leases of all runs begun here; those lost meanwhile are left to their new owners."""
        for task_id, record in list(self._held.items()):
            try:
                self.check_lease(task_id, record)
                self._write_lease(task_id, record)
            except LeaseLost:
                self._held.pop(task_id, None)

    def _keep_renewing(self) -> None:
        def loop() -> None:
            while self._held:
                time.sleep(max(0.05, self.lease_seconds / 5))
                try:
                    self.renew()
                except Exception:  # the file system is away for a moment; the lease lasts longer than a pause
                    log.warning("a lease could not be renewed", exc_info=True)

        if self._renewing is None or not self._renewing.is_alive():
            self._renewing = threading.Thread(target=loop, daemon=True, name="tidemark-leases")
            self._renewing.start()

    def _release(self, task_id: int, record: int) -> None:
        self._held.pop(task_id, None)
        try:
            self.check_lease(task_id, record)
        except LeaseLost:
            return
        self.store._fs().delete(self._lock(task_id), False)

    def _commit(self, change: Callable[[], T], tries: int = 20) -> T:
        """Change a table that all tasks share; where another task commits first, read it again and retry."""
        for attempt in range(1, tries + 1):
            try:
                return change()
            except Conflict:
                if attempt == tries:
                    raise
                time.sleep(random.uniform(0, min(2.0, 0.1 * attempt)))
        raise AssertionError

    def _append(self, table: str, schema: str, rows: list[tuple]) -> int:
        """Append rows under the next ids and give the first; the ids are free as long as the commit succeeds."""
        base = self.store._base(table)
        first = (self.store.read(table, base).agg(F.max("id")).first()[0] or 0) + 1
        self.store.append(table, self.spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], schema), base)
        return first

    def begin(self, task_id: int, now: dt.datetime, trigger: str = "MANUAL") -> int:
        """The id of a new RUNNING record. Raises TaskRunning while another run has not finished."""
        try:
            self.store._fs().create(self._lock(task_id), False).close()
        except Exception as e:
            raise TaskRunning(f"task {task_id} is running") from e
        try:
            row = (task_id, f"RUNNING-{task_id}", now, None, Status.RUNNING.value, 0, 0, 0, 0, self.cursor(task_id), None, 0, None, trigger)
            record = self._commit(lambda: self._append("sync_record", RECORD, [row]))
            self._write_lease(task_id, record)
            self._held[task_id] = record
            self._keep_renewing()
            return record
        except BaseException:
            self.store._fs().delete(self._lock(task_id), False)
            raise

    def finish(self, record: int, result: SyncResult, now: dt.datetime) -> None:
        """Close the record, keep its errors, then move the cursor: only of a completed run that has one.

        A run that has lost its lease changes nothing: its record is closed already. Raises LeaseLost then.
        """
        self.check_lease(result.task_id, record)
        try:
            old = self.records().where(F.col("id") == record).first()
            row = (record, result.task_id, f"{result.task_id}-{record}", old["start_time"], now, result.status.value, result.read_rows, result.written_rows, result.skipped_rows, len(result.errors), result.start_cursor, result.end_cursor, result.millis, result.message, old["trigger_type"])
            if result.errors:
                errors = [(record, result.task_id, e["phase"], e["row_key"], e["message"], e["row_data"], e["retryable"], now) for e in result.errors]
                self._commit(lambda: self._append("sync_error", ERROR, errors))
            self._commit(lambda: self.store.upsert("sync_record", self.spark.createDataFrame([row], RECORD), ["id"], []))
            if result.status == Status.COMPLETED and result.end_cursor is not None:
                moved = self.spark.createDataFrame([(result.task_id, result.end_cursor, now)], CURSOR)
                self._commit(lambda: self.store.upsert("sync_cursor", moved, ["task_id"], []))
        finally:
            self._release(result.task_id, record)

    def shutdown(self, cancellation: Cancellation, now: dt.datetime, wait_seconds: float = 30, sleep: Callable[[float], None] = time.sleep) -> int:
        """Cancel all runs, give them time to end by themselves, then close the records of those that have not.

        Returns how many were closed that way.
        """
        for r in self.records().where("status = 'RUNNING'").select("task_id").collect():
            cancellation.cancel(r["task_id"])
        end = time.monotonic() + wait_seconds
        while time.monotonic() < end and not self.records().where("status = 'RUNNING'").isEmpty():
            sleep(0.5)
        return self._close(now, Status.CANCELLED, "the process was shut down during the run")

    def recover(self, now: dt.datetime) -> int:
        """At start-up: runs left RUNNING by this owner, or whose leases ran out, have failed; their cursors stay.

        Returns how many there were. Runs of other owners that renew their leases go on.
        """
        return self._close(now, Status.FAILED, "the process ended during the run")

    def _is_dead(self, task_id: int, record: int) -> bool:
        found = self.lease(task_id)
        return found is None or found[0] in ("", self.owner) or found[1] != record or found[2] > self.lease_seconds

    def _close(self, now: dt.datetime, status: Status, why: str) -> int:
        left = [r for r in self.records().where("status = 'RUNNING'").collect() if self._is_dead(r["task_id"], r["id"])]
        if left:
            rows = [tuple((r.asDict() | {"status": status.value, "end_time": now, "run_key": f"{r['task_id']}-{r['id']}", "error_message": why}).values()) for r in left]
            self._commit(lambda: self.store.upsert("sync_record", self.spark.createDataFrame(rows, RECORD), ["id"], []))
            for r in left:
                self._held.pop(r["task_id"], None)
                held = self.lease(r["task_id"])
                if held and held[1] in (0, r["id"]):
                    self.store._fs().delete(self._lock(r["task_id"]), False)
        return len(left)

    def clean(self, now: dt.datetime, record_days: int = 30, error_days: int = 7) -> None:
        from .reports import kept_errors, kept_records

        for table, kept in (("sync_record", lambda x: kept_records(x, now, record_days)), ("sync_error", lambda x: kept_errors(x, now, error_days))):
            self._commit(lambda: self.store.replace(table, kept(self.store.read(table, base := self.store._base(table))), base))  # noqa: B023

    def run(self, task, source, target, now: dt.datetime, **more) -> SyncResult:
        """One run under the task's lock, from the stored cursor, recorded."""
        from dataclasses import replace

        from .plans.engine import run

        record = self.begin(task.id, now)
        result = run(self.spark, replace(task, cursor=self.cursor(task.id) or task.cursor), source, target, now=now, fence=lambda: self.check_lease(task.id, record), **more)
        try:
            self.finish(record, result, now)
        except LeaseLost as e:
            result.status, result.end_cursor, result.message = Status.FAILED, None, str(e)
        return result


def as_row(result: SyncResult) -> dict:
    return {k: v for k, v in asdict(result).items() if k not in ("issues", "errors")}
