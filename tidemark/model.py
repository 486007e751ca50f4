"""What a replication task is made of, and what a run of it reports."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import StrEnum


class Mode(StrEnum):
    FULL = "FULL"
    INCR = "INCR"
    FULL_INCR = "FULL_INCR"


class Strategy(StrEnum):
    TRUNCATE = "TRUNCATE"
    DELETE = "DELETE"
    SWAP = "SWAP"


class Status(StrEnum):
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"
    CANCELLED = "CANCELLED"


class Phase(StrEnum):
    PREFLIGHT = "PREFLIGHT"
    READ = "READ"
    MAP = "MAP"
    WRITE = "WRITE"


class Level(StrEnum):
    WARN = "WARN"
    ERROR = "ERROR"


@dataclass(frozen=True)
class TableRef:
    """schema.table; of a longer name the last two parts count."""

    table: str
    schema: str | None = None

    @classmethod
    def parse(cls, name: str) -> TableRef:
        parts = [p.strip().strip("`\"") for p in name.split(".")]
        return cls(parts[-1], parts[-2] if len(parts) > 1 else None)

    def __str__(self) -> str:
        return f"{self.schema}.{self.table}" if self.schema else self.table


@dataclass(frozen=True)
class ColumnSpec:
    """A column with its SQL type as declared: Spark's own types know neither lengths of text nor YEAR or BIT."""

    name: str
    sql_type: str
    nullable: bool = True
    length: int = 0
    scale: int = 0


@dataclass(frozen=True)
class TableSpec:
    """Columns and keys of a table. Parquet declares no keys, so they are said here."""

    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    indexed: tuple[str, ...] = ()

    def find(self, name: str | None) -> ColumnSpec | None:
        """Case does not count, nor does a qualifier."""
        if not name:
            return None
        bare = name.rsplit(".", 1)[-1].strip("`\"").lower()
        return next((c for c in self.columns if c.name.lower() == bare), None)

    def first_key(self) -> tuple[str, ...]:
        return self.primary_key or (self.unique_keys[0] if self.unique_keys else ())


@dataclass(frozen=True)
class FieldMapping:
    """A source column, or without one a constant, for a target column."""

    target: str
    source: str | None = None
    default: str | None = None
    primary_key: bool = False


@dataclass(frozen=True)
class IncrPolicy:
    safety_lag_seconds: int = 0
    lookback_seconds: int = 0


@dataclass(frozen=True)
class ErrorPolicy:
    max_retries: int = 3
    backoff_ms: int = 2000
    skip_bad_rows: bool = False
    max_skip_rows: int = 100
    max_errors_recorded: int = 200


@dataclass(frozen=True)
class SyncTask:
    """One table, or the rows of one SELECT, to one target. Raises ValueError where a field cannot be right."""

    id: int
    target_table: str
    source_table: str | None = None
    source_sql: str | None = None
    mode: Mode | None = None
    incr_column: str | None = None
    order_column: str | None = None
    cursor: str | None = None
    #: An older field for the cursor, read where cursor is blank.
    incr_value: str | None = None
    page_size: int = 1000
    batch_size: int = 500
    mappings: tuple[FieldMapping, ...] = ()
    strategy: Strategy = Strategy.TRUNCATE
    incr: IncrPolicy = field(default_factory=IncrPolicy)
    errors: ErrorPolicy = field(default_factory=ErrorPolicy)
    dry_run: bool = False

    def __post_init__(self) -> None:
        wrong = []
        if not self.target_table:
            wrong.append("target_table is required")
        if not (self.source_table or self.source_sql):
            wrong.append("source_table or source_sql is required")
        if self.page_size <= 0 or self.batch_size <= 0:
            wrong.append("page_size and batch_size are positive")
        if min(self.incr.safety_lag_seconds, self.incr.lookback_seconds) < 0:
            wrong.append("lags are not negative")
        if min(self.errors.max_retries, self.errors.backoff_ms, self.errors.max_skip_rows, self.errors.max_errors_recorded) < 0:
            wrong.append("limits of the error policy are not negative")
        if wrong:
            raise ValueError("; ".join(wrong))
        object.__setattr__(self, "mode", Mode(self.mode) if self.mode else None)
        object.__setattr__(self, "strategy", Strategy(self.strategy))
        object.__setattr__(self, "cursor", next((c for c in (self.cursor, self.incr_value) if c and c.strip()), None))


def check_task(task: SyncTask) -> SyncTask:
    """The task, if it may be saved. Raises ValueError where a run could only warn or read everything again."""
    wrong = []
    if task.mode != Mode.FULL and not (task.incr_column and task.incr_column.strip()):
        wrong.append("INCR_COLUMN_MISSING: an incremental task needs an incremental column")
    if task.batch_size > task.page_size:
        wrong.append("INVALID_BATCH_SIZE: a batch is no larger than a page")
    if wrong:
        raise ValueError("; ".join(wrong))
    return task


@dataclass(frozen=True)
class Issue:
    level: Level
    code: str
    message: str
    hint: str = ""


def has_error(issues) -> bool:
    return any(i.level == Level.ERROR for i in issues)


@dataclass
class SyncResult:
    task_id: int
    status: Status
    read_rows: int = 0
    written_rows: int = 0
    skipped_rows: int = 0
    millis: int = 0
    start_cursor: str | None = None
    end_cursor: str | None = None
    message: str | None = None
    issues: list[Issue] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)


#: How a secret looks in a message, and what stands in its place.
_SECRET = re.compile(r"(password|pwd|passwd)\s*[=:]\s*\S+", re.I)


def scrub(message: str, most: int = 1000) -> str:
    return _SECRET.sub(r"\1=***", message)[:most]
