"""Cursors of incremental reads: their text, their types, and the window of rows a run reads."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import INTEGERS, family, is_timestamp_cursor
from ..model import ColumnSpec, IncrPolicy
from .keyset import all_of, between, keyset_predicate


def text_of(value: object) -> str:
    """Canonical text; bars and backslashes inside it are escaped, so that parts never run together."""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, dt.datetime):
        said = value.strftime("%Y-%m-%d %H:%M:%S")
        return f"{said}.{value.microsecond:06d}".rstrip("0") if value.microsecond else said
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, bytes | bytearray):
        return text_of(bytes(value).decode("utf-8", "replace"))
    return re.sub(r"([\\|])", r"\\\1", value) if isinstance(value, str) else str(value)


def encode(values: list) -> str:
    return "|".join(text_of(v) for v in values)


def decode(cursor: str | None) -> list[str]:
    """The parts of a cursor: bar-separated or a JSON array. Text that is neither is one part; nothing raises."""
    if cursor is None or not cursor.strip():
        return []
    if cursor.strip().startswith("["):
        try:
            found = json.loads(cursor)
            if isinstance(found, list):
                return ["" if x is None else str(x) for x in found]
        except ValueError:
            pass  # a text that begins like an array
    parts, escaped = [""], False
    for c in cursor:
        if escaped or c not in "\\|":
            parts[-1], escaped = parts[-1] + c, False
        elif c == "\\":
            escaped = True
        else:
            parts.append("")
    parts[-1] += "\\" if escaped else ""
    return parts


def typed(part: str, column: ColumnSpec) -> object:
    """A part as a value of its column; text that is no such value stays text."""
    kind = family(column)
    try:
        if kind in INTEGERS or kind == "year":
            return int(Decimal(part[:4] if kind == "year" and "-" in part else part))
        if kind == "decimal":
            return Decimal(part)
        if kind in ("float", "double"):
            return float(part)
        if kind == "date":
            return dt.date.fromisoformat(part[:10])
        if kind in ("timestamp", "timestamptz"):
            return dt.datetime.fromisoformat(part.replace("T", " ")).replace(tzinfo=None)
    except (ValueError, ArithmeticError):
        return part
    return part


@dataclass(frozen=True)
class ReadWindow:
    """lower < cursor <= upper, or everything after a position of (cursor, ties) up to upper."""

    column: str
    ties: tuple[str, ...] = ()
    lower: object = None
    upper: object = None
    position: tuple | None = None

    def predicate(self) -> Column | None:
        return all_of(between(self.column, self.lower, self.upper), keyset_predicate([self.column, *self.ties], self.position))

    def apply(self, df: DataFrame) -> DataFrame:
        where = self.predicate()
        return df if where is None else df.where(where)


def look_back(value: object, column: ColumnSpec, by: int) -> object:
    """A bound moved back: seconds for points in time, whole days for dates, plain units for numbers."""
    if not by or isinstance(value, str):
        return value
    if family(column) == "date":
        return value - dt.timedelta(days=-(-by // 86400))
    return value - dt.timedelta(seconds=by) if is_timestamp_cursor(column) else value - by


def anchor(df: DataFrame, column: ColumnSpec, policy: IncrPolicy, now: dt.datetime | None) -> object:
    """The upper bound of a run, taken once: now less the safety lag for points in time, else the greatest value."""
    if is_timestamp_cursor(column):
        if now is None:
            raise ValueError("a cursor in time needs the moment of the run")
        bound = now - dt.timedelta(seconds=max(0, policy.safety_lag_seconds))
        return bound.date() if family(column) == "date" else bound
    return df.agg(F.max(f"`{column.name}`")).first()[0]


def read_window(cursor: str | None, column: ColumnSpec, ties: list[ColumnSpec], policy: IncrPolicy, upper: object) -> ReadWindow:
    """The rows of an incremental run.

    Without a cursor everything up to `upper`. With a cursor that has a value for each tie and no look-back, the rows
    after that position: a tie of the last row read is neither lost nor read twice. Otherwise the cursor's own value,
    moved back, is the exclusive lower bound.
    """
    names = tuple(t.name for t in ties)
    parts = decode(cursor)
    if not parts:
        return ReadWindow(column.name, names, None, upper)
    first = typed(parts[0], column)
    if names and len(parts) == len(names) + 1 and not policy.lookback_seconds:
        return ReadWindow(column.name, names, None, upper, (first, *[typed(p, t) for p, t in zip(parts[1:], ties, strict=True)]))
    return ReadWindow(column.name, names, look_back(first, column, policy.lookback_seconds), upper)


def end_cursor(df: DataFrame, keys: list[str]) -> Column:
    """Aggregate: the keys of the last row in order, as a struct; null over no rows."""
    return F.max(F.struct(*keys))
