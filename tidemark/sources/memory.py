"""Tables that are DataFrames, for tests and for composing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.merge import append, merge


class MemoryTables:
    kind = "MEMORY"

    def __init__(self, **tables: DataFrame) -> None:
        self._tables = dict(tables)

    def read(self, table: str) -> DataFrame:
        return self._tables[table]

    def exists(self, table: str) -> bool:
        return table in self._tables

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def replace(self, table: str, rows: DataFrame, **_) -> None:
        self._tables[table] = append(self._tables[table].limit(0), rows)

    def append(self, table: str, rows: DataFrame) -> None:
        self._tables[table] = append(self._tables[table], rows)

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: list[str], unique: bool = False) -> None:
        self._tables[table] = merge(self._tables[table], rows, keys, order, unique=unique)
