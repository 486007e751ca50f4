"""What a source or target is, and which one an address means."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import spec_of
from ..model import Strategy, TableSpec
from ..plans.guard import check_sql, normalize

# Words in a product or driver name, by database.
_KINDS = {"MYSQL": ("mysql", "mariadb", "percona"), "DM8": ("dameng", "达梦", "dm")}


def database_kind(*names: str | None) -> str | None:
    """MYSQL or DM8 by the product's name, then the driver's; None if neither says."""
    for name in names:
        for kind, words in _KINDS.items():
            if name and any(w in name.lower() for w in words):
                return kind
    return None


def staging_dir(spark: SparkSession) -> str:
    """Where runs keep their converted rows: the folder all executors share; a local one only in local mode."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (known or _local_dir()).rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


class Source(Protocol):
    kind: str

    def read(self, table: str) -> DataFrame: ...

    def exists(self, table: str) -> bool: ...

    def tables(self) -> list[str]: ...


class Target(Source, Protocol):
    def replace(self, table: str, rows: DataFrame, *, strategy: Strategy = ..., keys: list[str] = ...) -> None: ...

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: list[str], *, unique: bool = ...) -> None: ...

    def append(self, table: str, rows: DataFrame) -> None: ...


def spec_from(df: DataFrame, primary_key=(), unique_keys=(), indexed=()) -> TableSpec:
    return TableSpec(tuple(spec_of(f) for f in df.schema.fields), tuple(primary_key), tuple(map(tuple, unique_keys)), tuple(indexed))


def describe(df: DataFrame, spec: TableSpec | None = None) -> list[dict]:
    spec = spec or spec_from(df)
    key = {k.lower() for k in spec.primary_key}
    return [{"name": c.name, "type": c.sql_type, "nullable": c.nullable, "primary_key": c.name.lower() in key} for c in spec.columns]


def read_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Rows of one read-only statement; the parsed plan must be a query, whatever its words were."""
    issue = check_sql(sql)
    if issue:
        raise ValueError(issue.message)
    df = spark.sql(normalize(sql))
    if df._jdf.queryExecution().logical().getClass().getName().rsplit(".", 1)[-1].endswith("Command"):
        raise ValueError("the statement is a command")
    return df


def sql_columns(spark: SparkSession, sql: str) -> list[dict]:
    """Columns of a statement; it is analysed and not run."""
    return describe(read_sql(spark, sql))


def preview(spark: SparkSession, sql: str, rows: int = 5) -> DataFrame:
    return read_sql(spark, sql).limit(max(1, min(1000, rows)))
