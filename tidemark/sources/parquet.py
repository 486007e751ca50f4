"""Versioned Parquet tables: each commit writes new files, and a pointer lists the files that count.

A reader never sees half a commit and a failed run leaves the last one in place. All access goes through Hadoop's file
systems, so a table can lie in any store that Spark writes to.

The pointer of a version is one file, created without overwriting and carrying the list: one of two writers gets the
version, the other fails and may start again from the new one. A writer that dies leaves at most an empty pointer, which
is passed over once it is older than GRACE_SECONDS. Exclusive creation is atomic on local disks, HDFS, Azure and Google
storage; on S3A it is checked when the file is opened only, so there one writer per table is the caller's duty.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..operators.merge import append, compared, last_wins, merge

#: An upsert's keys are told by at most so many ranges when files are searched for them.
RANGES = 512
#: Tables of no more files than this are not searched by statistics, and write none.
FEW_FILES = 8
#: An empty pointer younger than this may still be written to.
GRACE_SECONDS = 60


def _has_order(kind: DataType) -> bool:
    return kind.typeName() not in ("map", "variant", "interval")


class Conflict(RuntimeError):
    """Another writer committed first."""


class ParquetTables:
    kind = "PARQUET"

    #: upsert takes compare and version.
    compares = True

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, keep_seconds: float = 3600, rows_per_file: int = 0) -> None:
        """Of each table the last `keep` versions stay, and others for `keep_seconds` after they are followed: as long as
        a reader of theirs may take. Files get at most rows_per_file rows, if it is given."""
        self.spark, self.root, self.keep, self.keep_seconds, self.rows_per_file = spark, root.rstrip("/"), keep, keep_seconds, rows_per_file
        #: Of the last upsert: files of the table, files whose keys were read, files that were put anew.
        self.touched = (0, 0, 0)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> dict[str, float]:
        """Names in a folder and when they changed, in seconds; empty if there is no such folder."""
        place = self._path(*parts)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs().listStatus(place)} if self._fs().exists(place) else {}

    def _create(self, text: str, *parts: str) -> None:
        """A new file; fails if it exists."""
        out = self._fs().create(self._path(*parts), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _manifest(self, table: str, version: int) -> dict | None:
        """What a pointer says; None if it is empty, or gone with a version that another commit has let go."""
        try:
            stream = self._fs().open(self._path(table, f"p{version}"))
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def _versions(self, table: str) -> list[int]:
        """Numbers of pointers, oldest first, without empty ones."""
        return [v for v in self._numbers(table) if self._manifest(table, v)]

    def _numbers(self, table: str) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(table) if n.startswith("p") and n[1:].isdigit())

    def exists(self, table: str) -> bool:
        return self._base(table) > 0

    def tables(self) -> list[str]:
        return sorted(n for n in self._names() if self.exists(n))

    def files(self, table: str, version: int | None = None) -> list[str]:
        """Paths of the files of a version, the latest by default."""
        return [f"{self.root}/{table}/{f}" for f in self._of(table, version)["files"]]

    def _of(self, table: str, version: int | None) -> dict:
        at = self._base(table) if version is None else version
        if not at:
            raise FileNotFoundError(f"{table} has no committed version")
        found = self._manifest(table, at)
        if found is None:
            raise FileNotFoundError(f"{table} has no version {at}")
        return found

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self._of(table, version)
        return self._rows(table, found["files"], StructType.fromJson(found["schema"]))

    def _rows(self, table: str, files: list[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{f}" for f in files])

    def _statistics(self, table: str, folder: str, keys: Sequence[str]) -> str | None:
        """A part with the least and greatest key of each file of a folder, from its key columns alone."""
        new = self.spark.read.parquet(f"{self.root}/{table}/{folder}")
        if not keys or any(k not in new.columns or not _has_order(new.schema[k].dataType) for k in keys):
            return None
        key = F.struct(*[F.col(f"`{k}`") for k in keys])
        known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
        file = F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        part = f"s-{uuid.uuid4().hex}"
        found = new.select(file.alias("file"), F.when(known, key).alias("key")).groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        found.coalesce(1).write.parquet(f"{self.root}/{table}/{part}")
        return part

    def _met(self, table: str, found: dict, rows: DataFrame, keys: Sequence[str]) -> list[str]:
        """Files that may hold a key of rows: those without statistics by these keys, and those that meet a range of rows' keys."""
        parts = found.get("statistics", {}) if found.get("keys") == list(keys) else {}
        if not parts:
            return found["files"]
        known = rows.select(*[F.col(f"`{k}`") for k in keys]).dropna()
        key = F.struct(*[F.col(f"`{k}`") for k in keys])
        ranges = known.repartitionByRange(RANGES, *[F.col(f"`{k}`") for k in keys]).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
        stats = self.spark.read.parquet(*[f"{self.root}/{table}/{p}" for p in sorted(set(parts.values()))])
        hit = stats.join(F.broadcast(ranges), (F.col("low") <= F.col("last")) & (F.col("first") <= F.col("high")), "left_semi")
        names = {r[0] for r in hit.select("file").collect()}  # names of the few files that an upsert meets
        return [f for f in found["files"] if f in names or f.split("/")[0] not in parts]

    @staticmethod
    def _by_range(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows by ranges of keys and in their order: files that a task's rows are cut into are ranges as well."""
        told = [F.col(f"`{k}`") for k in keys]
        return rows.repartitionByRange(*told).sortWithinPartitions(*told)

    def _commit(self, table: str, rows: DataFrame, base: int, kept: list[str] = (), keys: Sequence[str] = ()) -> int:
        """Write rows, then point at them and at the kept files of the base version, as the version after it."""
        version = base + 1
        for number, changed in ((n, t) for n, t in self._names(table).items() if n.startswith("p") and n[1:].isdigit() and int(n[1:]) >= version):
            if self._manifest(table, int(number[1:])) or time.time() - changed < GRACE_SECONDS:
                raise Conflict(f"{table} moved on from version {base}")
            version = max(version, int(number[1:]) + 1)
        folder = f"v{version}-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.root}/{table}/{folder}")
        files = [f"{folder}/{n}" for n in self._names(table, folder) if n.endswith(".parquet")]
        before = self._manifest(table, base) if kept else {}
        if before is None:
            self._fs().delete(self._path(table, folder), True)
            raise Conflict(f"{table} moved on from version {base}")
        keys = list(keys or before.get("keys", ()))
        there = {f.split("/")[0] for f in kept}
        parts = {f: p for f, p in before.get("statistics", {}).items() if f in there} if before.get("keys") == keys else {}
        part = self._statistics(table, folder, keys) if files and len(kept) + len(files) > FEW_FILES else None
        if part:
            parts[folder] = part
        try:
            self._create(json.dumps({"schema": json.loads(rows.schema.json()), "keys": keys, "statistics": parts, "files": [*kept, *files]}), table, f"p{version}")
        except Exception as e:
            for gone in filter(None, (folder, part)):
                self._fs().delete(self._path(table, gone), True)
            raise Conflict(f"{table} moved on from version {base}") from e
        self._forget(table)
        return version

    def _forget(self, table: str) -> None:
        """Delete versions that are neither among the last nor young: their pointers, and files that no kept version lists."""
        written = {int(n[1:]): t for n, t in self._names(table).items() if n.startswith("p") and n[1:].isdigit()}
        numbers = sorted(written)
        old = [v for v, after in zip(numbers, numbers[1:], strict=False) if v in numbers[: -self.keep] and time.time() - written[after] >= self.keep_seconds]
        if not old:
            return
        listed = lambda m: {*m["files"], *m.get("statistics", {}).values()} if m else set()
        last = {f for v in numbers if v not in old for f in listed(self._manifest(table, v))}
        for v in old:
            gone = listed(self._manifest(table, v))
            self._fs().delete(self._path(table, f"p{v}"), False)
            for f in gone - last:
                self._fs().delete(self._path(table, f), True)

    def sweep(self, table: str, older_than_seconds: float = 86_400) -> int:
        """Delete folders that no version lists and no running writer can still commit. Returns how many."""
        kept = [m for m in (self._manifest(table, v) for v in self._versions(table)) if m]
        used = {f.split("/")[0] for m in kept for f in (*m["files"], *m.get("statistics", {}).values())}
        old = [n for n, t in self._names(table).items() if n.startswith(("v", "s-")) and n not in used and time.time() - t >= older_than_seconds]
        for n in old:
            self._fs().delete(self._path(table, n), True)
        return len(old)

    def _base(self, table: str) -> int:
        """The latest committed version; 0 if there is none. Looks at no more pointers than it must."""
        return next((v for v in reversed(self._numbers(table)) if self._manifest(table, v)), 0)

    def _of_base(self, table: str, at: int) -> dict:
        found = self._manifest(table, at) if at else None
        if found is None and at:
            raise Conflict(f"{table} moved on from version {at}")
        return found or self._of(table, at or None)

    def replace(self, table: str, rows: DataFrame, base: int | None = None, keys: list[str] = (), **_) -> int:
        """All rows anew. With keys they lie by key range, so that later upserts of few keys touch few files.

        Fails with Conflict if the table is not at version `base`, where one is given, or another writer is first. The
        refresh strategies of databases all come to this: the table changes over in one step.
        """
        at = self._base(table)
        if base is not None and base != at:
            raise Conflict(f"{table} moved on from version {base}")
        return self._commit(table, self._by_range(rows, keys) if keys else rows, at, keys=keys)

    def append(self, table: str, rows: DataFrame, base: int | None = None) -> int:
        """Plain insert: the files of the table stay, the rows come in new ones."""
        at = self._base(table) if base is None else base
        found = self._of_base(table, at)
        return self._commit(table, append(self._rows(table, [], StructType.fromJson(found["schema"])), rows), at, found["files"])

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: list[str], unique: bool = False, compare: bool = False, version: str | None = None) -> int:
        """Rewrites only the files that hold a key of rows; all others are listed again as they are.

        Statistics leave few files to search, of which the key columns are read. With `unique` no key comes twice in rows.
        With `compare` rows that change nothing are left out, and without others no version is written; with a `version`
        column neither do rows change a row of the table that has a greater one, so that batches may come in any order.
        """
        at = self._base(table)
        found = self._of_base(table, at)
        schema, met = StructType.fromJson(found["schema"]), self._met(table, found, rows, keys)
        names = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        told = [F.col(f"`{k}`") for k in keys]
        # names of files, of which a table has as many as it has parts
        touched = {r[0] for r in self._rows(table, met, schema).select(*told, names.alias("_file")).join(rows.select(*told).distinct(), list(keys), "left_semi").select("_file").distinct().collect()} if met else set()
        old = [f for f in met if f.rsplit("/", 1)[-1] in touched]
        if compare or version:
            columns = [F.col(f"`{c}`") for c in rows.columns if c in schema.names]
            rows, unique = (rows if unique else last_wins(rows, keys, order)).select(*columns), True
            if old:
                both = compared(self._rows(table, old, schema).withColumn("_file", names), rows, keys, version, ["_file"])
                touched = {r[0] for r in both.where("_changes").select("_file").distinct().collect()}
                rows = rows.join(both.where("not _changes").select(*told).distinct(), list(keys), "left_anti").select(*columns)
                old = [f for f in old if f.rsplit("/", 1)[-1] in touched]
            if not old and rows.isEmpty():
                self.touched = len(found["files"]), len(met), 0
                return at
        self.touched = len(found["files"]), len(met), len(old)
        new = merge(self._rows(table, old, schema), rows, keys, order, unique=unique)
        if found.get("statistics") and found.get("keys") == list(keys):  # what lies by key range goes on to
            new = self._by_range(new, keys)
        gone = set(old)
        return self._commit(table, new, at, [f for f in found["files"] if f not in gone], keys)

    def compact(self, table: str, keys: list[str] = ()) -> int:
        """The same rows in new files, after many small upserts."""
        return self.replace(table, self.read(table), self._base(table), keys)

    def create(self, table: str, rows: DataFrame, keys: list[str] = ()) -> int:
        return self.replace(table, last_wins(rows, keys) if keys else rows, 0, keys)
