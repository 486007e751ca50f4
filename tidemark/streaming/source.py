"""A table as a stream by a composite cursor: the offset of a query is the position of the last row it has read.

A query that is started again from its checkpoint goes on after that position, ties included, as an incremental run goes
on from its cursor; and an offset's cursor, in UTC, is one that a task takes, so a stream and runs can follow each other.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.types import spec_of
from ..operators.cursor import text_of, typed

NAME = "tidemark_cursor"
#: Row groups are put together into parts of about so many bytes.
PART_BYTES = 128 << 20
#: Footers are read by so many threads.
THREADS = 16
BATCH_ROWS = 10_000
_ORDERED = (pa.types.is_integer, pa.types.is_decimal, pa.types.is_date, pa.types.is_timestamp, pa.types.is_string)


def stream_by_cursor(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], lag_seconds: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of a Parquet table in batches of ascending (cursor, ties): `keys`, the cursor first.

    `path` is a file, a folder to which files are added, or a table of ParquetTables, of which the latest version counts,
    in a file system that Arrow reads. A batch takes all rows after the last position up to the greatest, or with
    `lag_seconds` up to that long before now, for rows that are committed late. Each row comes once: a row that is added
    at or before a position already read does not come, nor does one whose cursor is null. A null tie is less than all
    others; rows with all keys equal come together. Texts come whole, other columns as they are, and a column that a file
    lacks is null. Large tables should say bounds of their cursor in their footers, so times should be TIMESTAMP_MICROS and
    not INT96, which has none: else the start of a query reads that column of all files. A table without rows gives no batch. A row that is updated comes again with its greater cursor. Of a
    table that loses its last rows a query that was started again may give the rows after the new last one anew.
    """
    arrow = to_arrow_schema(schema)
    if not keys or any(not any(kind(arrow.field(k).type) for kind in _ORDERED) for k in keys):
        raise ValueError(f"a cursor is of whole numbers, decimals, dates, timestamps or texts: {list(keys)}")
    spark.dataSource.register(CursorSource)
    options = {"keys": json.dumps(list(keys)), "lag_seconds": str(lag_seconds), "part_bytes": str(part_bytes)}
    return spark.readStream.format(NAME).schema(schema).options(**options).load(path)


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> CursorReader:
        return CursorReader(self.options, schema)


@dataclass
class Part(InputPartition):
    """Row groups, as (file, number), and the positions between which their rows are read."""

    groups: list[tuple[str, int]]
    after: list | None
    upto: list


@dataclass(frozen=True)
class Group:
    """A row group that has a cursor, and bounds of it."""

    file: str
    number: int
    size: int
    low: object
    high: object


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.keys = options["path"], json.loads(options["keys"])
        self.lag, self.part_bytes = int(options["lag_seconds"]), int(options["part_bytes"])
        self.schema = schema
        self._footers: dict[tuple, list[Group]] = {}

    # offsets ---------------------------------------------------------------------------------------------------------

    def initialOffset(self) -> dict:
        return {"cursor": None}

    def latestOffset(self) -> dict:
        """The greatest position of the table. Groups are looked into from the greatest upper bound down, until no other
        can hold a greater one, and of them the key columns only."""
        bound, best = self._bound(), None
        top = lambda g: g.high if bound is None else min(g.high, bound)
        for g in sorted((g for g in self._groups() if bound is None or g.low <= bound), key=top, reverse=True):
            if best is not None and top(g) < best[0]:
                break
            found = self._last(g, bound)
            if found is not None and (best is None or _place(found) > _place(best)):
                best = found
        return {"cursor": None if best is None else json.dumps([v if v is None or isinstance(v, str) else text_of(v) for v in best])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, upto = self._values(start), self._values(end)
        if upto is None or after is not None and _place(upto) <= _place(after):
            return []
        parts, size = [], 0
        for g in sorted(self._groups(), key=lambda g: (g.file, g.number)):
            if g.low > upto[0] or after is not None and g.high < after[0]:
                continue
            if not parts or size + g.size > self.part_bytes:
                parts.append(Part([], after, upto))
                size = 0
            parts[-1].groups.append((g.file, g.number))
            size += g.size
        return parts

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch, so nothing is let go."""

    # rows ------------------------------------------------------------------------------------------------------------

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        for path, number in partition.groups:
            with _open(path) as f:
                there = set(f.schema_arrow.names)
                for batch in f.iter_batches(BATCH_ROWS, [number], [c for c in arrow.names if c in there]):
                    columns = [batch.column(x.name).cast(x.type) if x.name in there else pa.nulls(len(batch), x.type) for x in arrow]
                    rows = pa.RecordBatch.from_arrays(columns, schema=arrow)
                    wanted = pc.and_(pc.is_valid(rows.column(self.keys[0])), pc.invert(self._after(rows, partition.upto)))
                    if partition.after is not None:
                        wanted = pc.and_(wanted, self._after(rows, partition.after))
                    rows = rows.filter(wanted)
                    if len(rows):
                        yield rows

    def _after(self, rows: pa.RecordBatch, position: list) -> pa.Array:
        """Which rows come after a position: (a > x) or (a = x and b > y) ..., a null tie before all others."""
        found, same = pa.repeat(False, len(rows)), pa.repeat(True, len(rows))
        for key, value in zip(self.keys, position, strict=True):
            c = rows.column(key)
            greater = pc.is_valid(c) if value is None else pc.fill_null(pc.greater(c, pa.scalar(value, c.type)), False)
            equal = pc.is_null(c) if value is None else pc.fill_null(pc.equal(c, pa.scalar(value, c.type)), False)
            found, same = pc.or_(found, pc.and_(same, greater)), pc.and_(same, equal)
        return found

    def _last(self, g: Group, bound) -> list | None:
        """The greatest position in a row group up to a bound of the cursor; None if it has none."""
        arrow = to_arrow_schema(self.schema)
        with _open(g.file) as f:
            rows = f.read_row_group(g.number, [k for k in self.keys if k in f.schema_arrow.names])
        rows, out = rows.filter(pc.is_valid(rows[self.keys[0]])), []
        if bound is not None:
            first = rows[self.keys[0]].cast(arrow.field(self.keys[0]).type)
            rows = rows.filter(pc.less_equal(first, pa.scalar(bound, first.type)))
        if not len(rows):
            return None
        for k in self.keys:
            c = rows[k].cast(arrow.field(k).type) if k in rows.column_names else pa.chunked_array([pa.nulls(len(rows), arrow.field(k).type)])
            most = pc.max(c)
            out.append(_plain(most.as_py()))
            if most.is_valid:
                rows = rows.filter(pc.fill_null(pc.equal(c, most), False))
        return out

    # files -----------------------------------------------------------------------------------------------------------

    def _bound(self):
        if not self.lag:
            return None
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None) - dt.timedelta(seconds=self.lag)
        kind = to_arrow_schema(self.schema).field(self.keys[0]).type
        return now if pa.types.is_timestamp(kind) else now.date() if pa.types.is_date(kind) else None

    def _values(self, offset: dict) -> list | None:
        if offset["cursor"] is None:
            return None
        specs = [spec_of(self.schema[k]) for k in self.keys]
        return [None if p is None else typed(p, s) for p, s in zip(json.loads(offset["cursor"]), specs, strict=True)]

    def _groups(self) -> list[Group]:
        """The row groups of all files that count. Bounds are read once a file while this reader lives: from its footer, or
        where that has none, as for INT96 times and decimals, from the cursor's column."""
        files = list(_files(self.path))
        missing = [f for f in files if f not in self._footers]
        with ThreadPoolExecutor(THREADS) as pool:
            new = dict(zip(missing, pool.map(lambda f: self._footer(f[0]), missing), strict=True))
        self._footers = {f: new[f] if f in new else self._footers[f] for f in files}
        return [g for f in files for g in self._footers[f]]

    def _footer(self, path: str) -> list[Group]:
        out, key = [], self.keys[0]
        kind = to_arrow_schema(self.schema).field(key).type
        with _open(path) as f:
            names = [f.metadata.schema.column(i).path for i in range(f.metadata.num_columns)]
            if key not in names:
                return []  # no row has a cursor
            at = names.index(key)
            told = not pa.types.is_decimal(kind) and f.metadata.schema.column(at).physical_type != "INT96"
            for n in range(f.metadata.num_row_groups):
                group = f.metadata.row_group(n)
                said = group.column(at).statistics if told else None
                if said is not None and said.has_min_max:
                    low, high = said.min, said.max
                else:
                    low, high = pc.min_max(f.read_row_group(n, [key])[key].cast(kind)).as_py().values()
                if low is not None:
                    out.append(Group(path, n, group.total_byte_size, _plain(low), _plain(high)))
        return out


def _plain(value):
    """Points in time without a zone, in UTC."""
    return value.astimezone(dt.UTC).replace(tzinfo=None) if isinstance(value, dt.datetime) and value.tzinfo else value


def _place(position: list) -> list:
    """A position for comparing: a null is less than all others."""
    return [(v is not None, v if v is not None else 0) for v in position]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^s3[an]:", "s3:", path)
    if re.match("[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


def _open(path: str) -> pq.ParquetFile:
    system, place = _system(path)
    return pq.ParquetFile(system.open_input_file(place), coerce_int96_timestamp_unit="us")


def _files(path: str) -> Iterator[tuple[str, int, object]]:
    """Name, size and time of each file that counts: those of a versioned table's latest pointer, or all of a folder."""
    system, place = _system(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) and not path.startswith("file:") else ""
    top = system.get_file_info(place)
    if top.type == fs.FileType.File:
        yield path, top.size, top.mtime_ns
        return
    if top.type == fs.FileType.NotFound:
        return
    names = [i for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File]
    for pointer in sorted((i for i in names if re.fullmatch(r"p\d+", i.base_name)), key=lambda i: -int(i.base_name[1:])):
        text = system.open_input_file(pointer.path).read().decode()
        if text.endswith("}"):  # else its writer died
            for i in json.loads(text)["files"]:
                yield f"{prefix}{place}/{i}", 0, None  # a file of a version never changes
            return
    for i in system.get_file_info(fs.FileSelector(place, recursive=True)):
        inside = i.path[len(place.rstrip("/")) + 1 :].split("/")
        if i.type == fs.FileType.File and i.base_name.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in inside):
            yield prefix + i.path, i.size, i.mtime_ns
