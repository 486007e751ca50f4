"""Tables in a database: Spark reads and writes in parallel, one set-based statement from the driver merges.

Reads go in parts of about as many rows, whatever the key: its bounds are taken one from the other, in a single pass over
the key's index, within the window that is read. Writes go to a staging table first. Where the statement that merges it
fails because of rows, the rows are halved by their number until those that the database refuses are found, all in one
transaction: they are set aside, as far as a caller allows, and the others are written.

A database embedded in the driver's process cannot be reached by executors in processes of their own. It is read and
written by files then, in the folder that the executors share: it unloads each part of a read by itself, and loads the
files that tasks have written.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import closing, contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Strategy
from ..operators.cursor import ReadWindow
from ..operators.merge import last_wins
from ..plans.guard import check_sql, normalize
from .base import database_kind, staging_dir
from .dialect import dialect_of

#: How long a connection may take to open, and a test of it to answer.
LOGIN_SECONDS, ANSWER_SECONDS = 5, 15
#: Stands for a null where files are read: no text of a database has this.
NO_VALUE = "\0null\0"
#: Number of a row in a staging table.
NUMBER = "DS_ROW"
# Classes of SQL states that rows are to blame for (data that does not fit, broken constraints), and types of
# text without a bound, as databases name them.
ROW_STATES = ("22", "23")
LONG_TEXTS = ("CLOB", "TEXT", "MEDIUMTEXT", "LONGTEXT", "LONG VARCHAR")


@dataclass(frozen=True)
class Rejected:
    """A row as it was staged, by column and as text, and why the database refuses it."""

    row: dict[str, str | None]
    message: str


class TooManyRejected(RuntimeError):
    def __init__(self, rejected: list[Rejected], most: int) -> None:
        super().__init__(f"the database refuses more than {most} rows; the last: {rejected[-1].message}")
        self.rejected = rejected


def refused(error: Exception) -> str | None:
    """What a database says of rows that it refuses; None for any other failure."""
    e, seen = getattr(error, "java_exception", None), 0
    while e is not None and seen < 20:
        if hasattr(e, "getSQLState") and (e.getSQLState() or "").startswith(ROW_STATES):
            return e.getMessage()
        e, seen = e.getCause(), seen + 1
    return None


class JdbcTables:
    def __init__(self, spark: SparkSession, url: str, kind: str | None = None, fetch_size: int = 1000, batch_size: int = 500, connections: int = 8, by_files: bool | None = None, **options: str) -> None:
        """With by_files rows go by files in the shared folder; by default where only the driver reaches the database."""
        self.spark, self.url, self.options = spark, url, options
        embedded = url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")
        self.by_files = embedded and not re.match(r"local(\[|$)", spark.sparkContext.master) if by_files is None else by_files
        self.kind = kind or ("DERBY" if ":derby:" in url else database_kind(url)) or "ANSI"
        self.dialect, self.fetch_size, self.batch_size, self.connections = dialect_of(self.kind), fetch_size, batch_size, connections

    #: upsert and replace take most_rejected, and tell the rows that the database refuses.
    isolates = True

    def read(self, table: str, keys: str | Sequence[str] = (), window: ReadWindow | None = None) -> DataFrame:
        """The table; with keys, in as many parts by ranges of them as there may be connections.

        The parts are even over the rows of the window, if one is given; it is the caller that filters by it.
        """
        return self._load(self.dialect.quote(table), keys, window)

    def query(self, sql: str, keys: str | Sequence[str] = (), window: ReadWindow | None = None) -> DataFrame:
        """Rows of one read-only statement of the database's own; with keys of it, read in parts."""
        issue = check_sql(sql, self.kind)
        if issue:
            raise ValueError(issue.message)
        return self._load(f"({normalize(sql)}) ds_src", keys, window)

    def _load(self, place: str, keys: str | Sequence[str], window: ReadWindow | None = None) -> DataFrame:
        options = {"url": self.url, "fetchsize": str(self.fetch_size), **self.options}
        keys = [keys] if isinstance(keys, str) else list(keys)
        ends = [self.dialect.after(keys, b) for b in self.bounds(place, keys, window)] if keys else []
        if not ends or None in ends:
            return self._unloaded(place, [""]) if self.by_files else self.spark.read.format("jdbc").options(dbtable=place, **options).load()
        # NOT (after) is not true of a null key; such rows go with the first part
        null = "(" + " OR ".join(f"{self.dialect.quote(k)} IS NULL" for k in keys) + ")"
        middle = [f"{lo} AND NOT {hi} AND NOT {null}" for lo, hi in zip(ends, ends[1:], strict=False)]
        parts = [f"NOT {ends[0]} OR {null}", *middle, f"{ends[-1]} AND NOT {null}"]
        return self._unloaded(place, parts) if self.by_files else self.spark.read.jdbc(self.url, place, predicates=parts, properties=options)

    def _unloaded(self, place: str, parts: Sequence[str]) -> DataFrame:
        """The rows of each part as the database has them now, from a file that it writes for the part."""
        schema = self.spark.read.format("jdbc").options(url=self.url, dbtable=place, **self.options).load().schema  # asked by the driver
        folder, out = f"{staging_dir(self.spark)}/unloaded-{uuid.uuid4().hex}", []
        texts = ", ".join(f"_{i} string" for i in range(len(schema)))
        for i, part in enumerate(parts):
            with self._own_file() as file:
                self.execute(self.dialect.unload(f"SELECT {self.dialect.names(schema.names)} FROM {place}{part and f' WHERE {part}'}", file))
                at = self._path(f"{folder}/{i}.csv")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, self._path(f"file://{file}"), at)
            out.append(self.spark.read.csv(f"{folder}/{i}.csv", schema=texts, escape='"', multiLine=True, nullValue=NO_VALUE, emptyValue="", mode="FAILFAST"))
        typed = [(F.unhex(f"_{i}") if f.dataType.typeName() == "binary" else F.col(f"_{i}").cast(f.dataType)).alias(f.name) for i, f in enumerate(schema)]
        return reduce(DataFrame.union, out).select(*typed)

    def _loaded(self, table: str, rows: DataFrame) -> None:
        """Rows into an empty table with just their columns, from files that tasks write."""
        folder = f"{staging_dir(self.spark)}/loaded-{uuid.uuid4().hex}"
        text = lambda f: F.hex(F.col(f"`{f.name}`")) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`").cast("string")
        cell = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
        rows.select(F.concat_ws(",", *[cell(text(f)) for f in rows.schema]).alias("line")).write.text(folder)
        at, conf = self._path(folder), self.spark._jsc.hadoopConfiguration()
        fs = at.getFileSystem(conf)
        try:
            with self._own_file() as file:  # all in one, as a database loads an empty table the fastest
                for found in fs.listStatus(at):
                    if found.getPath().getName().startswith("part-") and found.getLen():
                        fs.copyToLocalFile(False, found.getPath(), self._path(f"file://{file}.part"), True)
                        with open(f"{file}.part", "rb") as part, open(file, "ab") as whole:
                            shutil.copyfileobj(part, whole)
                if os.path.exists(file):
                    self.execute(self.dialect.load(table, file))
        finally:
            fs.delete(at, True)

    def _path(self, place: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(place)

    @contextmanager
    def _own_file(self) -> Iterator[str]:
        """A file of the driver's own that is not there yet, gone at the end."""
        with tempfile.TemporaryDirectory(prefix="tidemark-", ignore_cleanup_errors=True) as folder:
            yield f"{os.path.realpath(folder)}/rows.csv"

    def bounds(self, place: str, keys: Sequence[str], window: ReadWindow | None = None) -> list[list]:
        """Positions that cut the rows in parts of equal number, by keys in order. Each is found from the one before it,
        so all of them take one pass over an index of the keys."""
        names, within = self.dialect.names(keys), self._within(window)
        rows = lambda sql: self._load(f"({sql}) ds_bound", ()).head(1)
        where = lambda *asked: " WHERE " + " AND ".join(a for a in asked if a) if any(asked) else ""
        there = " AND ".join(f"{self.dialect.quote(k)} IS NOT NULL" for k in keys)
        n = int(rows(f"SELECT COUNT(*) AS N FROM {place}{where(within, there)}")[0][0])
        step, out, after = -(-n // self.connections), [], None
        if n < self.connections:
            return []
        while (len(out) + 1) * step < n:
            found = rows(f"SELECT {names} FROM {place}{where(within, there, after)} ORDER BY {names} {self.dialect.nth(step - 1)}")
            after = found and self.dialect.after(keys, list(found[0]))
            if not after:  # the table shrank, or a key of this type has no literal
                break
            out.append(list(found[0]))
        return out

    def _within(self, window: ReadWindow | None) -> str | None:
        """The window as SQL; None if it has no bounds or they have no literals, and the parts are then those of all rows."""
        if window is None:
            return None
        d, asked = self.dialect, []
        for bound, sign in ((window.lower, ">"), (window.upper, "<=")):
            if bound is not None:
                said = d.literal(bound)
                asked.append(said and f"{d.quote(window.column)} {sign} {said}")
        if window.position is not None:
            asked.append(d.after([window.column, *window.ties], window.position))
        return " AND ".join(asked) if asked and None not in asked else None

    def _connect(self):
        manager = self.spark._jvm.java.sql.DriverManager
        manager.setLoginTimeout(LOGIN_SECONDS)
        return manager.getConnection(self.url, self.options.get("user"), self.options.get("password"))

    def execute(self, *statements: str) -> None:
        """All or none of the statements, in one transaction."""
        with closing(self._connect()) as c:
            c.setAutoCommit(False)
            try:
                with closing(c.createStatement()) as s:
                    for sql in statements:
                        s.executeUpdate(sql)
                c.commit()
            except Exception:
                c.rollback()
                raise

    def reachable(self) -> str | None:
        """None if the database answers, else why not."""
        try:
            with closing(self._connect()) as c:
                return None if c.isValid(ANSWER_SECONDS) else f"no answer in {ANSWER_SECONDS} s"
        except Exception as e:
            return str(getattr(e, "java_exception", e))[:500]

    def tables(self) -> list[str]:
        """Tables and views, sorted."""
        with closing(self._connect()) as c, closing(c.getMetaData().getTables(c.getCatalog(), c.getSchema(), "%", None)) as rows:
            found = set()
            while rows.next():
                if rows.getString("TABLE_TYPE") in ("TABLE", "VIEW", "BASE TABLE"):
                    found.add(rows.getString("TABLE_NAME"))
        return sorted(found)

    def exists(self, table: str) -> bool:
        return table.rsplit(".", 1)[-1].lower() in {t.lower() for t in self.tables()}

    def keys(self, table: str) -> tuple[list[str], list[list[str]], list[str]]:
        """Primary key, unique keys and leading index columns. A plain index is never taken for a key."""
        with closing(self._connect()) as c:
            meta, name = c.getMetaData(), table.rsplit(".", 1)[-1]
            primary, indexes, lead = {}, {}, []
            with closing(meta.getPrimaryKeys(c.getCatalog(), c.getSchema(), name)) as rows:
                while rows.next():
                    primary[rows.getInt("KEY_SEQ")] = rows.getString("COLUMN_NAME")
            with closing(meta.getIndexInfo(c.getCatalog(), c.getSchema(), name, False, True)) as rows:
                while rows.next():
                    column = rows.getString("COLUMN_NAME")
                    if column is None:
                        continue
                    place = rows.getInt("ORDINAL_POSITION")
                    lead += [column] if place == 1 and column not in lead else []
                    if not rows.getBoolean("NON_UNIQUE"):
                        indexes.setdefault(rows.getString("INDEX_NAME"), {})[place] = column
        key = [primary[k] for k in sorted(primary)]
        return key, [u for u in ([x[k] for k in sorted(x)] for x in indexes.values()) if u != key], lead

    def types(self, table: str) -> dict[str, str]:
        """Names of the columns' types, in upper case."""
        with closing(self._connect()) as c, closing(c.getMetaData().getColumns(c.getCatalog(), c.getSchema(), table.rsplit(".", 1)[-1], None)) as rows:
            out = {}
            while rows.next():
                out[rows.getString("COLUMN_NAME")] = rows.getString("TYPE_NAME").upper()
        return out

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        if self.by_files:  # the driver makes the table, and the rows are loaded by the caller
            rows = self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), rows.schema)
        rows.write.format("jdbc").options(url=self.url, dbtable=self.dialect.quote(table), batchsize=self.batch_size, numPartitions=self.connections, **self.options).mode(mode).save()

    def append(self, table: str, rows: DataFrame, most_rejected: int = 0) -> list[Rejected]:
        """Plain insert, all rows or, but for those that the database refuses, none."""
        with self._staged(table, rows) as staging:
            return self._apply(table, staging, rows.columns, [], lambda where: self.dialect.insert_from(table, staging, rows.columns, where), most_rejected)

    @contextmanager
    def _staged(self, table: str, rows: DataFrame) -> Iterator[str]:
        """A table of its own with the rows, numbered; gone at the end.

        Spark writes texts without a bound, so values that the target refuses get there too, and nulls. Where such texts
        do not compare with the target's, the database copies the rows to a table in which they do.
        """
        tag, kinds, d = uuid.uuid4().hex[:12].upper(), self.types(table), self.dialect
        written, typed = f"DS_STAGE_{tag}", f"DS_TYPED_{tag}"
        texts = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string" and kinds.get(f.name) not in LONG_TEXTS] if d.wide_text else []
        try:
            numbered = rows.withColumn(NUMBER, F.monotonically_increasing_id())
            self._write(written, numbered, "error")
            if texts:
                self.execute(*d.retyped(typed, written, [*rows.columns, NUMBER], texts))
                self.execute(d.drop(written))
            if self.by_files:
                self._loaded(typed if texts else written, numbered)
            yield typed if texts else written
        finally:
            there = set(self.tables())
            self.execute(*[d.drop(t) for t in (written, typed) if t in there])

    def limits(self, table: str) -> dict[str, tuple[int, bool]]:
        """By column the most characters it takes, 0 if it holds no text, and whether it takes nulls."""
        with closing(self._connect()) as c, closing(c.getMetaData().getColumns(c.getCatalog(), c.getSchema(), table.rsplit(".", 1)[-1], None)) as rows:
            out = {}
            while rows.next():
                text = rows.getString("TYPE_NAME").upper() in ("CHAR", "VARCHAR")
                out[rows.getString("COLUMN_NAME")] = rows.getInt("COLUMN_SIZE") if text else 0, rows.getInt("NULLABLE") != 0
        return out

    def _unfit(self, table: str, staging: str, columns: list[str], most: int) -> list[Rejected]:
        """Take out of a staging table the rows that the limits of single columns refuse, all at once."""
        d, limits, out = self.dialect, self.limits(table) if self.dialect.strict else {}, []
        for c in [c for c in columns if c in limits]:
            longest, null = limits[c]
            broken = [(f"LENGTH(RTRIM(s.{d.quote(c)})) > {longest}", f"more than {longest} characters in {c}")] if longest else []
            for where, said in broken + ([] if null else [(f"s.{d.quote(c)} IS NULL", f"no value in {c}")]):
                out += self._taken(staging, columns, f"{d.quote(staging)} s WHERE {where}", said, most - len(out), most)
        return out

    def _taken(self, staging: str, columns: list[str], place: str, said: str, left: int, most: int) -> list[Rejected]:
        """Take staged rows s of a place out of their table; with more than are left of the most nothing is written."""
        d = self.dialect
        found = self._rows(f"SELECT {d.names([*columns, NUMBER], 's.')} FROM {place} {d.limit(left + 1)}", [*columns, NUMBER])
        numbers = [r.pop(NUMBER) for r in found]
        out = [Rejected(r, said) for r in found]
        if len(out) > left:
            raise TooManyRejected(out, most)
        gone = [numbers[i : i + 500] for i in range(0, len(numbers), 500)]
        self.execute(*[f"DELETE FROM {d.quote(staging)} WHERE {d.quote(NUMBER)} IN ({', '.join(some)})" for some in gone])
        return out

    def _clashing(self, table: str, staging: str, columns: list[str], keys: list[str], most: int, before: int) -> list[Rejected]:
        """Take out of a staging table the rows that another unique key of the table refuses whatever else is written."""
        out, d = [], self.dialect
        primary, others, _ = self.keys(table)
        for unique in [u for u in (primary, *others) if u and d.refuses_duplicates and set(u) != set(keys) and set(u) <= set(columns)]:
            clashing, said = d.clashing(table, staging, keys, unique, NUMBER), f"another row has the same {', '.join(unique)}"
            out += self._taken(staging, columns, clashing, said, most - before - len(out), most)
        return out

    def _rows(self, sql: str, columns: Sequence[str], connection=None) -> list[dict[str, str | None]]:
        with closing(connection.createStatement() if connection else (own := self._connect()).createStatement()) as s, closing(s.executeQuery(sql)) as found:
            out = []
            while found.next():
                out.append({c: found.getString(i + 1) for i, c in enumerate(columns)})
        if not connection:
            own.close()
        return out

    def _apply(self, table: str, staging: str, columns: list[str], keys: list[str], statement: Callable[..., str], most: int, first: Sequence[str] = ()) -> list[Rejected]:
        """Run `first` and the statement over all staged rows in one transaction; the rows that the database refuses.

        They are searched only if the statement fails because of rows: first by the table's other unique keys, all at
        once, then by halving what fails. With more of them than `most` nothing is written.
        """
        try:
            self.execute(*first, statement(""))
            return []
        except Exception as e:
            if refused(e) is None:
                raise
        d = self.dialect
        number = d.quote(NUMBER)
        self.execute(*[f"CREATE INDEX {d.quote(f'DS_{i}' + staging[-12:])} ON {d.quote(staging)} ({d.names(c)})" for i, c in (("I", [NUMBER]), ("K", keys)) if c and (i == "I" or d.wide_text)])
        out = self._unfit(table, staging, columns, most)
        out += self._clashing(table, staging, columns, keys, most, len(out)) if keys else []
        piece = f"DS_PIECE_{staging[-12:]}" if keys and d.merges_tables else ""  # so that a span costs no more than its rows
        if piece:
            self.execute(f"CREATE TABLE {d.quote(piece)} AS SELECT * FROM {d.quote(staging)}{d.no_rows}")
        with closing(self._connect()) as c:
            c.setAutoCommit(False)

            def run(sql: str) -> None:
                with closing(c.createStatement()) as s:
                    s.executeUpdate(sql)

            try:
                for sql in first:
                    run(sql)
                spans = [(0, (1 << 63) - 1)]
                while spans:
                    lo, hi = spans.pop()
                    where, mark = f"{number} BETWEEN {lo} AND {hi}", c.setSavepoint()
                    try:
                        if piece:
                            run(d.delete_all(piece))
                            run(f"INSERT INTO {d.quote(piece)} SELECT * FROM {d.quote(staging)} WHERE {where}")
                        run(statement("", piece) if piece else statement(where))
                    except Exception as e:
                        why = refused(e)
                        c.rollback(mark)
                        if why is None:
                            raise
                        n = int(self._rows(f"SELECT COUNT(*) FROM {d.quote(staging)} WHERE {where}", ["n"], c)[0]["n"])
                        if n > 1:
                            cut = int(self._rows(f"SELECT {number} FROM {d.quote(staging)} WHERE {where} ORDER BY {number} {d.nth(n // 2 - 1)}", ["n"], c)[0]["n"])
                            spans += [(cut + 1, hi), (lo, cut)]
                            continue
                        out += [Rejected(r, why) for r in self._rows(f"SELECT {d.names(columns)} FROM {d.quote(staging)} WHERE {where}", columns, c)]
                        if len(out) > most:
                            raise TooManyRejected(out, most) from e
                    else:
                        c.releaseSavepoint(mark)
                c.commit()
            except Exception:
                c.rollback()
                raise
            finally:
                if piece:
                    self.execute(d.drop(piece))
        return out

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: list[str], most_rejected: int = 0, unique: bool = False) -> list[Rejected]:
        """Rows go in parallel to a staging table, then one statement merges it; a failed run leaves the target alone.

        Returns the rows that the database refuses, of which there may be most_rejected; of a key whose last row it
        refuses no earlier row is tried. With `unique` no key comes twice, which spares the search for the last.
        """
        there = self.types(table)
        columns = [c for c in rows.columns if c not in order or c in there]
        kept = rows if unique else last_wins(rows, keys, order)
        with self._staged(table, kept.select(*[F.col(f"`{c}`") for c in columns])) as staging:
            return self._apply(table, staging, columns, keys, lambda where, of=staging: self.dialect.upsert_from(table, of, columns, keys, where), most_rejected)

    def replace(self, table: str, rows: DataFrame, strategy: Strategy = Strategy.DELETE, most_rejected: int = 0, **_) -> list[Rejected]:
        """All rows anew. They go in parallel to a staging table first, so a run that fails leaves the target alone.

        DELETE changes the rows over in one transaction. TRUNCATE empties the table by its statement, which some
        databases commit by themselves. SWAP fills a table made like the target and gives it the target's name. Returns
        the rows that the database refuses, of which there may be most_rejected.
        """
        d, tag = self.dialect, uuid.uuid4().hex[:12].upper()
        like, backup = f"DS_LIKE_{tag}", f"DS_OLD_{tag}"
        with self._staged(table, rows) as staging:
            insert = lambda into: lambda where: d.insert_from(into, staging, rows.columns, where)
            if strategy != Strategy.SWAP:
                clear = d.truncate(table) if strategy == Strategy.TRUNCATE else d.delete_all(table)
                return self._apply(table, staging, rows.columns, [], insert(table), most_rejected, [clear])
            self.execute(*d.create_like(like, table))
            try:
                rejected = self._apply(like, staging, rows.columns, [], insert(like), most_rejected)
                self.execute(*d.swap(table, like, backup))
                self.execute(d.drop(backup))
                return rejected
            finally:
                if self.exists(like):
                    self.execute(d.drop(like))
