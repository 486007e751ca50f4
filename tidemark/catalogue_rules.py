"""More registered queries: single rules of conversion, upsert, run, state, sources and preflight, with their SQL."""

from __future__ import annotations

import atexit
import datetime as dt
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reports
from .catalogue import NOW, _column, _done, _runs, query, rule, t
from .functions.convert import as_text, convert
from .functions.types import compatibility, map_type_name
from .model import ErrorPolicy, FieldMapping, IncrPolicy, Strategy, SyncTask, TableSpec, check_task, scrub
from .operators import cursor, merge, reconcile
from .plans.engine import run as run_task
from .plans.engine import staging_dir
from .plans.guard import check_grants, check_metadata_target, is_identifier
from .plans.resolve import is_incremental, resolve
from .runtime import AsyncListener, Cancellation, EventBus, backoff_ms, retryable_state
from .sources.base import database_kind, describe, preview, spec_from, sql_columns
from .sources.dialect import dialect_of, jdbc_url
from .sources.jdbc import JdbcTables
from .sources.memory import MemoryTables
from .sources.parquet import Conflict, ParquetTables
from .state import StateStore, TaskRunning
from .streaming.source import stream_by_cursor
from .streaming.upsert import stream_upsert


def _folder(spark, what: str) -> str:
    return f"{staging_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _sql(rows: list[tuple], columns: str) -> str:
    """A VALUES list as a query: what a rule over fixed cases must give."""

    def said(x):
        if x is None:
            return "NULL"
        return str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::bigint"

    return f"select * from (values {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({columns})"


# --- conversions -----------------------------------------------------------------------------------------------------


def _converted(df: DataFrame, keys: list[str], x, source, target, shown=lambda c: c) -> DataFrame:
    new, bad = convert(F.col("x"), source, target)
    df = df.withColumn("x", x).select(*keys, new.alias("y"), bad.alias("bad"))
    return df.select(*keys, shown(F.col("y")).alias("y"), "bad")


@query(
    "select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderkey::bigint * 1000000007 + case when o_orderkey % 2 = 0 then 1 else 0 end end::bigint as y, o_orderkey % 10 = 0 as bad from orders"
)
def convert_bigint(spark, d):
    """Text with halves, and text that is no number."""
    x = (F.col("o_orderkey").cast("long") * 1000000007).cast("string")
    x = F.when(F.col("o_orderkey") % 10 == 0, "none").when(F.col("o_orderkey") % 2 == 0, F.concat(x, F.lit(".5000"))).otherwise(F.concat(x, F.lit(".49999999999999999999")))
    return _converted(t(spark, d, "orders"), ["o_orderkey"], x, _column("x", "VARCHAR"), _column("y", "BIGINT"))


@query("select o_orderkey, o_orderkey::int as y, false as bad from orders")
def convert_double_half_up(spark, d):
    """The last double below the half is rounded down, whatever the size of the number: once, not twice."""
    below = (F.col("o_orderkey") + F.lit(0.5)) * F.lit(1 - 2.0**-53)  # a constant less than the half is lost in large numbers
    return _converted(t(spark, d, "orders"), ["o_orderkey"], below, _column("x", "DOUBLE"), _column("y", "INT"))


@query("select l_orderkey, l_linenumber, l_quantity::double::varchar as y, false as bad from lineitem")
def convert_double_text(spark, d):
    df = t(spark, d, "lineitem")
    return _converted(df, ["l_orderkey", "l_linenumber"], F.col("l_quantity").cast("double"), _column("x", "DOUBLE"), _column("y", "VARCHAR", True, 30))


@query("select event_id, case when event_id % 10 = 0 then null when event_id % 3 = 0 then strftime(ts, '%H:%M:%S') || '.000000' else strftime(ts, '%H:%M:%S') end as y, event_id % 10 = 0 as bad from events")
def convert_time(spark, d):
    """Times as they stand, the time part of points in time, and hours that no day has."""
    clock = F.date_format("ts", "HH:mm:ss")
    x = F.when(F.col("event_id") % 10 == 0, "25:61").when(F.col("event_id") % 3 == 0, F.concat(F.lit("2024-01-02 "), clock)).otherwise(clock)
    return _converted(t(spark, d, "events"), ["event_id"], x, _column("x", "VARCHAR"), _column("y", "TIME"))


@query("select event_id, case when event_id % 7 = 0 then null else date_trunc('second', ts) end as y, event_id % 7 = 0 as bad from events")
def convert_timestamp(spark, d):
    """ISO text with a blank or a T and with a zone, whose local part stays; other text is bad."""
    said = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    x = F.when(F.col("event_id") % 7 == 0, "2024-1-1").when(F.col("event_id") % 3 == 0, F.concat(F.replace(said, F.lit(" "), F.lit("T")), F.lit("+08:00"))).otherwise(said)
    return _converted(t(spark, d, "events"), ["event_id"], x, _column("x", "VARCHAR"), _column("y", "DATETIME"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as y, false as bad from events")
def convert_timestamptz(spark, d):
    """A local time gets the session's zone; shown in that zone it is the same."""
    return _converted(t(spark, d, "events"), ["event_id"], F.col("ts").cast("timestamp_ntz"), _column("x", "DATETIME"), _column("y", "TIMESTAMPTZ"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


@query("select o_orderkey, cast(make_date(1990 + (o_orderkey % 30)::int, 1, 1) as timestamp) as y, false as bad from orders")
def convert_year_timestamp(spark, d):
    return _converted(t(spark, d, "orders"), ["o_orderkey"], (F.lit(1990) + F.col("o_orderkey") % 30).cast("int"), _column("x", "YEAR"), _column("y", "DATETIME"))


@query("select c_custkey, case when length(c_custkey::varchar) > 2 then null else hex(c_custkey::varchar) end as y, length(c_custkey::varchar) > 2 as bad from customer")
def convert_binary(spark, d):
    """Numbers go as the bytes of their text; more bytes than the column holds are a bad row."""
    new, bad = convert(F.col("c_custkey").cast("long"), _column("c_custkey", "BIGINT"), _column("y", "VARBINARY", True, 2))
    return t(spark, d, "customer").select("c_custkey", F.when(~bad, F.hex(new)).alias("y"), bad.alias("bad"))


@query("select c_custkey, case when c_custkey % 2 = 0 then '01' else '00' end as y, false as bad from customer")
def convert_bool_blob(spark, d):
    return _converted(t(spark, d, "customer"), ["c_custkey"], F.col("c_custkey") % 2 == 0, _column("x", "BOOLEAN"), _column("y", "BLOB"), F.hex)


@query("select c_custkey, case c_custkey % 4 when 0 then false when 1 then true when 2 then false else null end as y, c_custkey % 4 = 3 as bad from customer")
def convert_bool_binary(spark, d):
    """One byte is true unless zero, none is false, two are bad."""
    k = F.col("c_custkey") % 4
    x = F.when(k == 0, F.lit(b"\x00")).when(k == 1, F.lit(b"\x01")).when(k == 2, F.lit(b"")).otherwise(F.lit(b"ab"))
    return _converted(t(spark, d, "customer"), ["c_custkey"], x, _column("x", "VARBINARY", True, 4), _column("y", "BOOLEAN"))


@query("select c_custkey, c_custkey % 3 <> 0 as y, false as bad from customer")
def convert_bool_year(spark, d):
    return _converted(t(spark, d, "customer"), ["c_custkey"], F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(2024), _column("x", "YEAR"), _column("y", "BOOLEAN"))


@query("select c_custkey, case when c_custkey % 2 = 0 then null else c_custkey::int end as y, c_custkey % 2 = 0 as bad from customer")
def convert_empty_number(spark, d):
    """Empty text is no number, and no null either."""
    x = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_custkey").cast("string"))
    return _converted(t(spark, d, "customer"), ["c_custkey"], x, _column("x", "VARCHAR"), _column("y", "INT"))


@query("select o_orderkey, cast(o_orderkey as decimal(20,6)) as y, false as bad from orders")
def convert_decimal_plain(spark, d):
    """A decimal without precision stays as it is."""
    return _converted(t(spark, d, "orders"), ["o_orderkey"], F.col("o_orderkey").cast("decimal(20,6)"), _column("x", "DECIMAL", True, 20, 6), _column("y", "DECIMAL"))


@query("select c_custkey, c_custkey::bigint as y, false as bad from customer")
def convert_unknown_type(spark, d):
    """Types nobody knows take the value as it is."""
    return _converted(t(spark, d, "customer"), ["c_custkey"], F.col("c_custkey").cast("long"), _column("x", "BIGINT"), _column("y", "GEOMETRY"))


@query("select c_custkey, case when c_custkey % 5 = 0 then null else c_name end as y, c_custkey % 5 = 0 as bad from customer")
def convert_blob_text(spark, d):
    """Bytes that are UTF-8 become text, others are bad."""
    x = F.when(F.col("c_custkey") % 5 == 0, F.lit(b"\xff\xfe")).otherwise(F.col("c_name").cast("binary"))
    return _converted(t(spark, d, "customer"), ["c_custkey"], x, _column("x", "BLOB"), _column("y", "TEXT"))


@query("select c_custkey, case when c_custkey > 255 then null else c_custkey end::smallint as y, c_custkey > 255 as bad from customer")
def convert_unsigned(spark, d):
    return _converted(t(spark, d, "customer"), ["c_custkey"], F.col("c_custkey").cast("long"), _column("x", "BIGINT"), _column("y", "TINYINT UNSIGNED"), lambda c: c).select("c_custkey", F.when(~F.col("bad"), F.col("y")).alias("y"), "bad")


@query("select c_custkey, c_custkey % 2 = 0 as b, case when c_custkey % 2 = 0 then '1' else '0' end as said from customer")
def convert_bool_to_text(spark, d):
    return t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("b")).select("c_custkey", "b", as_text(F.col("b"), _column("b", "BOOLEAN")).alias("said"))


# --- types and compatibility -----------------------------------------------------------------------------------------

_DM8 = [("TINYINT", "SMALLINT"), ("YEAR", "INT"), ("MEDIUMINT", "INT"), ("int(11) unsigned", "INT"), ("LONGTEXT", "CLOB"), ("JSON", "CLOB"), ("ENUM", "VARCHAR(255)"), ("VARBINARY", "BLOB"), ("DATETIME", "TIMESTAMP"), ("BIT", "INT"), ("GEOMETRY", "GEOMETRY")]


@rule(_sql([(n, n, to) for n, to in _DM8], "sql_type, mysql, dm8"))
def type_names(spark, d):
    return spark.createDataFrame([(n, map_type_name(n), map_type_name(n, "DM8")) for n, _ in _DM8], "sql_type string, mysql string, dm8 string")


_KINDS = {"VARCHAR": "char", "TEXT": "text", "INT": "num", "DOUBLE": "num", "DECIMAL": "num", "DATE": "time", "DATETIME": "time", "TIME": "time", "YEAR": "year", "BLOB": "bin", "VARBINARY": "bin", "BOOLEAN": "bool", "GEOMETRY": "none"}


@rule(
    f"with k(name, kind) as (values {', '.join(f'({n!r}, {k!r})' for n, k in _KINDS.items())}) select s.name as source, t.name as target, case when s.kind = 'none' or t.kind in ('none', 'char', 'text', 'bin') then 'OK' "
    "when t.kind = 'bool' then case when s.kind = 'time' then 'ERROR' else 'OK' end "
    "when t.kind = 'num' then case s.kind when 'char' then 'WARN' when 'text' then 'ERROR' when 'time' then 'ERROR' when 'bin' then 'ERROR' when 'num' then case when s.name = 'DOUBLE' and t.name = 'INT' then 'WARN' else 'OK' end else 'OK' end "
    "when s.kind in ('char', 'text') then 'WARN' when s.kind in ('num', 'bin') then 'ERROR' when s.name = 'DATETIME' and t.name = 'DATE' then 'WARN' else 'OK' end as level from k s cross join k t"
)
def compatibility_matrix(spark, d):
    names = [_column(n, n) for n in _KINDS]
    return spark.createDataFrame([(s.name, x.name, str(compatibility(s, x)[0] or "OK")) for s in names for x in names], "source string, target string, level string")


@rule(_sql([("VARCHAR", 200, 32, "WARN"), ("VARCHAR", 10, 32, "OK"), ("DECIMAL", 38, 12, "WARN"), ("DECIMAL", 10, 12, "OK")], "kind, source, target, level"))
def compatibility_lengths(spark, d):
    cases = [("VARCHAR", 200, 32), ("VARCHAR", 10, 32), ("DECIMAL", 38, 12), ("DECIMAL", 10, 12)]
    return spark.createDataFrame([(k, a, b, str(compatibility(_column("x", k, True, a), _column("y", k, True, b))[0] or "OK")) for k, a, b in cases], "kind string, source long, target long, level string")


# --- upserts ---------------------------------------------------------------------------------------------------------


@query(
    "with tgt as (select case when o_orderkey % 4 = 0 then null else o_orderkey end as k, 'old' as v from orders where o_orderkey % 2 = 0), src as (select case when o_orderkey % 4 = 0 then null else o_orderkey end as k, 'new' as v from orders where o_orderkey % 3 = 0) "
    "select coalesce(s.k, t.k) as k, coalesce(s.v, t.v) as v from tgt t full outer join src s on t.k = s.k"
)
def upsert_null_keys(spark, d):
    """Null keys match nothing: those of both sides stay."""
    o = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("k"), (F.col("o_orderkey") % 2 == 0).alias("even"), (F.col("o_orderkey") % 3 == 0).alias("third"))
    return merge.merge(o.where("even").select("k", F.lit("old").alias("v")), o.where("third").select("k", F.lit("new").alias("v")), ["k"])


@query("select n_nationkey, upper(n_name) as n_name, n_regionkey + 10 as n_regionkey from nation where n_nationkey % 2 = 0 union all select n_nationkey, n_name, n_regionkey from nation where n_nationkey % 2 = 1")
def upsert_chosen_keys(spark, d):
    """The chosen key is the name under a collation that does not look at case, not the number."""
    n = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = n.where("n_nationkey % 2 = 0").select(F.upper("n_name").alias("n_name"), (F.col("n_regionkey") + 10).alias("n_regionkey"))
    return merge.merge(n, rows, ["n_name"], collation="UTF8_LCASE")


@query("select c_custkey as k, case when c_custkey % 2 = 0 then 'new' else c_name end as s_k, c_name as hit from customer")
def upsert_name_clash(spark, d):
    """Columns may be called anything."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("s_k"), F.col("c_name").alias("hit"))
    return merge.merge(c, c.where("k % 2 = 0").select("k", F.lit("new").alias("s_k")), ["k"])


@query("select user_id as k, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id")
def upsert_last_in_run(spark, d):
    """Several rows of a run with one target key: the last by the order keys is applied."""
    src = t(spark, d, "events")
    target = MemoryTables(out=spark.createDataFrame([], "k long, event_id long"))
    task = SyncTask(20, "out", "events", mode="INCR", incr_column="ts", mappings=(FieldMapping("k", "user_id", primary_key=True), FieldMapping("event_id", "event_id")))
    _done(run_task(spark, task, MemoryTables(events=src), target, now=dt.datetime(2100, 1, 1), source_spec=spec_from(src, ["event_id"]), target_spec=spec_from(target.read("out"))))
    return target.read("out")


# --- runs ------------------------------------------------------------------------------------------------------------


def _result(spark, results) -> DataFrame:
    rows = [(i, str(r.status), r.read_rows, r.written_rows, r.skipped_rows, r.end_cursor) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "run long, status string, read_rows long, written_rows long, skipped_rows long, end_cursor string")


def _orders_task(**more) -> SyncTask:
    return SyncTask(**({"id": 21, "target_table": "out", "source_table": "orders", "mappings": (FieldMapping("k", "o_orderkey", primary_key=True), FieldMapping("price", "o_totalprice"))} | more))


def _orders_target(spark, *rows) -> MemoryTables:
    return MemoryTables(out=spark.createDataFrame(list(rows), "k long, price double"))


@query(
    "with m as (select max(o_orderkey) as m, count(*) as n from orders) select * from (values (0::bigint), (1::bigint), (2::bigint)) v(run), lateral (select 'COMPLETED' as status, case run when 2 then 0 else n end as read_rows, case run when 2 then 0 else n end as written_rows, 0::bigint as skipped_rows, case run when 2 then null else m::varchar end as end_cursor from m)"
)
def run_full_incr(spark, d):
    """A FULL run seeds the cursor, FULL_INCR without it reads all, and with it only what is new."""
    src = t(spark, d, "orders")
    source, target, spec = MemoryTables(orders=src), _orders_target(spark), spec_from(src, ["o_orderkey"])
    go = lambda mode, cursor: run_task(spark, _orders_task(mode=mode, incr_column="o_orderkey", cursor=cursor), source, target, source_spec=spec)
    first = go("FULL", None)
    return _result(spark, [first, go("FULL_INCR", None), go("FULL_INCR", first.end_cursor)])


@query("select 0::bigint as run, 'COMPLETED' as status, count(*) as read_rows, count(*) filter (where o_orderkey % 6 <> 0) as written_rows, count(*) filter (where o_orderkey % 6 = 0) as skipped_rows, max(o_orderkey) filter (where o_orderkey % 6 <> 0)::varchar as end_cursor from orders")
def run_null_cursor(spark, d):
    """Rows without a value of the incremental column are bad rows."""
    src = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey")).alias("at"))
    task = _orders_task(mode="FULL", incr_column="at", errors=ErrorPolicy(skip_bad_rows=True, max_skip_rows=10**9))
    r = run_task(spark, task, MemoryTables(orders=src), _orders_target(spark), source_spec=spec_from(src, ["o_orderkey"]))
    r.end_cursor = r.end_cursor and r.end_cursor.split("|")[0]
    return _result(spark, [r])


@query("select o_orderkey as k, o_totalprice as price from orders union all select -1, 1.0")
def run_without_column(spark, d):
    """INCR without an incremental column reads everything and clears nothing."""
    src, target = t(spark, d, "orders"), _orders_target(spark, (-1, 1.0))
    _done(run_task(spark, _orders_task(mode="INCR"), MemoryTables(orders=src), target, source_spec=spec_from(src, ["o_orderkey"])))
    return target.read("out")


@query("select 0::bigint as run, 'COMPLETED' as status, count(*) as read_rows, 0::bigint as written_rows, 0::bigint as skipped_rows, null::varchar as end_cursor, 1::bigint as target_rows from orders")
def run_dry(spark, d):
    """A dry run reads and converts, and leaves the target alone."""
    src, target = t(spark, d, "orders"), _orders_target(spark, (-1, 1.0))
    r = run_task(spark, _orders_task(mode="FULL", incr_column="o_orderkey", dry_run=True), MemoryTables(orders=src), target, source_spec=spec_from(src, ["o_orderkey"]))
    return _result(spark, [r]).crossJoin(target.read("out").agg(F.count("*").alias("target_rows")))


@query("select o_orderkey as k, o_totalprice as price from orders union all select o_orderkey, o_totalprice from orders")
def run_plain_insert(spark, d):
    """A FULL run without any key inserts, and repeats stay."""
    src = t(spark, d, "orders")
    target, both = _orders_target(spark, (-1, 1.0)), src.union(src)
    task = SyncTask(22, "out", "orders", mode="FULL", order_column="o_orderkey", mappings=(FieldMapping("k", "o_orderkey"), FieldMapping("price", "o_totalprice")))
    _done(run_task(spark, task, MemoryTables(orders=both), target, source_spec=spec_from(both, ["o_orderkey"])))
    return target.read("out")


def _wide_texts(spark, d, **policy):
    src = t(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.repeat("n_name", 9)).when(F.col("n_nationkey") % 7 != 1, F.col("n_name")).alias("name"))
    spec = TableSpec((_column("n_nationkey", "BIGINT", False), _column("name", "VARCHAR", False, 20)), ("n_nationkey",))
    target = MemoryTables(out=spark.createDataFrame([], "n_nationkey long, name string"))
    task = SyncTask(23, "out", "nation", mode="FULL", errors=ErrorPolicy(**policy))
    return run_task(spark, task, MemoryTables(nation=src), target, source_spec=spec_from(src, ["n_nationkey"]), target_spec=spec)


_BAD = "with b as (select count(*) as n, count(*) filter (where n_nationkey % 5 = 0 or n_nationkey % 7 = 1) as bad from nation) "


@query(_BAD + "select run, case when run in (1, 3) then 'COMPLETED' else 'FAILED' end as status, n as read_rows, case when run in (1, 3) then n - bad else 0 end as written_rows, bad as skipped_rows, null::varchar as end_cursor from b, (values (0::bigint), (1::bigint), (2::bigint), (3::bigint)) v(run)")
def run_bad_row_limits(spark, d):
    """No bad row unless they may be skipped, and then no more than the limit."""
    n = t(spark, d, "nation").where("n_nationkey % 5 = 0 or n_nationkey % 7 = 1").count()
    policies = [{}, {"skip_bad_rows": True}, {"skip_bad_rows": True, "max_skip_rows": n - 1}, {"skip_bad_rows": True, "max_skip_rows": n}]
    return _result(spark, [_wide_texts(spark, d, **p) for p in policies])


@query(
    "select case when n_nationkey % 5 = 0 then 'MAP' else 'WRITE' end as phase, 'n_nationkey=' || n_nationkey as row_key, '{\"n_nationkey\":' || n_nationkey || ',\"name\":' || case when n_nationkey % 5 = 0 then '\"' || repeat(n_name, 9) || '\"' else 'null' end || '}' as row_data, false as retryable from nation where n_nationkey % 5 = 0 or n_nationkey % 7 = 1"
)
def run_error_rows(spark, d):
    """What a run says of its bad rows: phase, key and the source row as JSON with its nulls."""
    r = _wide_texts(spark, d, skip_bad_rows=True)
    return spark.createDataFrame([(e["phase"], e["row_key"], e["row_data"], e["retryable"]) for e in r.errors], "phase string, row_key string, row_data string, retryable boolean")


@query("select 3::bigint as errors")
def run_error_cap(spark, d):
    return spark.createDataFrame([(len(_wide_texts(spark, d, skip_bad_rows=True, max_errors_recorded=3).errors),)], "errors long")


@query("select 'FAILED' as status, 0::bigint as written_rows, 1::bigint as target_rows")
def run_read_failure(spark, d):
    """A source that cannot be read fails the run and leaves the target alone."""

    class Broken(MemoryTables):
        def read(self, table):
            raise OSError("the source is gone")

    src, target = t(spark, d, "orders"), _orders_target(spark, (-1, 1.0))
    r = run_task(spark, _orders_task(mode="FULL"), Broken(), target, source_spec=spec_from(src, ["o_orderkey"]))
    return spark.createDataFrame([(str(r.status), r.written_rows, target.read("out").count())], "status string, written_rows long, target_rows long")


@query("select 'CANCELLED' as status, 1::bigint as target_rows")
def run_cancelled(spark, d):
    src, target, stop = t(spark, d, "orders"), _orders_target(spark, (-1, 1.0)), Cancellation(spark)
    stop.cancel(21)
    r = run_task(spark, _orders_task(mode="FULL"), MemoryTables(orders=src), target, source_spec=spec_from(src, ["o_orderkey"]), cancellation=stop)
    return spark.createDataFrame([(str(r.status), target.read("out").count())], "status string, target_rows long")


@query("select * from (select 'MAP' as phase, count(*) as read_rows, 0::bigint as written_rows, 0::bigint as skipped_rows from orders union all select 'WRITE', count(*), count(*), 0 from orders)")
def run_progress(spark, d):
    """Totals so far, handed to a listener on a thread of its own."""
    src, seen = t(spark, d, "orders"), []
    listener = AsyncListener(seen.append)
    _done(run_task(spark, _orders_task(mode="FULL"), MemoryTables(orders=src), _orders_target(spark), source_spec=spec_from(src, ["o_orderkey"]), listener=listener))
    listener.close()
    return spark.createDataFrame([(p.phase, p.read_rows, p.written_rows, p.skipped_rows) for p in seen], "phase string, read_rows long, written_rows long, skipped_rows long")


# --- versioned Parquet targets, state, streams -----------------------------------------------------------------------


@query("select o_orderkey as k, o_totalprice as price, s as strategy from orders, (values ('TRUNCATE'), ('DELETE'), ('SWAP')) v(s)")
def parquet_refresh(spark, d):
    """Each refresh strategy of a Parquet target puts the table anew in one step."""
    src, out = t(spark, d, "orders"), None
    for strategy in Strategy:
        target = ParquetTables(spark, _folder(spark, "tables"))
        target.create("out", spark.createDataFrame([(-1, 1.0)], "k long, price double"))
        _done(run_task(spark, _orders_task(mode="FULL", strategy=strategy), MemoryTables(orders=src), target, source_spec=spec_from(src, ["o_orderkey"])))
        got = target.read("out").withColumn("strategy", F.lit(str(strategy)))
        out = got if out is None else out.union(got)
    return out


_PARQUET = "with w as (select event_id, ts, value from events where ts <= timestamp '2024-01-25 12:00:00' and ts > timestamp '2024-01-20 00:00:00') "


@query(_PARQUET + "select event_id, ts, case when w.event_id is not null then w.value else e.value - 1 end as value from events e left join w using (event_id, ts)")
def parquet_incremental(spark, d):
    """An INCR run into a Parquet target that lies by key: only files with a key of the window are rewritten."""
    src = t(spark, d, "events")
    target = ParquetTables(spark, _folder(spark, "tables"))
    target.create("out", src.select("event_id", "ts", (F.col("value") - 1).alias("value")), ["event_id"])
    task = SyncTask(24, "out", "events", mode="INCR", incr_column="ts", cursor="2024-01-20 00:00:00", mappings=tuple(FieldMapping(c, c) for c in ("event_id", "ts", "value")))
    _done(run_task(spark, task, MemoryTables(events=src), target, now=NOW, source_spec=spec_from(src, ["event_id"], indexed=["ts"]), target_spec=spec_from(target.read("out"), ["event_id"])))
    return target.read("out")


@query("select 'a' as name, true as found union all select 'b', false")
def parquet_tables(spark, d):
    store = ParquetTables(spark, _folder(spark, "tables"))
    store.create("a", t(spark, d, "nation"))
    found = store.tables()
    return spark.createDataFrame([(n, n in found and store.exists(n)) for n in ("a", "b")], "name string, found boolean")


@query("select * from (values (1::bigint, 25::bigint), (2::bigint, 26::bigint)) v(version, n)")
def parquet_versions(spark, d):
    """An older version can still be read; a writer that comes second fails."""
    store = ParquetTables(spark, _folder(spark, "tables"))
    n = t(spark, d, "nation").select("n_nationkey")
    store.create("a", n)
    store.append("a", n.limit(1))
    try:
        store.replace("a", n, base=1)
    except Conflict:
        return spark.createDataFrame([(v, store.read("a", v).count()) for v in (1, 2)], "version long, n long")
    raise AssertionError("the second writer should have failed")


def _state(spark):
    return StateStore(spark, _folder(spark, "state"))


@query(
    "with m as (select count(*) as n, max(o_orderkey) as m from orders) select 1::bigint as id, 'COMPLETED' as status, n as read_rows, n as write_rows, null::varchar as start_cursor, m::varchar as end_cursor from m "
    "union all select 2, 'COMPLETED', 0, 0, m::varchar, null from m union all select 3, 'FAILED', 0, 0, m::varchar, null from m"
)
def run_history(spark, d):
    """Records of runs: the next run starts from the last success, and a failed one moves no cursor."""
    src, state, target = t(spark, d, "orders"), _state(spark), _orders_target(spark)
    spec = spec_from(src, ["o_orderkey"])
    for column in ("o_orderkey", "o_orderkey", "nowhere"):
        state.run(_orders_task(mode="INCR", incr_column=column), MemoryTables(orders=src), target, NOW, source_spec=spec)
    return state.records().select("id", "status", "read_rows", "write_rows", "start_cursor", "end_cursor")


@query("select (row_number() over (order by n_nationkey))::bigint as id, 1::bigint as record_id, case when n_nationkey % 5 = 0 then 'MAP' else 'WRITE' end as phase, 'n_nationkey=' || n_nationkey as row_key from nation where n_nationkey % 5 = 0 or n_nationkey % 7 = 1")
def run_error_records(spark, d):
    """Bad rows of a run as records of the state store."""
    state, result = _state(spark), _wide_texts(spark, d, skip_bad_rows=True)
    state.finish(state.begin(23, NOW), result, NOW)
    return state.errors().select("id", "record_id", "phase", "row_key")


@rule("select * from (values (1::bigint, 'FAILED'), (2::bigint, 'CANCELLED'), (3::bigint, 'RUNNING')) v(id, status)")
def run_recovery(spark, d):
    """Left-over runs fail at start-up, a shutdown cancels, and a task runs once at a time."""
    state = _state(spark)
    state.begin(1, NOW)
    state.recover(NOW)
    state.begin(1, NOW)
    state.shutdown(Cancellation(spark), NOW, wait_seconds=0)
    state.begin(1, NOW)
    try:
        state.begin(1, NOW)
    except TaskRunning:
        return state.records().select("id", "status")
    raise AssertionError("a second run of the task should not have begun")


@query("select user_id as k, max(event_id) as event_id from events group by user_id")
def stream_to_table(spark, d):
    """A stream of files upserted into a versioned table, the last event of each user."""
    folder = _folder(spark, "stream")
    t(spark, d, "events").select(F.col("user_id").alias("k"), "event_id").write.parquet(f"{folder}/in")
    store = ParquetTables(spark, f"{folder}/tables")
    rows = spark.read.parquet(f"{folder}/in")
    store.create("out", rows.limit(0))
    stream_upsert(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), store, "out", ["k"], ["event_id"], f"{folder}/check").awaitTermination()
    return store.read("out")


@query("select ts::date as day, event_id, user_id, count(*) as times from events group by all")
def stream_cursor_resume(spark, d):
    """A table as a stream by (day, event): what is added between two runs from one checkpoint, in the middle of the ties
    of a day, comes once each."""
    folder = _folder(spark, "stream")
    events = t(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id", "user_id")
    middle = events.agg(F.percentile_approx(F.unix_date("day"), 0.5).alias("at"), (F.max("event_id") / 2).alias("id")).first()
    day = F.date_from_unix_date(F.lit(middle["at"]))
    first = (F.col("day") < day) | (F.col("day") == day) & (F.col("event_id") <= middle["id"])
    for part in (first, ~first):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = stream_by_cursor(spark, f"{folder}/in", events.schema, ["day", "event_id"])
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/out").groupBy("day", "event_id", "user_id").agg(F.count("*").alias("times"))


# --- reports ---------------------------------------------------------------------------------------------------------

_FAULTS = "with e as (select event_id as id, user_id as record_id, case when event_type = 'error' then 'WRITE' else 'MAP' end as phase, ts as created_at from events) "


def _faults(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("record_id"), F.when(F.col("event_type") == "error", "WRITE").otherwise("MAP").alias("phase"), F.col("ts").alias("created_at"))


@query(_FAULTS + "select id, phase from e where record_id = 3 and phase = 'MAP' order by id limit 5 offset 5")
def error_page(spark, d):
    return reports.error_page(_faults(spark, d), 3, "map", 2, 5).select("id", "phase")


@query(_FAULTS + "select id from e where created_at >= timestamp '2024-01-20 00:00:00'")
def retention_errors(spark, d):
    return reports.kept_errors(_faults(spark, d), dt.datetime(2024, 1, 27), 7).select("id")


@query("select c_custkey as id from customer where c_custkey % 2 = 0 and c_custkey % 3 = 1")
def schedulable_tasks(spark, d):
    k = F.col("c_custkey")
    tasks = t(spark, d, "customer").select(k.alias("id"), (k % 2 == 0).alias("enabled"), F.when(k % 3 == 1, "0 0 * * * ?").when(k % 3 == 2, "  ").alias("cron_expression"))
    return reports.schedulable(tasks).select("id")


@query("select user_id as task_id, count(*) as n from events group by user_id")
def count_by_task(spark, d):
    return reports.count_by_task(_runs(spark, d))


@query("select count(*) as n from events")
def count_records(spark, d):
    return reports.total_records(_runs(spark, d))


@query("select false as same, count(*) as rows from orders")
def reconcile_digest_changed(spark, d):
    """One changed value in one row changes the digest."""
    o = t(spark, d, "orders")
    a, b = reconcile.table_digest(o), reconcile.table_digest(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    return a.crossJoin(b.select(F.col("digest").alias("other"))).select((F.col("digest") == F.col("other")).alias("same"), "rows")


# --- sources ---------------------------------------------------------------------------------------------------------


def _derby(spark):
    """A database of the driver's own, on its disk, so that its heap does not bound the tables."""
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark._jvm.java.lang.Class.forName(driver)
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tidemark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return JdbcTables(spark, f"jdbc:derby:{folder}/db;create=true", connections=4, driver=driver)


def _derby_orders(spark, d):
    """A database with all orders."""
    db = _derby(spark)
    db.execute('CREATE TABLE "O" ("K" BIGINT NOT NULL PRIMARY KEY, "P" DOUBLE, "S" VARCHAR(1))', 'CREATE INDEX "IS" ON "O" ("S")')
    db.append("O", t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("K"), F.col("o_totalprice").cast("double").alias("P"), F.col("o_orderstatus").alias("S")))
    return db


@query('select o_orderkey::bigint as "K", o_totalprice::double as "P", o_orderstatus as "S" from orders')
def jdbc_scan(spark, d):
    """A database table, read in parts by ranges of its key."""
    return _derby_orders(spark, d).read("O", "K")


@query('select o_orderstatus as "S", count(*) as "N" from orders group by o_orderstatus')
def jdbc_statement(spark, d):
    """A statement in the database's own SQL runs there."""
    return _derby_orders(spark, d).query('SELECT "S", CAST(COUNT(*) AS BIGINT) AS N FROM "O" GROUP BY "S"')


@query('select o_orderkey::bigint as "K", case when o_orderkey % 2 = 0 then -1 else o_totalprice end::double as "P", o_orderstatus as "S" from orders')
def jdbc_upsert(spark, d):
    """Staged in parallel, then one MERGE statement; unmapped columns keep their values."""
    db = _derby_orders(spark, d)
    db.upsert("O", db.read("O").where("K % 2 = 0").select("K", F.lit(-1.0).alias("P")), ["K"], [])
    return db.read("O")


@query('select o_orderkey::bigint as "K", o_totalprice::double * 2 as "P", o_orderstatus as "S", s as strategy from orders, (values (\'TRUNCATE\'), (\'DELETE\'), (\'SWAP\')) v(s)')
def jdbc_refresh(spark, d):
    out = None
    for strategy in Strategy:
        db = _derby_orders(spark, d)
        db.replace("O", db.read("O", "K").select("K", (F.col("P") * 2).alias("P"), "S"), strategy)
        got = db.read("O").withColumn("strategy", F.lit(str(strategy)))
        out = got if out is None else out.union(got)
    return out


@query(
    "select s_suppkey::bigint as \"K\", s_name as \"U\", not (s_suppkey % 5 = 3 or s_suppkey % 97 = 1) as written from supplier"
)
def jdbc_isolated_rows(spark, d):
    """A run writes all rows but those that the database refuses: of another row's unique key, or too long for it."""
    db, named = _derby(spark), t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("K"), F.col("s_name").alias("U"))
    s = named.withColumn("U", F.concat_ws(" ", "U", "K"))  # names may repeat
    db.execute('CREATE TABLE "T" ("K" BIGINT NOT NULL PRIMARY KEY, "U" VARCHAR(60) NOT NULL UNIQUE, "V" VARCHAR(4))')
    db.append("T", s.where("K % 5 = 3").select((-F.col("K")).alias("K"), "U", F.lit("old").alias("V")))
    source = s.withColumn("V", F.when(F.col("K") % 97 == 1, "too long").otherwise("new"))
    spec = TableSpec((_column("K", "BIGINT", False), _column("U", "VARCHAR", False), _column("V", "VARCHAR")), ("K",))
    task = SyncTask(31, "T", "s", mode="INCR", errors=ErrorPolicy(skip_bad_rows=True, max_skip_rows=source.count(), max_errors_recorded=0))
    _done(run_task(spark, task, MemoryTables(s=source), db, source_spec=spec, target_spec=spec))
    there = db.read("T", ["K"]).where("V = 'new'").select("K", F.lit(True).alias("hit"))
    return named.join(there, "K", "left").select("K", "U", F.col("hit").isNotNull().alias("written"))


@query('select o_orderkey::bigint as "K", o_orderstatus as "S", true as even from orders')
def jdbc_even_parts(spark, d):
    """A database read by a text and a number: few distinct texts, and yet parts of about as many rows."""
    rows = _derby_orders(spark, d).read("O", ["S", "K"])
    n = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]  # one for each connection
    return rows.select("K", "S", F.lit(len(n) == 4 and max(n) <= 2 * min(n)).alias("even"))


@query("select event_id, case when event_id >= (select 0.99 * max(event_id) from events) then value + 1 else value end as value, true as spared from events")
def parquet_pruned_upsert(spark, d):
    """The newest hundredth of the keys put into a table that lies by key: statistics leave a twentieth of the files to open."""
    rows = t(spark, d, "events").select("event_id", "value")
    store = ParquetTables(spark, _folder(spark, "tables"), rows_per_file=max(1, rows.count() // 100))
    store.create("out", rows, ["event_id"])
    top = rows.agg(F.max("event_id")).first()[0]
    store.upsert("out", rows.where(F.col("event_id") >= 0.99 * top).withColumn("value", F.col("value") + 1), ["event_id"], [], unique=True)
    files, opened, _ = store.touched
    return store.read("out").withColumn("spared", F.lit(opened <= 0.05 * files))


@query("select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id")
def upsert_across_batches(spark, d):
    """Three batches, the newest first: a row of the table with a greater version stays."""
    rows = t(spark, d, "events").select("user_id", "event_id", "value")
    store = ParquetTables(spark, _folder(spark, "tables"))
    store.create("out", rows.limit(0))
    for batch in (2, 0, 1):
        store.upsert("out", rows.where(F.col("event_id") % 3 == batch), ["user_id"], ["event_id"], version="event_id")
    return store.read("out")


@query(_sql([("exists", "true"), ("lead", "K,S"), ("primary", "K"), ("reachable", "true"), ("tables", "O")], "what, said"))
def jdbc_metadata(spark, d):
    """Names, keys and indexed lead columns as the database tells them."""
    db = _derby_orders(spark, d)
    primary, _, lead = db.keys("O")
    said = {"exists": str(db.exists("o")).lower(), "lead": ",".join(sorted(lead)), "primary": ",".join(primary), "reachable": str(db.reachable() is None).lower(), "tables": ",".join(x for x in db.tables() if x == "O")}
    return spark.createDataFrame(sorted(said.items()), "what string, said string")


@query("select n_nationkey as k, n_name from nation order by n_nationkey limit 5")
def sql_preview(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("nation_preview")
    return preview(spark, "select n_nationkey as k, n_name from nation_preview order by n_nationkey", 5)


@query("select * from (values ('k', 'BIGINT', true), ('name', 'TEXT', true)) v(name, type, nullable)")
def sql_discovery(spark, d):
    """Columns of a statement, which is analysed and not run."""
    t(spark, d, "nation").createOrReplaceTempView("nation_columns")
    found = sql_columns(spark, "select cast(n_nationkey as bigint) as k, n_name as name from nation_columns")
    return spark.createDataFrame([(c["name"], c["type"], c["nullable"]) for c in found], "name string, type string, nullable boolean")


@query("select column_name as name, case column_type when 'BIGINT' then 'BIGINT' when 'INTEGER' then 'INT' when 'DOUBLE' then 'DOUBLE' when 'VARCHAR' then 'TEXT' when 'DATE' then 'DATE' when 'TIMESTAMP' then 'TIMESTAMP' else column_type end as type, true as nullable, column_name = 'o_orderkey' as primary_key from (describe orders)")
def describe_table(spark, d):
    df = t(spark, d, "orders")
    found = describe(df, spec_from(df, ["o_orderkey"]))
    return spark.createDataFrame([(c["name"], c["type"].split("(")[0] if not c["type"].startswith("DECIMAL") else c["type"], c["nullable"], c["primary_key"]) for c in found], "name string, type string, nullable boolean, primary_key boolean")


@rule(_sql([("DM DBMS", "DM8"), ("MariaDB Server", "MYSQL"), ("MySQL", "MYSQL"), ("PostgreSQL", None)], "product, kind"))
def database_kinds(spark, d):
    names = ["DM DBMS", "MariaDB Server", "MySQL", "PostgreSQL"]
    return spark.createDataFrame([(n, database_kind(n)) for n in names], "product string, kind string")


@rule(_sql([("DM8", "jdbc:dm://h:5236/b"), ("MYSQL", "jdbc:mysql://h:3306/b?useSSL=false&allowPublicKeyRetrieval=true&characterEncoding=utf8&serverTimezone=UTC&rewriteBatchedStatements=true&zeroDateTimeBehavior=EXCEPTION")], "kind, url"))
def jdbc_addresses(spark, d):
    return spark.createDataFrame([(k, jdbc_url(k, "h", p, "b")) for k, p in (("DM8", 5236), ("MYSQL", 3306))], "kind string, url string")


_SAID = [
    ("MYSQL", "upsert", "INSERT INTO `t` (`a`, `b`) SELECT `a`, `b` FROM `s` ON DUPLICATE KEY UPDATE `b` = VALUES(`b`)"), ("MYSQL", "truncate", "TRUNCATE TABLE `t`"), ("MYSQL", "swap", "RENAME TABLE `t` TO `o`, `s` TO `t`"), ("MYSQL", "create", "CREATE TABLE `s` LIKE `t`"),
    ("DM8", "upsert", 'MERGE INTO "t" t USING "s" s ON t."a" = s."a" WHEN MATCHED THEN UPDATE SET "b" = s."b" WHEN NOT MATCHED THEN INSERT ("a", "b") VALUES (s."a", s."b")'), ("DM8", "truncate", 'TRUNCATE TABLE "t"'), ("DM8", "swap", 'ALTER TABLE "t" RENAME TO "o"; ALTER TABLE "s" RENAME TO "t"'), ("DM8", "create", 'CREATE TABLE "s" LIKE "t"'),
]


@rule(_sql(_SAID, "dialect, what, statement"))
def dialect_statements(spark, d):
    """The statements that Spark's own writer does not make."""
    rows = []
    for kind in ("MYSQL", "DM8"):
        x = dialect_of(kind)
        rows += [(kind, "upsert", x.upsert_from("t", "s", ["a", "b"], ["a"])), (kind, "truncate", x.truncate("t")), (kind, "swap", "; ".join(x.swap("t", "s", "o"))), (kind, "create", "; ".join(x.create_like("s", "t")))]
    return spark.createDataFrame(rows, "dialect string, what string, statement string")


# --- cursors, guards, preflight, runtime -----------------------------------------------------------------------------

_CODES = [("5", 1, "5"), ("2024-01-02 03:04:05|7", 2, "2024-01-02 03:04:05"), ('["2024-01-02", 7]', 2, "2024-01-02"), ("a\\|b|c", 2, "a|b"), ("[broken", 1, "[broken"), ("  ", 0, None)]


@rule(_sql(_CODES, "cursor, parts, first"))
def cursor_parts(spark, d):
    found = [(c, cursor.decode(c)) for c, _, _ in _CODES]
    return spark.createDataFrame([(c, len(p), p[0] if p else None) for c, p in found], "cursor string, parts long, first string")


@rule(_sql([("DATE", "90000", "2024-01-08"), ("INT", "10", "90"), ("TIMESTAMP", "600", "2024-01-09 23:50:00")], "kind, back, bound"))
def cursor_look_back(spark, d):
    """Seconds for points in time, whole days for dates, units for numbers."""
    cases = [("DATE", 90000, dt.date(2024, 1, 10)), ("INT", 10, 100), ("TIMESTAMP", 600, dt.datetime(2024, 1, 10))]
    return spark.createDataFrame([(k, str(by), cursor.text_of(cursor.look_back(v, _column("c", k), by))) for k, by, v in cases], "kind string, back string, bound string")


@rule(_sql([("FULL", "5", False), ("FULL_INCR", None, False), ("FULL_INCR", "5", True), ("INCR", None, True), (None, None, True)], "mode, cursor, incremental"))
def mode_choice(spark, d):
    cases = [("FULL", "5"), ("FULL_INCR", None), ("FULL_INCR", "5"), ("INCR", None), (None, None)]
    return spark.createDataFrame([(m, c, is_incremental(SyncTask(1, "t", "s", mode=m, incr_value=c))) for m, c in cases], "mode string, cursor string, incremental boolean")


_NAMES = [("orders", True), ("db.orders", True), ("中文表_订单", True), ("a.b.c.d", False), ("a b", False), ("a;drop", False), ("", False), ("order", True)]


@rule(_sql(_NAMES, "name, ok"))
def identifiers(spark, d):
    return spark.createDataFrame([(n, is_identifier(n)) for n, _ in _NAMES], "name string, ok boolean")


_URL = "jdbc:mysql://H:3306/own?useSSL=false"


@rule(_sql([("jdbc:mysql://h:3306/own", "sync_task", "ERROR"), ("jdbc:mysql://h:3306/own", "QRTZ_JOBS", "ERROR"), ("jdbc:mysql://h:3306/own", "orders", "WARN"), ("jdbc:mysql://h:3306/other", "sync_task", None)], "url, name, level"))
def metadata_target(spark, d):
    cases = [("jdbc:mysql://h:3306/own", "sync_task"), ("jdbc:mysql://h:3306/own", "QRTZ_JOBS"), ("jdbc:mysql://h:3306/own", "orders"), ("jdbc:mysql://h:3306/other", "sync_task")]
    found = [(u, n, check_metadata_target(_URL, u, n)) for u, n in cases]
    return spark.createDataFrame([(u, n, i and str(i.level)) for u, n, i in found], "url string, name string, level string")


_GRANTS = [("GRANT ALL PRIVILEGES ON *.* TO 'u'@'%'", "DROP", True), ("GRANT SELECT, DELETE ON `b`.* TO 'u'@'%'", "DELETE", True), ("GRANT SELECT ON `b`.* TO 'u'@'%'", "DROP", False), ("GRANT DROP ON `x`.* TO 'u'@'%'", "DROP", False), ("unreadable", "DROP", True)]


@rule(_sql(_GRANTS, "line, privilege, ok"))
def grants(spark, d):
    return spark.createDataFrame([(line, p, check_grants([line], p, "b") is None) for line, p, _ in _GRANTS], "line string, privilege string, ok boolean")


_KEYED = TableSpec((_column("id", "BIGINT", False), _column("at", "DATETIME"), _column("txt", "TEXT"), _column("clock", "TIME"), _column("name", "VARCHAR", True, 200)), ("id",), indexed=("at",))
_LOOSE = TableSpec(_KEYED.columns)
_OUT = TableSpec((_column("id", "BIGINT", False), _column("at", "DATETIME"), _column("name", "VARCHAR", True, 20)), ("id",))
_IDS = (FieldMapping("id", "id"),)
#: Task fields, source, target, further facts, and the codes that preflight gives.
_TASKS = [
    ("good", {}, _KEYED, _OUT, {}, ["WARN TYPE_INCOMPATIBLE"]),
    ("identifier", {"mappings": _IDS, "source_table": "a b"}, _KEYED, _OUT, {}, ["ERROR IDENTIFIER_INVALID"]),
    ("batch", {"mappings": _IDS, "batch_size": 2000}, _KEYED, _OUT, {}, ["WARN CONFIG_INVALID"]),
    ("lag", {"mappings": _IDS, "mode": "INCR", "incr_column": "id", "incr": IncrPolicy(5)}, TableSpec(_KEYED.columns, ("id",), indexed=("id",)), _OUT, {}, ["WARN CONFIG_INVALID"]),
    ("statement", {"mappings": _IDS, "source_sql": "drop table t", "order_column": "id"}, _KEYED, _OUT, {}, ["ERROR CUSTOM_SQL_INVALID"]),
    ("no_source", {}, None, _OUT, {}, ["ERROR SRC_TABLE_MISSING"]),
    ("no_target", {}, _KEYED, None, {}, ["ERROR DST_TABLE_MISSING"]),
    ("no_swap", {"mappings": _IDS, "strategy": "SWAP"}, _KEYED, _OUT, {"target_kind": "DM8"}, ["ERROR STRATEGY_UNSUPPORTED"]),
    ("long_swap", {"mappings": _IDS, "strategy": "SWAP", "target_table": "t" * 41}, _KEYED, _OUT, {"target_kind": "MYSQL"}, ["WARN STRATEGY_UNSUPPORTED"]),
    ("nothing", {}, _KEYED, TableSpec((_column("zzz", "INT"),), ("zzz",)), {}, ["ERROR MAPPING_COLUMN_MISSING", "ERROR NO_TARGET_COLUMNS"]),
    ("mapping", {"mappings": (*_IDS, FieldMapping("name", "nowhere"))}, _KEYED, _OUT, {}, ["ERROR MAPPING_COLUMN_MISSING"]),
    ("types", {"mappings": (*_IDS, FieldMapping("at", "txt"), FieldMapping("name", "id"))}, _KEYED, TableSpec((_column("id", "BIGINT"), _column("at", "INT"), _column("name", "VARCHAR", True, 20)), ("id",)), {}, ["ERROR TYPE_INCOMPATIBLE"]),
    ("no_key", {"mappings": _IDS}, _KEYED, TableSpec(_OUT.columns), {}, ["WARN PK_MISSING"]),
    ("no_key_incr", {"mappings": _IDS, "mode": "INCR", "incr_column": "at"}, _KEYED, TableSpec(_OUT.columns), {}, ["ERROR PK_MISSING"]),
    ("incr_missing", {"mappings": _IDS, "mode": "INCR", "incr_column": "nowhere"}, _KEYED, _OUT, {}, ["ERROR INCR_COLUMN_MISSING"]),
    ("incr_unset", {"mappings": _IDS, "mode": "INCR"}, _KEYED, _OUT, {}, ["WARN INCR_COLUMN_MISSING"]),
    ("incr_clock", {"mappings": _IDS, "mode": "INCR", "incr_column": "clock"}, _KEYED, _OUT, {}, ["ERROR INCR_COLUMN_NOT_SORTABLE"]),
    ("incr_index", {"mappings": _IDS, "mode": "INCR", "incr_column": "id"}, _KEYED, _OUT, {}, ["WARN INCR_COLUMN_NO_INDEX"]),
    ("no_order", {"mappings": _IDS}, _LOOSE, _OUT, {}, ["ERROR SORT_KEY_MISSING"]),
    ("loose_order", {"mappings": _IDS, "order_column": "at"}, _LOOSE, _OUT, {}, ["ERROR ORDER_KEY_NOT_UNIQUE"]),
    ("grants", {"mappings": _IDS}, _KEYED, _OUT, {"target_kind": "MYSQL", "grants": ["GRANT SELECT ON `b`.* TO 'u'@'%'"], "database": "b"}, ["ERROR PERMISSION_DENIED"]),
    ("own_table", {"mappings": _IDS, "target_table": "sync_task"}, _KEYED, _OUT, {"own_url": _URL, "target_url": _URL}, ["ERROR TARGET_IS_METADATA"]),
    ("own_place", {"mappings": _IDS}, _KEYED, _OUT, {"own_url": _URL, "target_url": _URL}, ["WARN TARGET_IS_METADATA"]),
    ("broken", {"mappings": _IDS}, TableSpec((None,)), _OUT, {}, ["ERROR PREFLIGHT_FAILED"]),
]


@rule(_sql([(n, c) for n, *_, codes in _TASKS for c in codes], "task, said"))
def preflight_codes(spark, d):
    """Every code of preflight, from one table of tasks."""
    rows = []
    for name, fields, source, target, more, _ in _TASKS:
        task = SyncTask(**({"id": 1, "target_table": "t", "source_table": "s", "mode": "FULL"} | fields))
        rows += [(name, f"{i.level} {i.code}") for i in resolve(task, source, target, **more).issues]
    return spark.createDataFrame(rows, "task string, said string")


_STATES = [("08S01", 0, True), ("40001", 0, True), ("23000", 1205, False), ("42000", 0, False), (None, 1213, True), (None, 7, False)]


@rule(_sql(_STATES, "state, code, retryable"))
def retryable_errors(spark, d):
    return spark.createDataFrame([(s, c, retryable_state(s, c)) for s, c, _ in _STATES], "state string, code long, retryable boolean")


@rule("select attempt, least(60000, 2000 * power(2, attempt - 1))::bigint as pause from (select unnest(range(1, 9)) as attempt)")
def retry_pauses(spark, d):
    return spark.createDataFrame([(n, backoff_ms(2000, n)) for n in range(1, 9)], "attempt long, pause long")


@rule("select 2::bigint as heard, 1::bigint as left_over")
def event_bus(spark, d):
    """A subscriber that raises does not disturb the others."""
    bus, heard = EventBus(), []

    def broken(_):
        raise ValueError("no")

    bus.subscribe(broken)
    bus.subscribe(heard.append)
    bus.publish("a")
    bus.unsubscribe(broken)
    bus.publish("b")
    return spark.createDataFrame([(len(heard), bus.count())], "heard long, left_over long")


_SAVED = [("full", {"mode": "FULL"}, True), ("incr", {"mode": "INCR", "incr_column": "a"}, True), ("no_column", {"mode": "INCR"}, False), ("batch", {"mode": "FULL", "batch_size": 2000}, False), ("page", {"mode": "FULL", "page_size": 0}, False), ("lag", {"mode": "FULL", "incr": IncrPolicy(-1)}, False), ("source", {"mode": "FULL", "source_table": None}, False)]


@rule(_sql([(n, ok) for n, _, ok in _SAVED], "task, ok"))
def task_validation(spark, d):
    def ok(fields):
        try:
            return bool(check_task(SyncTask(**({"id": 1, "target_table": "t", "source_table": "s"} | fields))))
        except ValueError:
            return False

    return spark.createDataFrame([(n, ok(f)) for n, f, _ in _SAVED], "task string, ok boolean")


@rule(_sql([("password=***", 12), ("x" * 1000, 1000)], "said, n"))
def secrets_scrubbed(spark, d):
    said = [scrub("password=hunter2"), scrub("x" * 5000)]
    return spark.createDataFrame([(s, len(s)) for s in said], "said string, n long")


@query("select n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"raw\":\"<binary ' || strlen(n_name) || ' bytes>\",\"none\":null}' as row_data from nation")
def row_as_json(spark, d):
    """Rows in errors: bytes are told by their number, nulls are kept."""
    from .plans.engine import row_data

    df = t(spark, d, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("raw"), F.lit(None).cast("string").alias("none"))
    return df.select("n_nationkey", row_data(df, ["n_nationkey", "raw", "none"]).alias("row_data"))
