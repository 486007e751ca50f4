"""The registered queries of the replication engine, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports
from .functions.convert import as_text, convert
from .model import ColumnSpec, ErrorPolicy, FieldMapping, IncrPolicy, SyncTask, TableSpec
from .operators import keyset, merge, reconcile
from .operators.cursor import anchor, end_cursor, read_window
from .plans.engine import converted, staging_dir
from .plans.engine import run as run_task
from .plans.guard import check_sql
from .plans.resolve import resolve
from .sources.base import read_sql, spec_from
from .sources.memory import MemoryTables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Rules over fixed cases: tested like queries, with what they must give, and registered with none, as they read no table.
RULES: dict = {}
#: The moment that stands for "now" in the catalogue.
NOW = dt.datetime(2024, 1, 25, 12, 0, 0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rule(sql: str | None = None):
    def add(f):
        RULES[f.__name__] = (f, sql)
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scan, keyset, windows -------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def scan_project(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 500")
def keyset_first_page(spark, d):
    return keyset.keyset_page(t(spark, d, "orders"), ["o_orderkey"], 500, columns=["o_orderkey", "o_totalprice"])


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 500 order by o_orderkey limit 500")
def keyset_next_page(spark, d):
    return keyset.keyset_page(t(spark, d, "orders"), ["o_orderkey"], 500, [500], columns=["o_orderkey", "o_totalprice"])


@query("select o_custkey, o_orderkey from orders where o_custkey > 70 or (o_custkey = 70 and o_orderkey > 300) order by o_custkey, o_orderkey limit 400")
def keyset_two_keys(spark, d):
    return keyset.keyset_page(t(spark, d, "orders"), ["o_custkey", "o_orderkey"], 400, [70, 300], columns=["o_custkey", "o_orderkey"])


@query(
    "select o_custkey, o_orderstatus, o_orderkey from orders where o_custkey > 70 or (o_custkey = 70 and o_orderstatus > 'F') or (o_custkey = 70 and o_orderstatus = 'F' and o_orderkey > 100) order by o_custkey, o_orderstatus, o_orderkey limit 400"
)
def keyset_three_keys(spark, d):
    return keyset.keyset_page(t(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderkey"], 400, [70, "F", 100], columns=["o_custkey", "o_orderstatus", "o_orderkey"])


@query("select o_orderkey from orders where o_totalprice > 100000 and o_orderkey > 200 order by o_orderkey limit 300")
def keyset_extra_predicate(spark, d):
    return keyset.keyset_page(t(spark, d, "orders"), ["o_orderkey"], 300, [200], F.col("o_totalprice") > 100000, ["o_orderkey"])


@query("select event_id, ts from events where ts > timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-20 00:00:00' order by ts, event_id limit 300")
def watermark_page(spark, d):
    return keyset.watermark_page(t(spark, d, "events"), "ts", ["event_id"], 300, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)).select("event_id", "ts")


def _events(spark, d, cursor, policy=IncrPolicy(), column="ts", ties=("event_id",), now=NOW):
    df = t(spark, d, "events")
    spec = spec_from(df, ["event_id"])
    c = spec.find(column)
    return read_window(cursor, c, [spec.find(x) for x in ties], policy, anchor(df, c, policy, now)).apply(df)


@query("select event_id, ts from events where ts > timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-25 12:00:00'")
def wm_window(spark, d):
    return _events(spark, d, "2024-01-10 00:00:00", ties=()).select("event_id", "ts")


@query("select event_id, ts from events where ts <= timestamp '2024-01-25 12:00:00' - interval 3600 second")
def wm_first_run(spark, d):
    return _events(spark, d, None, IncrPolicy(3600)).select("event_id", "ts")


@query("select event_id, ts from events where ts > timestamp '2024-01-10 00:00:00' - interval 600 second and ts <= timestamp '2024-01-25 12:00:00' - interval 3600 second")
def wm_lookback(spark, d):
    return _events(spark, d, "2024-01-10 00:00:00|5", IncrPolicy(3600, 600)).select("event_id", "ts")


@query("select event_id, value from events where event_id > 300 and event_id <= (select max(event_id) from events)")
def wm_numeric_anchor(spark, d):
    return _events(spark, d, "300", column="event_id", ties=()).select("event_id", "value")


@query(
    "select event_id, ts from events where ts <= timestamp '2024-01-25 12:00:00' and (ts > timestamp '2024-01-10 06:00:00' or (ts = timestamp '2024-01-10 06:00:00' and event_id > 100))"
)
def wm_composite_resume(spark, d):
    return _events(spark, d, "2024-01-10 06:00:00|100").select("event_id", "ts")


@query("select max(event_id) as anchor from events")
def anchor_max(spark, d):
    return t(spark, d, "events").agg(F.max("event_id").alias("anchor"))


@query("select ts, event_id from events order by ts desc, event_id desc limit 1")
def end_cursor_last(spark, d):
    df = t(spark, d, "events")
    return df.agg(end_cursor(df, ["ts", "event_id"]).alias("last")).select("last.ts", "last.event_id")


@query("select count(*) as n from lineitem where l_quantity > 25 and l_returnflag = 'R'")
def count_predicate(spark, d):
    return t(spark, d, "lineitem").where(keyset.all_of(F.col("l_quantity") > 25, F.col("l_returnflag") == "R")).agg(F.count("*").alias("n"))


# --- upserts and refreshes -------------------------------------------------------------------------------------------

_HALVES = "with src as (select o_orderkey as k, o_totalprice * 2 as v from orders where o_orderkey % 3 = 0), tgt as (select o_orderkey as k, o_totalprice as v, o_orderstatus as s from orders where o_orderkey % 2 = 0) "


def _halves(spark, d):
    o = t(spark, d, "orders")
    src = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("v"))
    return src, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))


@query(_HALVES + "select coalesce(s.k, t.k) as k, case when s.k is not null then s.v else t.v end as v from tgt t full outer join src s on t.k = s.k")
def upsert_merge(spark, d):
    src, tgt = _halves(spark, d)
    return merge.merge(tgt.drop("s"), src, ["k"])


@query(_HALVES + "select coalesce(s.k, t.k) as k, case when s.k is not null then s.v else t.v end as v, t.s from tgt t full outer join src s on t.k = s.k")
def upsert_partial_columns(spark, d):
    src, tgt = _halves(spark, d)
    return merge.merge(tgt, src, ["k"])


@query("select o_orderkey as k from orders where o_orderkey % 2 = 0 union select o_orderkey from orders where o_orderkey % 3 = 0")
def upsert_all_keys(spark, d):
    src, tgt = _halves(spark, d)
    return merge.merge(tgt.select("k"), src.select("k"), ["k"])


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def upsert_last_wins(spark, d):
    return merge.last_wins(t(spark, d, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


def _column(name, kind, nullable=True, length=0, scale=0):
    return ColumnSpec(name, kind, nullable, length, scale)


@query("select o_orderkey as k, o_totalprice as price, o_orderstatus as status from orders")
def full_refresh(spark, d):
    """A FULL run into a target that held other rows."""
    src = t(spark, d, "orders")
    target = MemoryTables(out=spark.createDataFrame([(-1, 1.0, "X")], "k long, price double, status string"))
    task = SyncTask(1, "out", "orders", mode="FULL", mappings=(FieldMapping("k", "o_orderkey", primary_key=True), FieldMapping("price", "o_totalprice"), FieldMapping("status", "o_orderstatus")))
    _done(run_task(spark, task, MemoryTables(orders=src), target, source_spec=spec_from(src, ["o_orderkey"])))
    return target.read("out")


@query("select n_nationkey as k, n_name as name from nation union all select n_nationkey, n_name from nation")
def full_plain_insert(spark, d):
    """Without keys rows are inserted, and repeats stay."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return merge.append(n, n)


_INCR = "with w as (select event_id, ts, value from events where ts <= timestamp '2024-01-25 12:00:00' and (ts > timestamp '2024-01-05 00:00:00' or (ts = timestamp '2024-01-05 00:00:00' and event_id > 10))), tgt as (select event_id, ts, value - 1 as value, event_type from events where event_id % 2 = 0) "


@query(_INCR + "select coalesce(w.event_id, tgt.event_id) as event_id, coalesce(w.ts, tgt.ts) as ts, case when w.event_id is not null then w.value else tgt.value end as value, tgt.event_type from tgt full outer join w using (event_id)")
def incremental_run(spark, d):
    """An INCR run from a composite cursor: window, conversion, upsert of the mapped columns."""
    src = t(spark, d, "events")
    old = src.where("event_id % 2 = 0").select("event_id", "ts", (F.col("value") - 1).alias("value"), "event_type")
    target = MemoryTables(out=old)
    task = SyncTask(2, "out", "events", mode="INCR", incr_column="ts", cursor="2024-01-05 00:00:00|10", mappings=tuple(FieldMapping(c, c) for c in ("event_id", "ts", "value")))
    _done(run_task(spark, task, MemoryTables(events=src), target, now=NOW, source_spec=spec_from(src, ["event_id"], indexed=["ts"]), target_spec=spec_from(old, ["event_id"])))
    return target.read("out")


def _done(result):
    if result.status != "COMPLETED":
        raise RuntimeError(result.message)
    return result


@query(
    "with w as (select event_id, ts from events where ts <= timestamp '2024-01-25 12:00:00') select count(*)::bigint as read_rows, count(*)::bigint as written_rows, 0::bigint as skipped_rows, (select strftime(ts, '%Y-%m-%d %H:%M:%S') || rtrim(case when extract(microsecond from ts) % 1000000 = 0 then '' else '.' || lpad((extract(microsecond from ts) % 1000000)::varchar, 6, '0') end, '0') || '|' || event_id from w order by ts desc, event_id desc limit 1) as end_cursor from w"
)
def run_report(spark, d):
    """What a first incremental run reports."""
    src = t(spark, d, "events")
    target = MemoryTables(out=src.limit(0).select("event_id", "ts"))
    task = SyncTask(3, "out", "events", mode="INCR", incr_column="ts")
    r = _done(run_task(spark, task, MemoryTables(events=src), target, now=NOW, source_spec=spec_from(src, ["event_id"]), target_spec=spec_from(target.read("out"), ["event_id"])))
    return spark.createDataFrame([(r.read_rows, r.written_rows, r.skipped_rows, r.end_cursor)], "read_rows long, written_rows long, skipped_rows long, end_cursor string")


# --- conversions and bad rows ----------------------------------------------------------------------------------------


def _as(df, keys, column, source, target, name):
    return df.select(*keys, convert(F.col(column), source, target)[0].alias(name))


@query("select l_orderkey, l_linenumber, cast(round(l_quantity / 4.0, 0) as int) as q from lineitem")
def convert_int_half_up(spark, d):
    df = t(spark, d, "lineitem").withColumn("x", F.col("l_quantity") / 4.0)
    return _as(df, ["l_orderkey", "l_linenumber"], "x", _column("x", "DOUBLE"), _column("q", "INT"), "q")


@query("select o_orderkey, cast(cast(o_orderkey as decimal(12,2)) / cast(8 as decimal(12,2)) as decimal(12,1)) as p from orders")
def convert_decimal(spark, d):
    df = t(spark, d, "orders").withColumn("x", (F.col("o_orderkey").cast("decimal(12,2)") / F.lit(8).cast("decimal(12,2)")).cast("decimal(20,6)"))
    return _as(df, ["o_orderkey"], "x", _column("x", "DECIMAL", True, 20, 6), _column("p", "DECIMAL", True, 12, 1), "p")


@query("select event_id, case when extract(microsecond from ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') else strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || rtrim(lpad((extract(microsecond from ts) % 1000000)::varchar, 6, '0'), '0') end as said from events")
def convert_ts_text(spark, d):
    return t(spark, d, "events").select("event_id", as_text(F.col("ts"), _column("ts", "TIMESTAMP")).alias("said"))


@query("select event_id, cast(ts as date) as day from events")
def convert_ts_date(spark, d):
    return _as(t(spark, d, "events"), ["event_id"], "ts", _column("ts", "TIMESTAMP"), _column("day", "DATE"), "day")


@query("select o_orderkey, cast(year(o_orderdate) as int) as y from orders")
def convert_year(spark, d):
    return _as(t(spark, d, "orders"), ["o_orderkey"], "o_orderdate", _column("o_orderdate", "TIMESTAMP"), _column("y", "YEAR"), "y")


@query("select o_orderkey, case o_orderstatus when 'F' then true when 'O' then null else null end as b, o_orderstatus not in ('F') as bad from orders")
def convert_bool_text(spark, d):
    value, bad = convert(F.col("o_orderstatus"), _column("o_orderstatus", "VARCHAR", True, 1), _column("b", "BOOLEAN"))
    return t(spark, d, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "yes").otherwise("perhaps")).select("o_orderkey", F.when(value, True).alias("b"), bad.alias("bad"))


@query("select o_orderkey, cast(o_totalprice as double) as x from orders")
def convert_text_double(spark, d):
    df = t(spark, d, "orders").withColumn("s", F.col("o_totalprice").cast("string"))
    return _as(df, ["o_orderkey"], "s", _column("s", "VARCHAR"), _column("x", "DOUBLE"), "x")


@query("select o_orderkey, 7 as origin, 'north' as region from orders")
def constant_default(spark, d):
    src = t(spark, d, "orders")
    target = TableSpec((_column("o_orderkey", "BIGINT"), _column("origin", "INT"), _column("region", "VARCHAR", True, 10)), ("o_orderkey",))
    task = SyncTask(4, "out", "orders", mode="FULL", mappings=(FieldMapping("o_orderkey", "o_orderkey"), FieldMapping("origin", None, "7"), FieldMapping("region", None, "north")))
    return converted(src, resolve(task, spec_from(src, ["o_orderkey"]), target)).select("o_orderkey", "origin", "region")


def _long_texts(spark, d):
    src = t(spark, d, "documents")
    target = TableSpec((_column("doc_id", "BIGINT", False), _column("text", "VARCHAR", True, 2000)), ("doc_id",))
    return converted(src, resolve(SyncTask(5, "out", "documents", mode="FULL", errors=ErrorPolicy(skip_bad_rows=True)), spec_from(src, ["doc_id"]), target))


@query("select doc_id, 'doc_id=' || doc_id as row_key, 'MAP' as phase from documents where length(text) > 2000")
def bad_rows_length(spark, d):
    return _long_texts(spark, d).where("_phase is not null").select("doc_id", F.col("_key").alias("row_key"), F.col("_phase").alias("phase"))


@query("select count(*) as read_rows, count(*) filter (where length(text) > 2000) as skipped_rows from documents")
def bad_rows_summary(spark, d):
    return _long_texts(spark, d).agg(F.count("*").alias("read_rows"), F.count("_phase").alias("skipped_rows"))


# --- statements, reconciliation, reports -----------------------------------------------------------------------------


def _with_views(spark, d, sql, *names):
    for n in names:
        t(spark, d, n).createOrReplaceTempView(n)
    return read_sql(spark, sql)


@query("select * from (select c_custkey as k, count(*) as n from customer join orders on c_custkey = o_custkey group by c_custkey) _ds_src where k > 20 order by k limit 200")
def custom_sql_page(spark, d):
    df = _with_views(spark, d, "select c_custkey as k, count(*) as n from customer join orders on c_custkey = o_custkey group by c_custkey", "customer", "orders")
    return keyset.keyset_page(df, ["k"], 200, [20])


@query("select r_name, count(*) as n, sum(s_acctbal)::decimal(18,2) as bal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
def custom_sql_joins(spark, d):
    return _with_views(spark, d, "select r_name, count(*) as n, cast(sum(s_acctbal) as decimal(18,2)) as bal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name", "supplier", "nation", "region")


@query("select user_id, event_id, cast(rank() over (partition by user_id order by value desc, event_id) as bigint) as r from events")
def custom_sql_window(spark, d):
    return _with_views(spark, d, "with e as (select * from events) select user_id, event_id, cast(rank() over (partition by user_id order by value desc, event_id) as bigint) as r from e", "events")


@rule("select * from (values ('select 1', true), ('delete from t', false), ('select 1; drop table t', false), ('with a as (select ''drop'' as x) select * from a', true), ('select 1 -- update', true), ('', false)) v(sql, ok)")
def sql_guard(spark, d):
    texts = ["select 1", "delete from t", "select 1; drop table t", "with a as (select 'drop' as x) select * from a", "select 1 -- update", ""]
    return spark.createDataFrame([(s, check_sql(s) is None) for s in texts], "sql string, ok boolean")


@query("select o_orderkey, o_custkey from orders where o_orderkey % 5 = 0")
def reconcile_missing(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return reconcile.missing_rows(o, o.where("o_orderkey % 5 <> 0"), ["o_orderkey"])


@query("select o_orderkey from orders where o_orderkey % 7 = 0")
def reconcile_changed(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return reconcile.changed_rows(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise(F.col("o_orderstatus"))), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return reconcile.duplicate_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select count(*) as source_rows, count(*) filter (where c_custkey % 2 = 0) as target_rows, count(*) = count(*) filter (where c_custkey % 2 = 0) as same from customer")
def reconcile_counts(spark, d):
    c = t(spark, d, "customer")
    return reconcile.row_counts(c, c.where("c_custkey % 2 = 0"))


@query("select true as same, count(*) as rows from orders")
def reconcile_digest(spark, d):
    o = t(spark, d, "orders")
    a, b = reconcile.table_digest(o), reconcile.table_digest(o.repartition(7, "o_custkey"))
    return a.join(b.select("digest").withColumnRenamed("digest", "other"), F.col("digest") == F.col("other")).select(F.lit(True).alias("same"), "rows")


_RUNS = "with r as (select event_id as id, user_id as task_id, ts as start_time, case event_type when 'error' then 'FAILED' when 'view' then 'COMPLETED' when 'click' then 'RUNNING' else 'SUCCESS' end as status, cast(floor(value * 10) as bigint) as read_rows from events) "


def _runs(spark, d):
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "COMPLETED").when(F.col("event_type") == "click", "RUNNING").otherwise("SUCCESS")
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("ts").alias("start_time"), status.alias("status"), F.floor(F.col("value") * 10).cast("long").alias("read_rows"))


@query(_RUNS + "select (select count(*) from customer) as total_tasks, count(*) filter (where status = 'RUNNING') as running_tasks, count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status in ('COMPLETED', 'SUCCESS')) as success, count(*) as total_records, coalesce(sum(read_rows), 0)::bigint as total_read_rows from r")
def dashboard_overview(spark, d):
    return reports.overview(t(spark, d, "customer"), _runs(spark, d))


@query(_RUNS + "select coalesce(sum(read_rows), 0)::bigint as total_read_rows from r")
def dashboard_read_rows(spark, d):
    return reports.total_read_rows(_runs(spark, d))


@query(_RUNS + "select status, count(*) as n from r group by status")
def count_by_status(spark, d):
    return reports.count_by_status(_runs(spark, d))


@query(_RUNS + "select id, start_time from r where status = 'FAILED' order by start_time desc, id desc limit 20")
def recent_failures(spark, d):
    return reports.recent_failures(_runs(spark, d)).select("id", "start_time")


@query(_RUNS + "select id, status from r where task_id = 7 order by start_time desc, id desc limit 10 offset 10")
def record_page(spark, d):
    return reports.record_page(_runs(spark, d), 7, 2, 10).select("id", "status")


@query(_RUNS + "select id from r where status = 'RUNNING' or start_time >= timestamp '2024-01-20 00:00:00'")
def retention_keep(spark, d):
    return reports.kept_records(_runs(spark, d), dt.datetime(2024, 1, 30), 10).select("id")


@query()
def keyset_all_pages(spark, d):
    """Every page of customer, numbered on Spark: the same rows as the table."""
    folder = f"{staging_dir(spark)}/pages-{uuid.uuid4().hex}"
    return keyset.numbered_pages(t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey")), ["c_custkey"], 5000, folder).select("c_custkey")


ORACLES["keyset_all_pages"] = "select c_custkey from customer"


@query("select column_name as name from (describe orders)")
def describe_columns(spark, d):
    from .sources.base import describe

    return spark.createDataFrame([(c["name"],) for c in describe(t(spark, d, "orders"))], "name string")


@rule()
def preflight_issues(spark, d):
    """The codes of a task with a wrong key, a text for a number and no index."""
    src = spec_from(t(spark, d, "events"), ["event_id"])
    target = TableSpec((_column("event_id", "BIGINT"), _column("props", "INT"), _column("ts", "TIMESTAMP")))
    plan = resolve(SyncTask(6, "out", "events", mode="INCR", incr_column="ts", batch_size=2000), src, target)
    return spark.createDataFrame([(str(i.level), i.code) for i in plan.issues], "level string, code string")


RULES["preflight_issues"] = (preflight_issues, "select * from (values ('WARN', 'CONFIG_INVALID'), ('ERROR', 'TYPE_INCOMPATIBLE'), ('ERROR', 'PK_MISSING'), ('WARN', 'INCR_COLUMN_NO_INDEX')) v(level, code)")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_run(spark, sf_dir)
