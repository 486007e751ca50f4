"""A run: read a window, convert, set bad rows aside, apply to the target, report. The cursor moves only on success."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.convert import as_text, convert
from ..functions.types import BINARY, CHARACTER, INTEGERS, family
from ..model import ColumnSpec, Issue, Status, SyncResult, SyncTask, TableSpec, scrub
from ..operators.cursor import ReadWindow, anchor, encode, read_window
from ..operators.merge import append, last_wins
from ..runtime import Cancellation, Cancelled, Progress, with_retries
from ..sources.base import read_sql, spec_from, staging_dir
from ..sources.jdbc import Rejected, TooManyRejected
from .resolve import SyncPlan, resolve

#: Longest texts kept of an error.
KEY_CHARS, MESSAGE_CHARS, DATA_CHARS = 255, 1000, 4000
CONSTANT = ColumnSpec("constant", "VARCHAR")


@dataclass(frozen=True)
class Staged:
    """Converted rows, written once: counting and writing read the same rows whatever the source does meanwhile."""

    rows: DataFrame
    plan: SyncPlan
    folder: str = ""
    #: Rows read, bad rows, and the order keys of the last good row, counted while they were written.
    read: int = 0
    n_bad: int = 0
    last: tuple | None = None

    @property
    def good(self) -> DataFrame:
        return self.rows.where("_phase is null")

    @property
    def bad(self) -> DataFrame:
        return self.rows.where("_phase is not null")

    @property
    def target_rows(self) -> DataFrame:
        """Good rows as the target's columns, and the source's order keys as _o0, _o1, ..."""
        return self.good.select(*[w.target.name for w in self.plan.written], *[f"_o{i}" for i in range(len(self.plan.order_keys))])


def row_data(df: DataFrame, columns: list[str]) -> Column:
    """The source row as JSON: nulls kept, bytes told by their number."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    shown = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit("<binary "), F.octet_length(f"`{c}`").cast("string"), F.lit(" bytes>"))).alias(c) if kinds[c] == "binary" else F.col(f"`{c}`") for c in columns]
    return F.substring(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}), 1, DATA_CHARS)


def converted(df: DataFrame, plan: SyncPlan) -> DataFrame:
    """Target columns, order keys, and for bad rows phase, message, key and data. Expressions only; one pass."""
    values, reasons, nulls = [], [], []
    for w in plan.written:
        c, source = (F.col(f"`{w.source.name}`"), w.source) if w.source else (F.lit(w.constant), CONSTANT)
        new, bad = convert(c, source, w.target)
        values.append(new.alias(w.target.name))
        shown = F.substring(F.coalesce(as_text(c, source).cast("string"), F.lit("")), 1, 100) if family(source) else F.lit("")
        reasons.append(F.when(bad, F.concat(F.lit(f"{w.target.name}: no {w.target.sql_type}: "), shown)))
        if not w.target.nullable:
            nulls.append(F.when(new.isNull(), F.lit(f"{w.target.name}: must not be null")))
    if plan.incr is not None:
        reasons.insert(0, F.when(F.col(f"`{plan.incr.name}`").isNull(), F.lit(f"{plan.incr.name}: the incremental column is null")))
    mapped = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    broken = F.coalesce(*nulls) if nulls else F.lit(None).cast("string")
    keys = [w.source.name for w in plan.written if w.source and w.target.name in plan.keys] or plan.order_keys or plan.select
    key = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null"))) for k in keys])
    order = [F.col(f"`{k}`").alias(f"_o{i}") for i, k in enumerate(plan.order_keys)]
    out = df.select(*values, *order, mapped.alias("_mapped"), broken.alias("_broken"), key.alias("_key"), row_data(df, plan.select).alias("_data"))
    phase = F.when(F.col("_mapped").isNotNull(), "MAP").when(F.col("_broken").isNotNull(), "WRITE")
    out = out.withColumn("_phase", phase).withColumn("_message", F.substring(F.coalesce("_mapped", "_broken"), 1, MESSAGE_CHARS)).drop("_mapped", "_broken")
    is_bad = F.col("_phase").isNotNull()
    return out.withColumn("_key", F.when(is_bad, F.substring("_key", 1, KEY_CHARS))).withColumn("_data", F.when(is_bad, F.col("_data")))


def stage(df: DataFrame, plan: SyncPlan) -> Staged:
    """Write the converted rows and count them on the way. The metrics sit on top of the written plan, in its last stage,
    whose tasks count once each however often they are tried."""
    spark = df.sparkSession
    rows = converted(df, plan)
    folder = f"{staging_dir(spark)}/stage-{plan.task.id}-{uuid.uuid4().hex}"
    keys = [F.col(f"_o{i}") for i in range(len(plan.order_keys))]
    metrics = [F.count("*").alias("read"), F.count("_phase").alias("bad")]
    if keys and plan.incr is not None:
        metrics.append(F.max(F.when(F.col("_phase").isNull(), F.struct(*keys))).alias("last"))
    seen = Observation()
    rows.observe(seen, *metrics).write.parquet(folder)
    n = seen.get
    return Staged(spark.read.schema(rows.schema).parquet(folder), plan, folder, n["read"], n["bad"], n.get("last"))


def source_rows(spark: SparkSession, task: SyncTask, source, plan: SyncPlan | None = None, window: ReadWindow | None = None) -> DataFrame:
    """The rows of a task's table or statement, before any window.

    A statement for a database is that database's own SQL and runs there; otherwise it is Spark SQL. With a plan, a
    database is read in parts by ranges of the plan's order keys, even over the rows of the window.
    """
    if hasattr(source, "query"):
        keys = plan.order_keys if plan and not any(family(plan.source.find(k)) in {*BINARY, "boolean", "bit", "float", "double"} for k in plan.order_keys) else []
        return source.query(task.source_sql, keys, window) if task.source_sql else source.read(task.source_table, keys, window)
    return read_sql(spark, task.source_sql) if task.source_sql else source.read(task.source_table)


def window_of(plan: SyncPlan, df: DataFrame, now: dt.datetime | None) -> ReadWindow | None:
    """None reads everything: full runs, and incremental ones without an incremental column."""
    if not plan.incremental or plan.incr is None:
        return None
    return read_window(plan.task.cursor, plan.incr, plan.ties, plan.task.incr, anchor(df, plan.incr, plan.task.incr, now))


def _problem(task: SyncTask, bad: int) -> str | None:
    if bad and not task.errors.skip_bad_rows:
        return f"{bad} bad rows"
    return f"{bad} bad rows, more than {task.errors.max_skip_rows}" if bad > task.errors.max_skip_rows else None


def run(
    spark: SparkSession, task: SyncTask, source, target, *, source_spec: TableSpec | None = None, target_spec: TableSpec | None = None, now: dt.datetime | None = None,
    listener: Callable[[Progress], None] | None = None, cancellation: Cancellation | None = None, issues: tuple[Issue, ...] = (), fence: Callable[[], None] | None = None, **preflight,
) -> SyncResult:
    """Apply one task. Specs default to the schemas read, which declare no keys; `now` anchors cursors in time.

    A failed or cancelled run leaves the target as it was and has no end cursor. written_rows counts good rows before
    rows with equal keys are reduced to the last. `fence` is called before anything is written, and raises if the run has
    lost its right to.
    """
    began = time.monotonic()
    result = SyncResult(task.id, Status.RUNNING, start_cursor=task.cursor)
    tell, stop = listener or (lambda _: None), cancellation or Cancellation(spark)
    spark.addTag(stop.tag(task.id))
    staged = None
    try:
        plan = _plan(spark, task, source, target, source_spec, target_spec, preflight)
        plan.issues += list(issues)
        result.issues = plan.issues
        if not plan.ok:
            result.status, result.message = Status.FAILED, "; ".join(f"{i.code}: {i.message}" for i in plan.issues if i.level == "ERROR")[:MESSAGE_CHARS]
            return result
        stop.check(task.id)
        window = window_of(plan, source_rows(spark, task, source), now) if plan.incremental else None
        df = source_rows(spark, task, source, plan, window)
        read = (window.apply(df) if window else df).select(*[F.col(f"`{c}`") for c in plan.select])
        staged = with_retries(lambda: stage(read, plan), task.errors)
        keys = [F.col(f"_o{i}") for i in range(len(plan.order_keys))]
        result.read_rows, result.skipped_rows = staged.read, staged.n_bad
        tell(Progress("MAP", staged.read, 0, staged.n_bad))
        if staged.n_bad:
            shown = staged.bad.orderBy(*keys).limit(task.errors.max_errors_recorded) if keys else staged.bad.limit(task.errors.max_errors_recorded)
            result.errors = [{"phase": r["_phase"], "row_key": r["_key"], "message": scrub(r["_message"]), "row_data": r["_data"], "retryable": False} for r in shown.select("_phase", "_key", "_message", "_data").collect()]
        if why := _problem(task, staged.n_bad):
            result.status, result.message = Status.FAILED, why
            return result
        stop.check(task.id)
        if not task.dry_run:
            spare = max(0, task.errors.max_skip_rows - staged.n_bad) if task.errors.skip_bad_rows else 0
            if fence:
                fence()
            try:
                refused = with_retries(lambda: _apply(staged, target, spare), task.errors)
            except TooManyRejected as e:
                result.skipped_rows += len(e.rejected)
                result.errors += _write_errors(e.rejected, plan)[: max(0, task.errors.max_errors_recorded - len(result.errors))]
                raise
            result.skipped_rows += len(refused)
            result.errors += _write_errors(refused, plan)[: max(0, task.errors.max_errors_recorded - len(result.errors))]
            result.written_rows = staged.read - result.skipped_rows
            if staged.last is not None:
                result.end_cursor = encode(list(staged.last))
        result.status = Status.COMPLETED
        tell(Progress("WRITE", result.read_rows, result.written_rows, result.skipped_rows, result.end_cursor))
    except Cancelled as e:
        result.status, result.message = Status.CANCELLED, str(e)
    except Exception as e:
        cancelled = "cancelled" in str(e).lower() and stop.tag(task.id) in str(e)
        result.status, result.message = Status.CANCELLED if cancelled else Status.FAILED, scrub(str(e))
    finally:
        spark.removeTag(stop.tag(task.id))
        stop.done(task.id)
        result.millis = int((time.monotonic() - began) * 1000)
        if staged is not None and target.kind != "MEMORY":  # tables in memory are plans that still read the staged rows
            place = spark._jvm.org.apache.hadoop.fs.Path(staged.folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return result


def _plan(spark, task, source, target, source_spec, target_spec, preflight) -> SyncPlan:
    if source_spec is None:
        try:
            source_spec = spec_from(source_rows(spark, task, source))
        except Exception:  # told by the plan as a missing table or a wrong statement
            source_spec = None
    if target_spec is None and target.exists(task.target_table):
        target_spec = spec_from(target.read(task.target_table))
    return resolve(task, source_spec, target_spec, target_kind=target.kind, **preflight)


def _write_errors(rejected: list[Rejected], plan: SyncPlan) -> list[dict]:
    """Rows that a database refuses, told like bad rows; their data is what would have been written."""
    source = {w.target.name: w.source.name for w in plan.written if w.source}
    keys = plan.keys or [w.target.name for w in plan.written]
    key = lambda row: ",".join(f"{source.get(k, k)}={row.get(k) if row.get(k) is not None else 'null'}" for k in keys)[:KEY_CHARS]
    return [{"phase": "WRITE", "row_key": key(r.row), "message": scrub(r.message)[:MESSAGE_CHARS], "row_data": json.dumps(r.row, ensure_ascii=False)[:DATA_CHARS], "retryable": False} for r in rejected]


def keys_are_unique(plan: SyncPlan) -> bool:
    """Whether the target keys are filled, as they stand, from a key that the source declares: then no key comes twice.

    Only of whole numbers, dates and texts, which no conversion of theirs makes alike.
    """
    alike = lambda w: family(w.source) == family(w.target) and family(w.source) in {*INTEGERS, *CHARACTER, "date"}
    filled = {w.source.name.lower() for w in plan.written if w.source and w.target.name in plan.keys and alike(w)}
    declared = [plan.source.primary_key, *plan.source.unique_keys]
    return not plan.task.source_sql and any(u and {c.lower() for c in u} <= filled for u in declared)


def version_column(plan: SyncPlan) -> str | None:
    """The target column that the incremental column fills as it is."""
    if plan.incr is None:
        return None
    return next((w.target.name for w in plan.written if w.source and w.source.name == plan.incr.name and family(w.source) == family(w.target) and w.target.name not in plan.keys), None)


def _apply(staged: Staged, target, most_rejected: int) -> list[Rejected]:
    plan, rows = staged.plan, staged.target_rows
    order = [f"_o{i}" for i in range(len(plan.order_keys))]
    table, names = plan.task.target_table, [w.target.name for w in plan.written]
    unique = keys_are_unique(plan)
    more = {"most_rejected": most_rejected} if getattr(target, "isolates", False) else {}
    if plan.incremental:
        if getattr(target, "compares", False) and plan.task.incr.lookback_seconds:  # most of a look-back is there already
            more |= {"compare": True, "version": version_column(plan)}
        found = target.upsert(table, rows, plan.keys, order, unique=unique, **more)
        return found if getattr(target, "isolates", False) else []
    kept = (last_wins(rows, plan.keys, order) if plan.keys and not unique else rows).select(*names)
    rows = append(target.read(table).limit(0), kept) if target.kind in ("PARQUET", "MEMORY") else kept
    found = target.replace(table, rows, strategy=plan.task.strategy, keys=plan.keys, **more)
    return found if getattr(target, "isolates", False) else []
