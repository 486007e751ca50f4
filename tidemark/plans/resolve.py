"""From a task and two tables to a plan, with every reason why it would not run. Touches no data."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.types import compatibility, is_timestamp_cursor, is_watermark
from ..model import ColumnSpec, FieldMapping, Issue, Level, Mode, Strategy, SyncTask, TableSpec, has_error
from .guard import check_grants, check_metadata_target, check_sql, is_identifier

#: Privileges that a full refresh needs, by strategy.
NEEDED = {Strategy.TRUNCATE: ("DROP",), Strategy.DELETE: ("DELETE",), Strategy.SWAP: ("CREATE", "DROP")}
LONG_NAME = 40


@dataclass(frozen=True)
class Written:
    """A target column and what it is filled from."""

    target: ColumnSpec
    source: ColumnSpec | None
    constant: str | None = None


@dataclass
class SyncPlan:
    task: SyncTask
    source: TableSpec | None
    target: TableSpec | None
    incremental: bool = False
    written: list[Written] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    incr: ColumnSpec | None = None
    order_keys: list[str] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not has_error(self.issues)

    @property
    def ties(self) -> list[ColumnSpec]:
        return [self.source.find(k) for k in self.order_keys if self.incr is None or k.lower() != self.incr.name.lower()]

    @property
    def select(self) -> list[str]:
        """Source columns to read: the mapped ones, then the cursor and order keys."""
        names = [w.source.name for w in self.written if w.source] + ([self.incr.name] if self.incr else []) + self.order_keys
        return _once(names)


def _once(names: list[str]) -> list[str]:
    """The names in order, each at its first place; case does not count."""
    found: dict[str, str] = {}
    for n in names:
        found.setdefault(n.lower(), n)
    return list(found.values())


def is_incremental(task: SyncTask) -> bool:
    """FULL_INCR is incremental once there is a cursor; no mode means incremental."""
    return task.mode in (None, Mode.INCR) or task.mode == Mode.FULL_INCR and task.cursor is not None


def resolve(task: SyncTask, source: TableSpec | None, target: TableSpec | None, *, target_kind: str = "PARQUET", grants: list[str] | None = None, database: str | None = None, own_url: str | None = None, target_url: str | None = None) -> SyncPlan:
    """The plan with its issues; never raises. ERROR issues mean that a run reads and writes nothing."""
    plan = SyncPlan(task, source, target, is_incremental(task))
    try:
        _basics(plan, target_kind)
        if source is not None and target is not None:
            _columns(plan)
            _keys(plan)
            _cursor(plan)
            _order(plan)
        if not plan.incremental and target_kind == "MYSQL" and grants:
            plan.issues += [i for i in (check_grants(grants, p, database) for p in NEEDED[task.strategy]) if i]
        own = check_metadata_target(own_url, target_url, task.target_table)
        plan.issues += [own] if own else []
    except Exception as e:  # a plan that cannot be made is an issue like any other
        plan.issues.append(Issue(Level.ERROR, "PREFLIGHT_FAILED", str(e)[:500]))
    return plan


def _say(plan: SyncPlan, level: Level, code: str, message: str, hint: str = "") -> None:
    plan.issues.append(Issue(level, code, message, hint))


def _basics(plan: SyncPlan, target_kind: str) -> None:
    task = plan.task
    names = [("target table", task.target_table), ("incremental column", task.incr_column), ("order column", task.order_column)]
    names += [("source table", task.source_table)] if not task.source_sql else []
    names += [x for m in task.mappings for x in (("source column", m.source), ("target column", m.target))]
    for what, name in names:
        if name and not is_identifier(name):
            _say(plan, Level.ERROR, "IDENTIFIER_INVALID", f"{what} {name!r} is no identifier")
    if task.batch_size > task.page_size:
        _say(plan, Level.WARN, "CONFIG_INVALID", "a batch is larger than a page")
    if task.source_sql and (issue := check_sql(task.source_sql)):
        plan.issues.append(issue)
    if plan.source is None:
        _say(plan, Level.ERROR, "CUSTOM_SQL_INVALID" if task.source_sql else "SRC_TABLE_MISSING", "the source has no columns")
    if plan.target is None:
        _say(plan, Level.ERROR, "DST_TABLE_MISSING", "the target table does not exist")
    if not plan.incremental and task.strategy == Strategy.SWAP:
        if target_kind not in ("MYSQL", "PARQUET"):
            _say(plan, Level.ERROR, "STRATEGY_UNSUPPORTED", f"{target_kind} targets cannot be swapped")
        elif len(task.target_table.rsplit(".", 1)[-1]) > LONG_NAME:
            _say(plan, Level.WARN, "STRATEGY_UNSUPPORTED", "the target's name is long for a staging name")


def _columns(plan: SyncPlan) -> None:
    source, target, seen = plan.source, plan.target, set()
    mappings = plan.task.mappings or [FieldMapping(c.name, c.name) for c in target.columns if source.find(c.name)]
    for m in mappings:
        to, of = target.find(m.target), source.find(m.source) if m.source and m.source.strip() else None
        if to is None or m.source and of is None:
            _say(plan, Level.ERROR, "MAPPING_COLUMN_MISSING", f"{m.source} -> {m.target}: no such column")
            continue
        if of is None and m.default is None:
            _say(plan, Level.ERROR, "MAPPING_COLUMN_MISSING", f"{m.target} has neither a source column nor a constant")
            continue
        if to.name.lower() in seen:  # the first mapping of a target counts
            continue
        if of is not None:
            level, why = compatibility(of, to)
            if level:
                _say(plan, level, "TYPE_INCOMPATIBLE", f"{of.name} {of.sql_type} -> {to.name} {to.sql_type}: {why}")
            if level == Level.ERROR and not plan.task.mappings:
                continue
        seen.add(to.name.lower())
        plan.written.append(Written(to, of, None if of else m.default))
    if not plan.written:
        _say(plan, Level.ERROR, "NO_TARGET_COLUMNS", "no column of the target can be filled")


def _keys(plan: SyncPlan) -> None:
    said = [m.target for m in plan.task.mappings if m.primary_key]
    keys = said or list(plan.target.first_key())
    if not keys:
        _say(plan, Level.ERROR if plan.incremental else Level.WARN, "PK_MISSING", "the target has no key" + ("" if plan.incremental else "; rows are inserted and may repeat"))
        return
    have = {w.target.name.lower() for w in plan.written}
    for k in keys:
        if k.lower() not in have:
            _say(plan, Level.ERROR, "MAPPING_COLUMN_MISSING", f"key column {k} is not written")
    plan.keys = [plan.target.find(k).name if plan.target.find(k) else k for k in keys]


def _cursor(plan: SyncPlan) -> None:
    name = plan.task.incr_column
    if not name:
        if plan.incremental:
            _say(plan, Level.WARN, "INCR_COLUMN_MISSING", "no incremental column: every run reads everything")
        return
    column = plan.source.find(name)
    if column is None:
        _say(plan, Level.ERROR, "INCR_COLUMN_MISSING", f"the source has no column {name}")
        return
    if not is_watermark(column):
        _say(plan, Level.ERROR, "INCR_COLUMN_NOT_SORTABLE", f"{column.name} {column.sql_type} has no order that new rows follow")
        return
    if plan.task.incr.safety_lag_seconds and not is_timestamp_cursor(column):
        _say(plan, Level.WARN, "CONFIG_INVALID", "a safety lag means nothing for numbers")
    if not plan.task.source_sql and column.name.lower() not in {c.lower() for c in plan.source.indexed}:
        _say(plan, Level.WARN, "INCR_COLUMN_NO_INDEX", f"{column.name} leads no index or sort order of the source")
    plan.incr = column


def _order(plan: SyncPlan) -> None:
    task, source = plan.task, plan.source
    order = source.find(task.order_column)
    if task.order_column and order is None:
        _say(plan, Level.ERROR, "SORT_KEY_MISSING", f"the source has no column {task.order_column}")
        return
    keys = [c.name for c in (plan.incr, order) if c]
    if task.source_sql:  # what a statement returns declares no key: the order column is taken to be unique
        if order is None and not source.first_key():
            _say(plan, Level.ERROR, "SORT_KEY_MISSING", "a statement needs an order column")
            return
        keys += [] if order else list(source.first_key())
    else:
        keys += list(source.first_key())
    keys = _once(keys)
    if not keys:
        _say(plan, Level.ERROR, "SORT_KEY_MISSING", "the source has no key and no order column")
        return
    have = {k.lower() for k in keys}
    unique = [source.primary_key, *source.unique_keys]
    if not task.source_sql and not any(u and {c.lower() for c in u} <= have for u in unique):
        _say(plan, Level.ERROR, "ORDER_KEY_NOT_UNIQUE", f"{', '.join(keys)} do not tell rows apart")
        return
    plan.order_keys = keys
