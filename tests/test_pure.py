"""What needs no session: cursors, guards, identifiers, compatibility, retries."""

import datetime as dt
import string
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark import runtime
from tidemark.functions.types import base_name, compatibility, map_type_name
from tidemark.model import ColumnSpec, FieldMapping, IncrPolicy, SyncTask, TableRef, TableSpec, scrub
from tidemark.operators.cursor import decode, encode, look_back, read_window, typed
from tidemark.plans.guard import check_grants, check_metadata_target, check_sql, is_identifier, quote
from tidemark.plans.resolve import resolve
from tidemark.sources.base import database_kind
from tidemark.sources.dialect import dialect_of, jdbc_url


def col(name, kind, nullable=True, length=0, scale=0):
    return ColumnSpec(name, kind, nullable, length, scale)


@given(st.lists(st.text(string.ascii_letters + "|\\[ 中", max_size=6), min_size=2, max_size=4))
def test_cursor_parts_come_back(parts):
    assert decode(encode(parts)) == parts


def test_cursor_text_and_types():
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 120000)
    assert encode([at, 7]) == "2024-01-02 03:04:05.12|7"
    assert typed("2024-01-02 03:04:05.12", col("ts", "DATETIME")) == at
    assert typed("2024-01-02", col("d", "DATE")) == dt.date(2024, 1, 2)
    assert typed("12.50", col("n", "DECIMAL")) == Decimal("12.50")
    assert typed("junk", col("n", "INT")) == "junk"
    assert decode('["a","b|c"]') == ["a", "b|c"]
    assert decode(None) == decode("  ") == []


def test_read_window_rules():
    ts, key = col("ts", "DATETIME"), col("id", "BIGINT")
    upper = dt.datetime(2024, 1, 10)
    first = read_window(None, ts, [key], IncrPolicy(), upper)
    assert (first.lower, first.position) == (None, None)
    resumed = read_window("2024-01-05 00:00:00|9", ts, [key], IncrPolicy(), upper)
    assert resumed.position == (dt.datetime(2024, 1, 5), 9) and resumed.lower is None
    back = read_window("2024-01-05 00:00:00|9", ts, [key], IncrPolicy(0, 60), upper)
    assert back.lower == dt.datetime(2024, 1, 4, 23, 59) and back.position is None
    assert read_window("100", key, [], IncrPolicy(0, 5), 200).lower == 95
    assert look_back(dt.date(2024, 1, 5), col("d", "DATE"), 3600) == dt.date(2024, 1, 4)


@pytest.mark.parametrize("sql", ["select 1", " WITH a AS (select 1) select * from a;", "select 'drop table x' from t", "select `update` from t -- delete", "/* insert */ select 1"])
def test_reading_statements_pass(sql):
    assert check_sql(sql) is None


@pytest.mark.parametrize("sql", ["", "update t set a=1", "select 1; select 2", "select * into outfile 'x' from t", "with a as (select 1) delete from a", "call p()", "select load_file('x')"])
def test_writing_statements_do_not(sql):
    assert check_sql(sql).code == "CUSTOM_SQL_INVALID"


def test_identifiers():
    assert is_identifier("db.t_1") and is_identifier("中文表_订单") and is_identifier("order") and is_identifier("a.b.c")
    assert not any(map(is_identifier, ["", " a", "a b", "a.b.c.d", "a;b", "a`b", None]))
    assert quote("db.order") == "`db`.`order`"
    assert TableRef.parse("a.b.c") == TableRef("c", "b")


def test_metadata_targets_and_grants():
    own = "jdbc:mysql://h:3306/meta?x=1"
    assert check_metadata_target(own, "jdbc:mysql://H:3306/meta", "sync_task").level == "ERROR"
    assert check_metadata_target(own, "jdbc:mysql://h:3306/meta", "orders").level == "WARN"
    assert check_metadata_target(own, "jdbc:mysql://h:3307/meta", "sync_task") is None
    assert check_grants(["GRANT SELECT, DROP ON `a`.* TO `u`@`%`"], "drop", "a") is None
    assert check_grants(["GRANT SELECT ON `a`.* TO `u`@`%`"], "DROP", "a").code == "PERMISSION_DENIED"
    assert check_grants(["who knows"], "DROP", "a") is None


def test_compatibility():
    assert compatibility(col("a", "VARCHAR", length=50), col("b", "VARCHAR", length=20))[0] == "WARN"
    assert compatibility(col("a", "DATETIME"), col("b", "BIGINT"))[0] == "ERROR"
    assert compatibility(col("a", "TEXT"), col("b", "INT"))[0] == "ERROR"
    assert compatibility(col("a", "VARCHAR"), col("b", "INT"))[0] == "WARN"
    assert compatibility(col("a", "BLOB"), col("b", "BIGINT"))[0] == "ERROR"
    assert compatibility(col("a", "DECIMAL", length=38, scale=10), col("b", "VARCHAR", length=10))[0] is None
    assert compatibility(col("a", "YEAR"), col("b", "INT"))[0] is None
    assert compatibility(col("a", "BIGINT"), col("b", "INT"))[0] == "WARN"
    assert compatibility(col("a", "INT"), col("b", "DATETIME"))[0] == "ERROR"
    assert compatibility(col("a", "DATETIME"), col("b", "BOOLEAN"))[0] == "ERROR"
    assert base_name("int(11) unsigned") == "INT" and map_type_name("LONGTEXT", "DM8") == "CLOB" and map_type_name("JSON") == "JSON"


def test_retries():
    assert runtime.backoff_ms(2000, 1) == 2000 and runtime.backoff_ms(2000, 4) == 16000 and runtime.backoff_ms(2000, 99) == 60000
    assert runtime.retryable_state("40001") and runtime.retryable_state(None, 1213) and not runtime.retryable_state("23000", 1213)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert runtime.with_retries(flaky, SyncTask(1, "t", "s").errors, lambda _: None) == "done"


def test_task_validation_and_scrubbing():
    with pytest.raises(ValueError):
        SyncTask(1, "", "s")
    with pytest.raises(ValueError):
        SyncTask(1, "t")
    with pytest.raises(ValueError):
        SyncTask(1, "t", "s", incr=IncrPolicy(-1))
    assert scrub("url password=abc x") == "url password=*** x"


KEYED = TableSpec((col("id", "BIGINT", False), col("v", "VARCHAR"), col("u", "DATETIME")), ("id",), indexed=("u",))
BARE = TableSpec(KEYED.columns)


def codes(task, source, target, **more):
    return [(str(i.level), i.code) for i in resolve(task, source, target, **more).issues]


def test_preflight_codes():
    incr = dict(mode="INCR", incr_column="u")
    assert codes(SyncTask(1, "t", "s", **incr), KEYED, KEYED) == []
    assert ("ERROR", "PK_MISSING") in codes(SyncTask(1, "t", "s", **incr), KEYED, BARE)
    assert ("WARN", "PK_MISSING") in codes(SyncTask(1, "t", "s", mode="FULL"), KEYED, BARE)
    assert ("ERROR", "SORT_KEY_MISSING") in codes(SyncTask(1, "t", "s", mode="FULL"), BARE, KEYED)
    assert ("ERROR", "ORDER_KEY_NOT_UNIQUE") in codes(SyncTask(1, "t", "s", mode="FULL", order_column="v"), BARE, KEYED)
    assert ("ERROR", "INCR_COLUMN_NOT_SORTABLE") in codes(SyncTask(1, "t", "s", mode="INCR", incr_column="v"), KEYED, KEYED)
    assert ("ERROR", "INCR_COLUMN_MISSING") in codes(SyncTask(1, "t", "s", mode="INCR", incr_column="x"), KEYED, KEYED)
    assert ("WARN", "INCR_COLUMN_MISSING") in codes(SyncTask(1, "t", "s", mode="INCR"), KEYED, KEYED)
    assert ("ERROR", "SRC_TABLE_MISSING") in codes(SyncTask(1, "t", "s"), None, KEYED)
    assert ("ERROR", "DST_TABLE_MISSING") in codes(SyncTask(1, "t", "s"), KEYED, None)
    assert ("ERROR", "IDENTIFIER_INVALID") in codes(SyncTask(1, "t;x", "s"), KEYED, KEYED)
    assert ("ERROR", "CUSTOM_SQL_INVALID") in codes(SyncTask(1, "t", source_sql="drop table x"), KEYED, KEYED)
    assert ("ERROR", "STRATEGY_UNSUPPORTED") in codes(SyncTask(1, "t", "s", mode="FULL", strategy="SWAP"), KEYED, KEYED, target_kind="DM8")
    assert ("ERROR", "MAPPING_COLUMN_MISSING") in codes(SyncTask(1, "t", "s", mappings=(FieldMapping("id", "nope"),)), KEYED, KEYED)
    assert ("ERROR", "NO_TARGET_COLUMNS") in codes(SyncTask(1, "t", "s", mode="FULL"), TableSpec((col("a", "INT"),), ("a",)), TableSpec((col("b", "INT"),)))
    assert ("WARN", "INCR_COLUMN_NO_INDEX") in codes(SyncTask(1, "t", "s", **incr), TableSpec(KEYED.columns, ("id",)), KEYED)
    assert ("ERROR", "PERMISSION_DENIED") in codes(SyncTask(1, "t", "s", mode="FULL"), KEYED, KEYED, target_kind="MYSQL", grants=["GRANT SELECT ON `d`.* TO u"], database="d")
    assert ("ERROR", "TARGET_IS_METADATA") in codes(SyncTask(1, "sync_task", "s"), KEYED, KEYED, own_url="jdbc:mysql://h:1/m", target_url="jdbc:mysql://h:1/m")
    assert not resolve(SyncTask(1, "t", "s", mode="FULL_INCR", incr_column="u"), KEYED, KEYED).incremental
    assert resolve(SyncTask(1, "t", "s", mode="FULL_INCR", incr_column="u", cursor="2024-01-01 00:00:00|1"), KEYED, KEYED).incremental


def test_dialects():
    my, dm = dialect_of("MYSQL"), dialect_of("DM8")
    assert my.upsert_from("t", "s", ["id", "v"], ["id"]).endswith("ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)")
    assert my.upsert_from("t", "s", ["id"], ["ID"]).endswith("UPDATE `ID` = VALUES(`ID`)")
    assert "WHEN MATCHED" not in dm.upsert_from("t", "s", ["id"], ["id"]) and "WHEN MATCHED THEN UPDATE SET" in dm.upsert_from("t", "s", ["id", "v"], ["id"])
    assert my.insert("t", ["a", "b"], 2) == "INSERT INTO `t` (`a`, `b`) VALUES (?, ?), (?, ?)"
    assert my.rows_per_statement(60) == 1000 and len(my.swap("t", "s", "b")) == 1
    assert database_kind("MariaDB Server") == "MYSQL" and database_kind(None, "dm.jdbc.driver") == "DM8" and database_kind("Oracle") is None
    assert "serverTimezone=UTC" in jdbc_url("MYSQL", "h", 1, "d")
    with pytest.raises(ValueError):
        dialect_of("ORACLE")


def test_listener_and_bus():
    got = []
    a = runtime.AsyncListener(got.append, 4)
    for i in range(100):
        a(runtime.Progress("MAP", i))
    a.close()
    assert got[-1].read_rows == 99 and len(got) + a.dropped == 100
    bus, heard = runtime.EventBus(), []
    bus.subscribe(lambda m: 1 / 0)
    bus.subscribe(heard.append)
    bus.publish("x")
    assert heard == ["x"] and bus.count() == 2


def test_tasks_that_may_not_be_saved():
    from tidemark.model import SyncTask, check_task

    assert check_task(SyncTask(1, "t", "s", mode="FULL")).cursor is None
    assert SyncTask(1, "t", "s", incr_value="5").cursor == "5" and SyncTask(1, "t", "s", cursor=" ", incr_value=" ").cursor is None
    assert SyncTask(1, "t", "s", cursor="7", incr_value="5").cursor == "7"
    for wrong in (SyncTask(1, "t", "s", mode="INCR"), SyncTask(1, "t", "s"), SyncTask(1, "t", "s", mode="FULL_INCR", incr_column=" "), SyncTask(1, "t", "s", mode="FULL", batch_size=2000)):
        with pytest.raises(ValueError):
            check_task(wrong)
