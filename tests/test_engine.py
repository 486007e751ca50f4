"""Conversions, merges, runs, versioned tables, state and connectors on small tables."""

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.convert import convert
from tidemark.model import ColumnSpec, ErrorPolicy, FieldMapping, IncrPolicy, SyncTask, TableSpec
from tidemark.operators import keyset, merge, reconcile
from tidemark.plans.engine import run
from tidemark.runtime import Cancellation
from tidemark.sources.base import preview, read_sql, spec_from, sql_columns
from tidemark.sources.memory import MemoryTables
from tidemark.sources.parquet import ParquetTables
from tidemark.state import StateStore, TaskRunning
from tidemark.streaming.upsert import stream_upsert

NOW = dt.datetime(2026, 1, 1, 12)


def col(name, kind, nullable=True, length=0, scale=0):
    return ColumnSpec(name, kind, nullable, length, scale)


CASES = [
    ("VARCHAR", "string", col("t", "INT"), [("2.5", 3), ("-2.5", -3), ("1e3", 1000), ("", "bad"), ("abc", "bad"), ("NaN", "bad"), ("3000000000", "bad"), (" 7 ", 7), (None, None)]),
    ("VARCHAR", "string", col("t", "BIGINT"), [("9007199254740993", 9007199254740993), ("1.5f", "bad")]),
    ("VARCHAR", "string", col("t", "DECIMAL", True, 6, 2), [("1.005", Decimal("1.01")), ("99999", "bad"), ("-0.005", Decimal("-0.01"))]),
    ("VARCHAR", "string", col("t", "DOUBLE"), [("1.25", 1.25), ("Infinity", "bad"), (".5", 0.5)]),
    ("VARCHAR", "string", col("t", "BOOLEAN"), [("YES", True), ("off", False), ("", False), ("perhaps", "bad")]),
    ("VARCHAR", "string", col("t", "VARCHAR", True, 3), [("abc", "abc"), ("abcd", "bad"), ("中文字", "中文字")]),
    ("VARCHAR", "string", col("t", "DATETIME"), [("2024-01-02 03:04:05.5", dt.datetime(2024, 1, 2, 3, 4, 5, 500000)), ("2024-01-02T03:04:05+08:00", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-1-1", "bad"), ("2024-01-02", dt.datetime(2024, 1, 2)), ("0000-00-00 00:00:00", "bad")]),
    ("VARCHAR", "string", col("t", "DATE"), [("2024-01-02 23:00:00", dt.date(2024, 1, 2)), ("x", "bad")]),
    ("VARCHAR", "string", col("t", "VARBINARY", True, 2), [("ab", b"ab"), ("abc", "bad")]),
    ("BOOLEAN", "boolean", col("t", "VARCHAR"), [(True, "1"), (False, "0")]),
    ("BOOLEAN", "boolean", col("t", "INT"), [(True, 1)]),
    ("DOUBLE", "double", col("t", "INT"), [(2.5, 3), (-0.5, -1), (float("nan"), "bad"), (1e12, "bad")]),
    ("DOUBLE", "double", col("t", "BIGINT"), [(2.49999999999, 2), (0.49999999999999994, 0), (-2.5, -3), (1e19, "bad"), (float("inf"), "bad")]),
    ("DECIMAL", "decimal(38,20)", ColumnSpec("t", "INT"), [(Decimal("2.49999999999999999999"), 2), (Decimal("2.5"), 3), (Decimal("3000000000"), "bad")]),
    ("VARCHAR", "string", col("t", "SMALLINT"), [("2.49999999999999999999999", 2), ("-2.5000", -3), (".5", 1), ("2.", 2), ("25e-1", 3), ("32768", "bad"), ("1e99", "bad")]),
    ("VARCHAR", "string", col("t", "TIME"), [("25:61", "bad"), ("23:59:60", "bad"), ("07:08", "07:08"), ("2024-01-01 10:00:00", "10:00:00.000000"), ("2024-01-01", "00:00:00.000000"), ("x", "bad"), (None, None)]),
    ("VARBINARY", "binary", col("t", "BOOLEAN"), [(b"\x01", True), (b"\x00", False), (b"", False), (b"1", True), (b"ab", "bad"), (None, None)]),
    ("YEAR", "int", col("t", "BOOLEAN"), [(2024, True), (0, False)]),
    ("BOOLEAN", "boolean", col("t", "BLOB"), [(True, b"\x01"), (False, b"\x00"), (None, None)]),
    ("INT", "int", col("t", "BLOB"), [(12, b"12")]),
    ("DECIMAL", "decimal(20,6)", col("t", "DECIMAL"), [(Decimal("1.234567"), Decimal("1.234567"))]),
    ("INT", "int", col("t", "TINYINT UNSIGNED"), [(200, 200), (256, "bad"), (-1, "bad")]),
    ("VARCHAR", "string", col("t", "BIGINT UNSIGNED"), [("18446744073709551615", Decimal("18446744073709551615")), ("18446744073709551616", "bad")]),
    ("BIT", "binary", col("t", "BIT", True, 8), [(b"\x05", b"\x05"), (b"\x05\x05", "bad")]),
    ("INT", "int", col("t", "TINYINT"), [(127, 127), (128, "bad")]),
    ("INT", "int", col("t", "BOOLEAN"), [(0, False), (7, True)]),
    ("YEAR", "int", col("t", "DATE"), [(2024, dt.date(2024, 1, 1))]),
    ("DATETIME", "timestamp_ntz", col("t", "YEAR"), [(dt.datetime(2024, 5, 6), 2024)]),
    ("DATETIME", "timestamp_ntz", col("t", "DATE"), [(dt.datetime(2024, 5, 6, 7), dt.date(2024, 5, 6))]),
    ("DATETIME", "timestamp_ntz", col("t", "TIME"), [(dt.datetime(2024, 5, 6, 7, 8, 9, 10), "07:08:09.000010")]),
    ("BLOB", "binary", col("t", "TEXT"), [(b"ab", "ab"), (b"\xff", "bad")]),
    ("BLOB", "binary", col("t", "VARBINARY", True, 4), [(b"abcd", b"abcd"), (b"abcde", "bad")]),
]


@pytest.mark.parametrize("kind,spark_kind,target,pairs", CASES)
def test_conversions(spark, kind, spark_kind, target, pairs):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], f"i int, x {spark_kind}")
    new, bad = convert(F.col("x"), col("x", kind, True, 8 if kind == "BIT" else 0), target)
    got = {r["i"]: "bad" if r["bad"] else r["y"] for r in df.select("i", new.alias("y"), bad.alias("bad")).collect()}
    assert got == {i: bytes(w) if isinstance(w, bytes) else w for i, (_, w) in enumerate(pairs)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=12, unique=True), st.integers(0, 12))
def test_keyset_pages_are_slices_of_the_order(spark, rows, at):
    df, ordered = spark.createDataFrame(rows, "a int, b int"), sorted(rows)
    after = ordered[min(at, len(ordered) - 1)]
    assert [tuple(r) for r in keyset.keyset_page(df, ["a", "b"], 5, after).collect()] == [r for r in ordered if r > after][:5]


def test_pages(spark):
    df = spark.range(25).withColumn("k", F.col("id") % 5)
    assert [[r["id"] for r in p] for p in keyset.iter_pages(df, ["k", "id"], 10)][0] == [0, 5, 10, 15, 20, 1, 6, 11, 16, 21]
    assert sum(len(p) for p in keyset.iter_pages(df, ["id"], 7)) == 25
    with pytest.raises(ValueError):
        keyset.keyset_page(df, [], 5)
    with pytest.raises(ValueError):
        keyset.keyset_predicate(["a"], [1, 2])
    with pytest.raises(ValueError):
        list(keyset.iter_pages(spark.createDataFrame([(None,), (1,)], "k int"), ["k"], 2))


def test_merge(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, v string, w string")
    rows = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1), (None, "m", 1)], "k int, v string, o int")
    got = merge.merge(target, rows, ["k"], ["o"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", "x"), (2, "new", "y"), (3, "c", None), (None, "n", "z"), (None, "m", None)], key=str)
    again = merge.merge(got.where("k is not null"), rows.where("k is not null"), ["k"], ["o"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.where("k is not null").collect()))
    with pytest.raises(ValueError):
        merge.merge(target, rows, ["nope"])


def test_reconcile(spark):
    a = spark.createDataFrame([(1, None, b"x"), (2, "b", None), (2, "b", None)], "k int, v string, b binary")
    assert reconcile.table_digest(a).first() == reconcile.table_digest(a.orderBy(F.desc("k"))).first()
    assert reconcile.table_digest(a).first() != reconcile.table_digest(a.dropDuplicates()).first()
    assert reconcile.table_digest(a.limit(0)).first()["rows"] == 0
    assert [tuple(r) for r in reconcile.duplicate_keys(a, ["k"]).collect()] == [(2, 2)]


SRC = TableSpec((col("id", "BIGINT", False), col("name", "VARCHAR", True, 20), col("at", "DATETIME")), ("id",), indexed=("at",))
DST = TableSpec((col("id", "BIGINT", False), col("name", "VARCHAR", False, 20), col("at", "DATETIME")), ("id",))


def rows(spark, data):
    return spark.createDataFrame(data, "id long, name string, at timestamp_ntz")


def at(minutes):
    return NOW - dt.timedelta(minutes=minutes)


def test_bad_rows(spark):
    src = rows(spark, [(i, None if i == 5 else f"n{i}", at(i)) for i in range(1, 8)])
    tables = MemoryTables(s=src)
    for policy, status, written in ((ErrorPolicy(), "FAILED", 0), (ErrorPolicy(skip_bad_rows=True), "COMPLETED", 6), (ErrorPolicy(skip_bad_rows=True, max_skip_rows=0), "FAILED", 0)):
        target = MemoryTables(t=rows(spark, [(99, "old", at(0))]))
        r = run(spark, SyncTask(1, "t", "s", mode="INCR", incr_column="at", errors=policy), tables, target, source_spec=SRC, target_spec=DST, now=NOW)
        assert (r.status, r.written_rows, r.skipped_rows) == (status, written, 1), r.message
        assert r.errors[0]["phase"] == "WRITE" and r.errors[0]["row_key"] == "id=5" and '"name":null' in r.errors[0]["row_data"]
        assert target.read("t").count() == 1 + written
        assert (r.end_cursor is not None) == (status == "COMPLETED")


def test_null_cursor_and_length_are_map_errors(spark):
    src = rows(spark, [(1, "ok", at(1)), (2, "ok", None), (3, "x" * 21, at(2))])
    task = SyncTask(1, "t", "s", mode="FULL", incr_column="at", errors=ErrorPolicy(skip_bad_rows=True))
    target = MemoryTables(t=rows(spark, []))
    r = run(spark, task, MemoryTables(s=src), target, source_spec=SRC, target_spec=DST, now=NOW)
    assert (r.status, r.written_rows) == ("COMPLETED", 1), r.message
    assert sorted((e["phase"], e["row_key"]) for e in r.errors) == [("MAP", "id=2"), ("MAP", "id=3")]
    assert r.end_cursor == "2026-01-01 11:59:00|1"


def test_incremental_runs_neither_lose_nor_repeat(spark):
    data = [(1, "a", at(120)), (2, "b", at(90)), (3, "c", at(0)), (4, "d", at(0))]
    tables, target = MemoryTables(s=rows(spark, data)), MemoryTables(t=rows(spark, []))
    task = dict(mode="INCR", incr_column="at", incr=IncrPolicy(3600))
    go = lambda cursor, now: run(spark, SyncTask(1, "t", "s", cursor=cursor, **task), tables, target, source_spec=SRC, target_spec=DST, now=now)
    first = go(None, NOW)
    assert (first.written_rows, first.end_cursor) == (2, "2026-01-01 10:30:00|2")
    second = go(first.end_cursor, NOW + dt.timedelta(hours=2))
    assert (second.written_rows, second.end_cursor) == (2, "2026-01-01 12:00:00|4")
    third = go(second.end_cursor, NOW + dt.timedelta(hours=3))
    assert (third.status, third.written_rows, third.end_cursor) == ("COMPLETED", 0, None)
    assert target.read("t").count() == 4
    back = run(spark, SyncTask(1, "t", "s", mode="INCR", incr_column="at", cursor="2026-01-01 10:30:00|2", incr=IncrPolicy(0, 600)), tables, target, source_spec=SRC, target_spec=DST, now=at(60))
    assert back.written_rows == 1


def test_dry_runs_and_preflight_touch_nothing(spark):
    tables, target = MemoryTables(s=rows(spark, [(1, "a", at(1))])), MemoryTables(t=rows(spark, [(9, "z", at(9))]))
    r = run(spark, SyncTask(1, "t", "s", mode="FULL", dry_run=True), tables, target, source_spec=SRC, target_spec=DST)
    assert (r.status, r.read_rows, r.written_rows, r.end_cursor) == ("COMPLETED", 1, 0, None)
    hard = TableSpec((col("id", "BIGINT"), col("at", "BIGINT")), ("id",))
    r = run(spark, SyncTask(1, "t", "s", mode="FULL", mappings=(FieldMapping("id", "id"), FieldMapping("at", "at"))), tables, target, source_spec=SRC, target_spec=hard)
    assert r.status == "FAILED" and "TYPE_INCOMPATIBLE" in r.message and target.read("t").first()["id"] == 9
    stop = Cancellation(spark)
    stop.cancel(1)
    assert run(spark, SyncTask(1, "t", "s", mode="FULL"), tables, target, source_spec=SRC, target_spec=DST, cancellation=stop).status == "CANCELLED"


def test_statements(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").createOrReplaceTempView("told")
    assert [c["name"] for c in sql_columns(spark, "select id, v as w from told")] == ["id", "w"]
    assert preview(spark, "select * from told", 1).count() == 1
    with pytest.raises(ValueError):
        read_sql(spark, "drop view told")
    target = MemoryTables(t=spark.createDataFrame([], "id int, v string"))
    r = run(spark, SyncTask(1, "t", source_sql="select id, v from told where id > 1", mode="FULL", order_column="id"), None, target, target_spec=TableSpec((col("id", "INT"), col("v", "TEXT")), ("id",)))
    assert r.status == "COMPLETED" and [tuple(x) for x in target.read("t").collect()] == [(2, "b")], r.message


def test_versioned_tables_and_state(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    store = ParquetTables(spark, f"{root}/data")
    store.create("t", rows(spark, [(1, "a", at(5))]))
    assert store.exists("t") and store.tables() == ["t"] and not store.exists("u")
    store.upsert("t", rows(spark, [(1, "b", at(4)), (2, "c", at(3))]), ["id"], ["at"])
    assert sorted((r["id"], r["name"]) for r in store.read("t").collect()) == [(1, "b"), (2, "c")]
    with pytest.raises(RuntimeError):
        store.replace("t", rows(spark, []), base=1)
    state = StateStore(spark, f"{root}/state")
    source = MemoryTables(s=rows(spark, [(i, f"n{i}", at(60 - i)) for i in range(1, 6)]))
    task = SyncTask(7, "t", "s", mode="INCR", incr_column="at")
    r = state.run(task, source, store, NOW, source_spec=SRC, target_spec=DST)
    assert (r.status, r.written_rows) == ("COMPLETED", 5), r.message
    assert state.cursor(7) == r.end_cursor == "2026-01-01 11:05:00|5"
    again = state.run(task, source, store, NOW, source_spec=SRC, target_spec=DST)
    assert (again.written_rows, again.end_cursor, state.cursor(7)) == (0, None, r.end_cursor)
    assert store.read("t").count() == 5
    state.begin(8, NOW)
    with pytest.raises(TaskRunning):
        state.begin(8, NOW)
    assert state.recover(NOW) == 1 and state.begin(8, NOW) == 4
    state.clean(NOW + dt.timedelta(days=60))
    assert [r["status"] for r in state.records().collect()] == ["RUNNING"]


def test_database_tables(spark):
    from tidemark.sources.jdbc import JdbcTables

    db = JdbcTables(spark, f"jdbc:derby:{tempfile.mkdtemp(dir='/tmp')}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    db.execute('CREATE TABLE "T" ("ID" INT NOT NULL PRIMARY KEY, "V" VARCHAR(20), "W" VARCHAR(20))', 'CREATE INDEX "IV" ON "T" ("V")', "INSERT INTO \"T\" VALUES (1, 'a', 'x')")
    assert db.exists("T") and db.reachable() is None and db.kind == "DERBY"
    assert db.keys("T") == (["ID"], [], ["ID", "V"]) or db.keys("T")[0] == ["ID"]
    db.upsert("T", spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "ID int, V string, o int"), ["ID"], ["o"])
    assert sorted(map(tuple, db.read("T").collect())) == [(1, "c", "x"), (2, "d", None)]
    db.replace("T", spark.createDataFrame([(5, "e", "f")], "ID int, V string, W string"))
    assert [tuple(r) for r in db.query('SELECT MAX("ID") AS M FROM "T"').collect()] == [(5,)]
    db.append("T", spark.createDataFrame([(6, "g", "h")], "ID int, V string, W string"))
    assert db.read("T").count() == 2 and not any("DS_STAGE" in x for x in db.tables())


def test_streams(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    store = ParquetTables(spark, f"{root}/data")
    store.create("t", rows(spark, [(1, "a", at(5))]))
    for i in range(2):
        rows(spark, [(1, f"b{i}", at(4 - i)), (2 + i, "c", at(3))]).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("id long, name string, at timestamp_ntz").parquet(f"{root}/in")
        stream_upsert(stream, store, "t", ["id"], ["at"], f"{root}/check").awaitTermination(120)
    assert sorted((r["id"], r["name"]) for r in store.read("t").collect()) == [(1, "b1"), (2, "c"), (3, "c")]


def test_merge_of_columns_with_any_name(spark):
    target = spark.createDataFrame([(1, "a", "x", 0)], "`k.1` int, name string, s_name string, hit int")
    rows = spark.createDataFrame([(1, "b", "y", 5), (2, "c", None, 6)], "`k.1` int, name string, s_name string, kt0 int")
    assert sorted(map(tuple, merge.merge(target, rows, ["k.1"], ["kt0"]).collect())) == [(1, "b", "y", 0), (2, "c", None, None)]


def test_merge_under_a_collation(spark):
    target = spark.createDataFrame([("Ab", 1), ("c", 2)], "k string, v int")
    rows = spark.createDataFrame([("aB", 5, 1), ("AB", 6, 2), ("C ", 7, 1)], "k string, v int, o int")
    assert sorted(map(tuple, merge.merge(target, rows, ["k"], ["o"], "UTF8_LCASE").collect())) == [("AB", 6), ("C ", 7), ("c", 2)]
    assert sorted(map(tuple, merge.merge(target, rows, ["k"], ["o"]).collect())) == [("AB", 6), ("Ab", 1), ("C ", 7), ("aB", 5), ("c", 2)]


def test_upserts_rewrite_only_the_files_they_touch(spark):
    store = ParquetTables(spark, tempfile.mkdtemp(dir="/tmp"), keep=2, keep_seconds=0)
    store.create("t", spark.range(0, 1000, 1, 8).select("id", F.lit("old").alias("v")))
    before = store.files("t")
    assert len(before) == 8
    store.upsert("t", spark.createDataFrame([(3, "new"), (5, "new"), (5000, "new")], "id long, v string"), ["id"], [])
    after = store.files("t")
    assert len(set(before) & set(after)) == len(before) - 1
    assert sorted(r["id"] for r in store.read("t").where("v = 'new'").collect()) == [3, 5, 5000] and store.read("t").count() == 1001
    assert store.read("t", 1).where("v = 'new'").count() == 0
    store.append("t", spark.createDataFrame([(7, "again")], "id long, v string"))
    assert set(after) < set(store.files("t")) and store.read("t").count() == 1002
    store.compact("t", ["id"])
    store.compact("t", ["id"])
    assert store.read("t").count() == 1002 and len(store._versions("t")) == 2


def test_a_writer_that_dies_blocks_nobody(spark, monkeypatch):
    from tidemark.sources import parquet

    store = ParquetTables(spark, tempfile.mkdtemp(dir="/tmp"))
    store.create("t", spark.range(3))
    store._fs().create(store._path("t", "p2"), False).close()  # it died before it wrote the list
    spark.range(9).write.parquet(f"{store.root}/t/v2-dead")
    with pytest.raises(parquet.Conflict):
        store.replace("t", spark.range(5))
    monkeypatch.setattr(parquet, "GRACE_SECONDS", 0)
    assert store.replace("t", spark.range(5)) == 3 and store.read("t").count() == 5
    assert store.sweep("t") == 0 and store.sweep("t", 0) == 1 and store.read("t", 1).count() == 3


def test_tasks_that_end_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    state = StateStore(spark, tempfile.mkdtemp(dir="/tmp"))
    source = MemoryTables(s=rows(spark, [(i, f"n{i}", at(60 - i)) for i in range(1, 4)]))
    tasks = [SyncTask(i, "t", "s", mode="INCR", incr_column="at") for i in range(1, 5)]
    go = lambda task: state.run(task, source, MemoryTables(t=rows(spark, [])), NOW, source_spec=SRC, target_spec=DST)
    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(go, tasks))
    assert all(r.status == "COMPLETED" for r in results), [r.message for r in results]
    kept = state.records().collect()
    assert sorted(r["id"] for r in kept) == [1, 2, 3, 4] and {r["status"] for r in kept} == {"COMPLETED"}
    assert all(state.cursor(i) == "2026-01-01 11:03:00|3" for i in range(1, 5))


def test_a_start_that_fails_gives_its_lock_back(spark, monkeypatch):
    state = StateStore(spark, tempfile.mkdtemp(dir="/tmp"))
    with monkeypatch.context() as m:
        m.setattr(state, "_append", lambda *_: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            state.begin(1, NOW)
    assert state.begin(1, NOW) == 1
    assert state.shutdown(Cancellation(spark), NOW, wait_seconds=0) == 1
    assert [r["status"] for r in state.records().collect()] == ["CANCELLED"] and state.begin(1, NOW) == 2


def test_database_runs(spark):
    from tidemark.model import Strategy
    from tidemark.sources.jdbc import JdbcTables

    db = JdbcTables(spark, f"jdbc:derby:{tempfile.mkdtemp(dir='/tmp')}/db;create=true", connections=3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    values = ", ".join(f"({i}, 'v{i}')" for i in range(1, 31))
    db.execute('CREATE TABLE "S" ("ID" INT NOT NULL PRIMARY KEY, "V" VARCHAR(20))', f'INSERT INTO "S" VALUES {values}', 'CREATE TABLE "D" ("ID" INT NOT NULL PRIMARY KEY, "V" VARCHAR(20))')
    assert db.read("S", "ID").rdd.getNumPartitions() == 3 and db.read("S", "ID").count() == 30 and db.read("D", "ID").count() == 0
    spec = TableSpec((col("ID", "INT", False), col("V", "VARCHAR", True, 20)), ("ID",))
    for n, strategy in enumerate(Strategy):
        db.execute("INSERT INTO \"D\" VALUES (99, 'old')")
        task = SyncTask(1, "D", mode="FULL", strategy=strategy, order_column="ID", source_sql=f'SELECT "ID", UPPER("V") AS "V" FROM "S" WHERE "ID" > {n}')
        r = run(spark, task, db, db, source_spec=spec, target_spec=spec)
        if strategy == "SWAP":  # told by preflight: only MySQL swaps; the statements themselves work here too
            assert r.status == "FAILED" and "STRATEGY_UNSUPPORTED" in r.message
            db.replace("D", db.query('SELECT "ID", UPPER("V") AS "V" FROM "S" WHERE "ID" > 2'), strategy)
        else:
            assert (r.status, r.read_rows) == ("COMPLETED", 30 - n), r.message
        assert sorted(map(tuple, db.read("D").collect())) == sorted((i, f"V{i}") for i in range(n + 1, 31))
    assert not any(x.startswith("DS_") for x in db.tables())
    with pytest.raises(ValueError):
        db.query('DELETE FROM "D"')
