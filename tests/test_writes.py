"""Rows that a database refuses, even parts of a read, files that an upsert spares, and the last row of a key."""

import datetime as dt
import random
import tempfile
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.convert import convert
from tidemark.model import ColumnSpec, ErrorPolicy, IncrPolicy, SyncTask, TableSpec
from tidemark.operators import merge
from tidemark.operators.cursor import ReadWindow
from tidemark.plans.engine import run
from tidemark.plans.guard import check_sql
from tidemark.sources.dialect import DIALECTS
from tidemark.sources.jdbc import JdbcTables, TooManyRejected
from tidemark.sources.memory import MemoryTables
from tidemark.sources.parquet import ParquetTables
from tidemark.state import LeaseLost, StateStore, TaskRunning


def col(name, kind, nullable=True, length=0):
    return ColumnSpec(name, kind, nullable, length)


@pytest.fixture
def db(spark):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark._jvm.java.lang.Class.forName(driver)
    return JdbcTables(spark, f"jdbc:derby:{tempfile.mkdtemp(dir='/tmp')}/db;create=true", connections=4, driver=driver)


def test_only_refused_rows_are_set_aside(spark, db):
    db.execute('CREATE TABLE "T" ("ID" INT NOT NULL PRIMARY KEY, "U" VARCHAR(20) UNIQUE, "V" VARCHAR(5), "N" INT NOT NULL)', "INSERT INTO \"T\" VALUES (900, 'taken', 'old', 1), (1, 'u1', 'old', 1)")
    data = [(i, f"u{i}", f"v{i}", i % 100) for i in range(1, 200)]
    data[6], data[50], data[120], data[150] = (7, "taken", "v7", 7), (51, "u51", "too long", 51), (121, "u121", "v121", None), (151, "u7x", "v151", 51)
    data.append((901, "u7x", "twin", 1))  # of two new rows with one unique key the first stays
    rows = spark.createDataFrame(data, "ID int, U string, V string, N int").repartition(3)
    source, spec = MemoryTables(s=rows), TableSpec((col("ID", "INT", False), col("U", "VARCHAR"), col("V", "VARCHAR"), col("N", "INT")), ("ID",))
    task = lambda most: SyncTask(1, "T", "s", mode="INCR", errors=ErrorPolicy(skip_bad_rows=most > 0, max_skip_rows=most, max_retries=0))
    before = sorted(map(tuple, db.read("T").collect()))
    for most in (0, 3):
        r = run(spark, task(most), source, db, source_spec=spec, target_spec=spec)
        assert r.status == "FAILED" and len(r.errors) == most + 1 and r.errors[0]["phase"] == "WRITE", (r.message, r.errors)
        assert sorted(map(tuple, db.read("T").collect())) == before  # nothing of a run that fails is written
    r = run(spark, task(4), source, db, source_spec=spec, target_spec=spec)
    assert (r.status, r.read_rows, r.written_rows, r.skipped_rows) == ("COMPLETED", 200, 196, 4), r.message
    twins = {e["row_key"] for e in r.errors} - {"ID=7", "ID=51", "ID=121"}
    assert len(r.errors) == 4 and twins < {"ID=151", "ID=901"} and len(twins) == 1
    assert {e["phase"] for e in r.errors} == {"WRITE"} and any('"V": "too long"' in e["row_data"] for e in r.errors)
    bad = {int(e["row_key"][3:]) for e in r.errors}
    assert sorted(map(tuple, db.read("T").collect())) == sorted([t for t in data if t[0] not in bad] + [(900, "taken", "old", 1)])
    assert not any(t.startswith("DS_") for t in db.tables())


def test_a_unique_key_that_moves_is_no_clash(spark, db):
    db.execute('CREATE TABLE "T" ("ID" INT NOT NULL PRIMARY KEY, "U" VARCHAR(20) UNIQUE, "V" VARCHAR(3))', "INSERT INTO \"T\" VALUES (1, 'a', 'x'), (2, 'b', 'y')")
    rows = spark.createDataFrame([(1, "c", "n"), (3, "a", "n"), (4, "d", "long")], "ID int, U string, V string").coalesce(1)
    refused = db.upsert("T", rows, ["ID"], [], most_rejected=1)
    assert [r.row["ID"] for r in refused] == ["4"]
    assert sorted(map(tuple, db.read("T").collect())) == [(1, "c", "n"), (2, "b", "y"), (3, "a", "n")]


def test_refreshes_set_rows_aside_too(spark, db):
    db.execute('CREATE TABLE "T" ("ID" INT NOT NULL PRIMARY KEY, "V" VARCHAR(3))', "INSERT INTO \"T\" VALUES (9, 'old')")
    rows = spark.createDataFrame([(1, "a"), (2, "long"), (3, "c"), (3, "d")], "ID int, V string").coalesce(1)
    with pytest.raises(TooManyRejected):
        db.replace("T", rows, most_rejected=1)
    assert [tuple(r) for r in db.read("T").collect()] == [(9, "old")]
    for strategy in ("DELETE", "TRUNCATE", "SWAP"):
        if strategy == "SWAP":  # Derby's copy of a table has no keys
            rows = rows.where("V <> 'd'")
        assert len(db.replace("T", rows, strategy, most_rejected=2)) == (1 if strategy == "SWAP" else 2)
        assert sorted(map(tuple, db.read("T").collect())) == [(1, "a"), (3, "c")]


def test_other_failures_are_not_searched(spark, db):
    db.execute('CREATE TABLE "T" ("ID" INT NOT NULL PRIMARY KEY)')
    with pytest.raises(Exception, match="NOPE|not a column|does not exist"):
        db.upsert("T", spark.createDataFrame([(1, 2)], "ID int, NOPE int"), ["ID"], [], most_rejected=10)


def test_text_keys(spark, db):
    db.execute('CREATE TABLE "T" ("K" VARCHAR(20) NOT NULL PRIMARY KEY, "V" CLOB)', "INSERT INTO \"T\" VALUES ('a', 'old'), ('b', 'kept')")
    long = "x" * 40_000
    db.upsert("T", spark.createDataFrame([("a", long), ("c", "new"), ("d", None)], "K string, V string"), ["K"], [])
    assert sorted(map(tuple, db.read("T").collect())) == [("a", long), ("b", "kept"), ("c", "new"), ("d", None)]
    db.execute('CREATE TABLE "W" ("K" VARCHAR(20) NOT NULL PRIMARY KEY, "V" VARCHAR(9))')
    assert [r.row for r in db.append("W", spark.createDataFrame([("a", None), ("b", "x"), (None, "y")], "K string, V string"), 1)] == [{"K": None, "V": "y"}]
    assert sorted(map(tuple, db.read("W", ["K"]).collect())) == [("a", None), ("b", "x")]


def parts(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_parts_are_even_for_any_key(spark, db):
    rng = random.Random(2)
    skewed = [rng.randrange(10_000) for _ in range(1980)] + [rng.randrange(10**6) for _ in range(20)]
    begin = dt.datetime(2026, 1, 1)
    data = [(i, k, f"{'it' + chr(39) + 's' if i % 9 else 'z'}{i:05d}", begin + dt.timedelta(seconds=i**2, microseconds=i), dt.date(2026, 1, 1) + dt.timedelta(days=i % 50), Decimal(i) / 8) for i, k in enumerate(skewed)]
    db.execute('CREATE TABLE "T" ("ID" INT NOT NULL PRIMARY KEY, "K" INT, "S" VARCHAR(20), "AT" TIMESTAMP, "D" DATE, "P" DECIMAL(10,3))')
    db.append("T", spark.createDataFrame([*data, (5000, None, None, None, None, None)], "ID int, K int, S string, AT timestamp_ntz, D date, P decimal(10,3)"))
    for keys in ("ID", ["K", "ID"], ["S"], ["AT"], ["D", "ID"], ["P"], ["D", "S"]):
        df = db.read("T", keys)
        n = parts(df)
        assert len(n) == 4 and max(n) <= 2 * min(n), (keys, n)
        assert sorted(r[0] for r in df.select("ID").collect()) == [*range(2000), 5000]
    window = ReadWindow("AT", ("ID",), None, data[1999][3], (data[1799][3], 1799))
    df = window.apply(db.read("T", ["AT", "ID"], window))
    assert sorted(r[0] for r in df.select("ID").collect()) == list(range(1800, 2000)) and sorted(parts(df)) == [50] * 4
    assert db.query('SELECT "K", "S" FROM "T" WHERE "K" < 10000', ["S"]).rdd.getNumPartitions() == 4
    assert db.read("T", ["D"]).where("false").count() == 0
    spec = TableSpec(tuple(col(c, k) for c, k in (("ID", "INT"), ("AT", "DATETIME"), ("S", "VARCHAR"))), ("ID",), indexed=("AT",))
    target = MemoryTables(t=spark.createDataFrame([], "ID int, AT timestamp_ntz, S string"))
    r = run(spark, SyncTask(1, "t", "T", mode="INCR", incr_column="AT", cursor=f"{data[1799][3]}|1799"), db, target, source_spec=spec, target_spec=spec, now=begin + dt.timedelta(days=300))
    assert (r.status, r.read_rows) == ("COMPLETED", 200), r.message


def test_literals_and_statements_of_dialects():
    d = DIALECTS
    assert d["MYSQL"].literal("a\\b'c") == "'a\\\\b''c'" and d["DM8"].literal("a\\b'c") == "'a\\b''c'"
    assert d["DERBY"].literal(dt.datetime(2026, 1, 2, 3, 4, 5, 6)) == "TIMESTAMP('2026-01-02 03:04:05.000006')" and d["DERBY"].literal(dt.date(2026, 1, 2)) == "DATE('2026-01-02')"
    assert d["DM8"].after(["a", "b"], [1, "x"]) == '(("a" > 1) OR ("a" = 1 AND "b" > \'x\'))' and d["ANSI"].after(["a"], [b"x"]) is None
    assert "USING (SELECT * FROM \"s\" WHERE n < 5) s" in d["DM8"].upsert_from("t", "s", ["a", "b"], ["a"], "n < 5")
    assert d["MYSQL"].upsert_from("t", "s", ["a", "b"], ["a"], "n < 5").endswith("FROM `s` WHERE n < 5 ON DUPLICATE KEY UPDATE `b` = VALUES(`b`)")
    assert "WHEN MATCHED AND n < 5 THEN" in d["DERBY"].upsert_from("t", "s", ["a", "b"], ["a"], "n < 5")


def test_upserts_open_few_files(spark):
    store = ParquetTables(spark, tempfile.mkdtemp(dir="/tmp"), keep_seconds=0)
    rows = spark.range(0, 20_000, 1, 4).select((F.col("id") % 40).alias("tenant"), F.concat(F.lit("b"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("no"), F.lit("old").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "120")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.replace("t", rows, keys=["tenant", "no"])
        files = len(store.files("t"))
        more = rows.where("tenant = 17 and no < 'b008000'").withColumn("v", F.lit("new")).union(spark.createDataFrame([(17, "b9", "in"), (None, "b9", "null")], "tenant long, no string, v string"))
        assert more.count() == 202  # one in a hundred
        store.upsert("t", more, ["tenant", "no"], [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files > 40 and store.touched[0] == files and 0 < store.touched[2] <= store.touched[1] < files / 20
    got = store.read("t")
    assert got.count() == 20_002 and got.where("v = 'new'").count() == 200 and got.where("v in ('in', 'null')").count() == 2
    # the next upsert knows the new files too, rows put in without keys are always searched, other keys search all
    store.upsert("t", spark.createDataFrame([(17, "b000017", "newer")], "tenant long, no string, v string"), ["tenant", "no"], [])
    assert store.touched[1] <= 3 and store.read("t").where("v = 'newer'").count() == 1 and store.read("t").count() == 20_002
    store.upsert("t", spark.createDataFrame([("b000018", "other key")], "no string, v string"), ["no"], [])
    assert store.touched[0] == store.touched[1] and store.read("t").where("v = 'other key'").count() == 1 and store.read("t").count() == 20_002
    parts_left = [n for n in store._names("t") if n.startswith("s-")]
    assert set(parts_left) == {p for v in store._versions("t") for p in store._manifest("t", v)["statistics"].values()}
    assert store.sweep("t", 0) >= 0 and store.read("t").count() == 20_002


def test_readers_end_over_commits_and_old_versions_go(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    store = ParquetTables(spark, root)
    store.create("t", spark.range(5))
    reader = store.read("t")
    for n in (6, 7, 8):
        store.replace("t", spark.range(n))
    assert reader.count() == 5 and store.read("t", 1).count() == 5 and store.read("t").count() == 8
    soon = ParquetTables(spark, root, keep_seconds=0)
    soon.replace("t", spark.range(9))
    assert soon._versions("t") == [4, 5] and len([n for n in soon._names("t") if n.startswith("v") and [x for x in soon._names("t", n) if x.endswith(".parquet")]]) == 2
    with pytest.raises(FileNotFoundError):
        store.read("t", 1)


def test_leases_spare_live_runs_and_stop_stalled_ones(spark):
    now, root = dt.datetime(2026, 1, 1, 12), tempfile.mkdtemp(dir="/tmp")
    one, two = StateStore(spark, root, "one", lease_seconds=1.5), StateStore(spark, root, "two", lease_seconds=1.5)
    alive = one.begin(1, now)
    time.sleep(2.5)  # it renews its lease
    assert two.recover(now) == 0 and two.lease(1)[:2] == ("one", alive)
    with pytest.raises(TaskRunning):
        two.begin(1, now)
    one.renew = lambda: None  # now it stalls
    rows = spark.createDataFrame([(1, "a", now - dt.timedelta(hours=1))], "id long, name string, at timestamp_ntz")
    spec = TableSpec((col("id", "BIGINT", False), col("name", "VARCHAR"), col("at", "DATETIME")), ("id",), indexed=("at",))
    time.sleep(2)
    assert two.recover(now) == 1 and two.begin(1, now) == alive + 1
    target = MemoryTables(t=rows.limit(0))
    r = run(spark, SyncTask(1, "t", "s", mode="INCR", incr_column="at"), MemoryTables(s=rows), target, source_spec=spec, target_spec=spec, now=now, fence=lambda: one.check_lease(1, alive))
    assert r.status == "FAILED" and "lost its lease" in r.message and target.read("t").count() == 0
    with pytest.raises(LeaseLost):
        one.finish(alive, r, now)
    assert two.lease(1)[:2] == ("two", alive + 1) and {x["id"]: x["status"] for x in two.records().collect()} == {alive: "FAILED", alive + 1: "RUNNING"}
    three = StateStore(spark, root, "two")  # the same owner after a restart
    assert three.recover(now) == 1 and three.lease(1) is None
    done = three.run(SyncTask(1, "t", "s", mode="INCR", incr_column="at"), MemoryTables(s=rows), target, now, source_spec=spec, target_spec=spec)
    assert done.status == "COMPLETED" and three.cursor(1) == "2026-01-01 11:00:00|1" and three.lease(1) is None


def test_batches_in_any_order(spark):
    rng = random.Random(3)
    events = [(i % 20, i, f"v{i}") for i in range(300)]
    rng.shuffle(events)
    store = ParquetTables(spark, tempfile.mkdtemp(dir="/tmp"))
    store.create("t", spark.createDataFrame([], "k int, at long, v string"))
    for i in range(0, 300, 60):
        store.upsert("t", spark.createDataFrame(events[i : i + 60], "k int, at long, v string"), ["k"], ["at"], version="at")
    assert sorted(map(tuple, store.read("t").collect())) == [(k, 280 + k, f"v{280 + k}") for k in range(20)]
    files, at = store.files("t"), store._base("t")
    assert store.upsert("t", spark.createDataFrame(events, "k int, at long, v string"), ["k"], ["at"], version="at") == at and store.files("t") == files
    assert store.upsert("t", spark.createDataFrame([(1, 0, "older"), (2, 282, "v282"), (3, 283, "same version")], "k int, at long, v string"), ["k"], [], version="at") == at + 1
    assert {r["k"]: r["v"] for r in store.read("t").where("k < 4").collect()} == {0: "v280", 1: "v281", 2: "v282", 3: "same version"}


def test_a_repeated_look_back_writes_no_file(spark):
    now = dt.datetime(2026, 1, 1, 12)
    rows = spark.createDataFrame([(i, f"n{i}", now - dt.timedelta(minutes=i)) for i in range(1, 40)], "id long, name string, at timestamp_ntz")
    spec = TableSpec((col("id", "BIGINT", False), col("name", "VARCHAR"), col("at", "DATETIME")), ("id",), indexed=("at",))
    store = ParquetTables(spark, tempfile.mkdtemp(dir="/tmp"))
    store.create("t", rows.limit(0))
    go = lambda source, back: run(spark, SyncTask(1, "t", "s", mode="INCR", incr_column="at", cursor="2026-01-01 11:50:00|10", incr=IncrPolicy(0, back)), MemoryTables(s=source), store, source_spec=spec, target_spec=spec, now=now)
    assert go(rows, 1200).written_rows == 29 and store._base("t") == 2
    assert go(rows, 1200).status == "COMPLETED" and store._base("t") == 2
    assert go(rows.withColumn("name", F.when(F.col("id") == 3, "changed").otherwise(F.col("name"))), 1200).status == "COMPLETED"
    assert store._base("t") == 3 and store.read("t").count() == 29 and store.read("t").where("name = 'changed'").count() == 1


@pytest.mark.parametrize("kind,sql", [
    ("MYSQL", "select 1 /*! into outfile '/tmp/x' */"), ("MYSQL", "select 1 /*!50000 into outfile 'x' */"), ("MYSQL", "select /*M!100 1 */ 1"), ("MYSQL", "select /*+ SET_VAR(sql_mode='') */ 1"),
    ("MYSQL", "select 1--1 into outfile 'x'"), ("MYSQL", "select sleep(10)"), ("MYSQL", "select benchmark (9, md5(1))"), ("DERBY", r"select '\' ; drop table t --'"), ("DM8", r"select '\' from t into x --'"),
    ("MYSQL", "with a as (select 1) replace into t select * from a"), ("ANSI", "select 1 # ; drop table t"),
])
def test_statements_refused_by_the_rules_of_their_database(kind, sql):
    assert check_sql(sql, kind).code == "CUSTOM_SQL_INVALID"


@pytest.mark.parametrize("kind,sql", [
    ("MYSQL", "select replace(a, 'x', 'y'), start from t where start > 3"), ("MYSQL", r"select 'it\'s; drop' from t"), ("DERBY", r"select '\' from t"), ("MYSQL", "select 1 # drop"), ("MYSQL", "select 1 -- drop"),
    ("SPARK", "select 'a /*! b */' as sleep"), ("DM8", 'select "drop" from t'), ("MYSQL", "select `sleep` from t"),
])
def test_statements_that_pass(kind, sql):
    assert check_sql(sql, kind) is None


def test_last_wins_by_any_order(spark):
    rng = random.Random(6)
    when = lambda: rng.choice([None, dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), *[dt.datetime(2026, 1, 1, 0, 0, s, 1) for s in range(6)]])
    whole = lambda: rng.choice([None, -(2**63), 2**63 - 1, *range(-3, 4)])
    data = [(rng.choice([None, "a", "b", "c", "d"]), when(), whole(), rng.randrange(5), f"row{i}") for i in range(400)] + [("z", None, None, None, "only")] * 3
    df = spark.createDataFrame(data, "k string, at timestamp_ntz, id long, n int, v string").repartition(3)
    least = lambda x: (x is not None, x)
    for order in (["at"], ["id"], ["n"], ["at", "id"], ["n", "id"], ["at", "n"]):
        places = [df.columns.index(c) for c in order]
        got = merge.last_wins(df, ["k"], order)
        rows = [tuple(r) for r in got.collect()]
        assert sorted(r[4] for r in rows if r[0] is None) == sorted(r[4] for r in data if r[0] is None)
        best = {k: max(tuple(least(r[p]) for p in places) for r in data if r[0] == k) for k in "abcdz"}
        assert {r[0]: tuple(least(r[p]) for p in places) for r in rows if r[0]} == best and len([r for r in rows if r[0]]) == 5
    assert {r["k"]: r["id"] for r in merge.last_wins(df.where("k is not null"), ["k"], ["id", "v"]).collect()}["z"] is None  # the general way


def test_no_search_for_the_last_of_a_declared_key(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "id int, v string")
    spec = TableSpec((col("id", "INT", False), col("v", "VARCHAR")), ("id",))
    from tidemark.plans import engine

    plan = lambda source, target: engine.resolve(SyncTask(1, "t", "s", mode="FULL"), source, target)
    assert engine.keys_are_unique(plan(spec, spec))
    assert not engine.keys_are_unique(plan(TableSpec(spec.columns), spec))
    assert not engine.keys_are_unique(plan(spec, TableSpec((col("id", "VARCHAR", False), col("v", "VARCHAR")), ("id",))))
    monkeypatch.setattr(engine, "last_wins", lambda *_: pytest.fail("searched"))
    target = MemoryTables(t=rows.limit(0))
    assert run(spark, SyncTask(1, "t", "s", mode="FULL"), MemoryTables(s=rows), target, source_spec=spec, target_spec=spec).status == "COMPLETED"


WHOLE = [("2.4999999999999999999999e0", 2), ("-25e-1", -3), ("0.00000000000000000000000025e25", 3), ("1e400", "bad"), ("0e400", 0), ("12345e-400", 0), ("4.5E0", 5), ("1.2345e3", 1235), ("-0.4e0", 0), ("99999999999e-1", "bad"), ("3e+2", 300), (".5e0", 1), ("5.e-1", 1)]
UNSIGNED = {"TINYINT": 2**8, "SMALLINT": 2**16, "INT": 2**32, "BIGINT": 2**64}


def test_whole_numbers_with_exponents_and_unsigned(spark):
    df = spark.createDataFrame([(t,) for t, _ in WHOLE], "x string")
    new, bad = convert(F.col("x"), col("x", "VARCHAR"), col("t", "INT"))
    assert [("bad" if r["b"] else r["y"]) for r in df.select(new.alias("y"), bad.alias("b")).collect()] == [w for _, w in WHOLE]
    for kind, end in UNSIGNED.items():
        df = spark.createDataFrame([(str(end - 1),), (str(end),), ("-1",), ("0",)], "x string")
        new, bad = convert(F.col("x"), col("x", "VARCHAR"), col("t", f"{kind} UNSIGNED"))
        assert [("bad" if r["b"] else int(r["y"])) for r in df.select(new.alias("y"), bad.alias("b")).collect()] == [end - 1, "bad", "bad", 0]
