"""Findings of round 3: what failed on larger tables or off a single machine."""

import datetime as dt
import math
import os
import subprocess
import sys
import tempfile
from decimal import Decimal

import pyspark
from pyspark.sql import functions as F

from tidemark import catalogue, catalogue_rules  # noqa: F401
from tidemark.model import Strategy
from tidemark.sources.jdbc import JdbcTables
from tidemark.sources.parquet import ParquetTables


def test_doubles_below_the_half_in_large_keys(spark, tmp_path):
    keys = [1, 7, 131071, 131072, 133166, 9_000_000, 2_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["convert_double_half_up"](spark, str(tmp_path)).collect()
    assert sorted((r["o_orderkey"], r["y"], r["bad"]) for r in got) == [(k, k, False) for k in keys]
    below = spark.read.parquet(f"{tmp_path}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") + F.lit(0.5)) * F.lit(1 - 2.0**-53)).alias("x")).collect()
    assert all(r["x"] == math.nextafter(r["o_orderkey"] + 0.5, 0) for r in below)


def test_files_of_one_task_lie_by_key(spark):
    spark.range(1000).coalesce(1).sortWithinPartitions(F.xxhash64("id")).write.parquet(f"{(at := tempfile.mkdtemp(dir='/tmp'))}/in")
    rows = spark.read.parquet(f"{at}/in").select("id", F.col("id").alias("v"))
    store = ParquetTables(spark, tempfile.mkdtemp(dir="/tmp"), rows_per_file=10)
    store.replace("out", rows, keys=["id"])
    for _ in range(2):  # what an upsert writes lies by key as well
        store.upsert("out", rows.where("id >= 985").withColumn("v", F.col("v") + 1), ["id"], [], unique=True)
        files, opened, rewritten = store.touched
        assert files >= 100 and opened <= 4 and rewritten <= opened
    assert {(r["id"], r["v"]) for r in store.read("out").collect()} == {(i, i + (i >= 985)) for i in range(1000)}


def test_a_database_that_tasks_do_not_reach(spark):
    """Rows go by files, and all values come back: quotes, line ends, empty texts, nulls, bytes, times, decimals."""
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark._jvm.java.lang.Class.forName(driver)
    db = JdbcTables(spark, f"jdbc:derby:{tempfile.mkdtemp(dir='/tmp')}/db;create=true", connections=3, by_files=True, driver=driver)
    db.execute('CREATE TABLE "T" ("K" BIGINT NOT NULL PRIMARY KEY, "S" VARCHAR(40), "D" DOUBLE, "N" DECIMAL(10,3), "A" TIMESTAMP, "B" BLOB, "O" BOOLEAN)')
    texts = ['say "no", twice', "", None, " spaced ", "two\nlines\r\n", "\\", "'", "中文", "null", ",", '"', "x\ty"]
    data = [(i, s, 0.1 * i if i % 3 else None, Decimal(i) / 8 if i % 4 else None, dt.datetime(2024, 1, 1, 0, 0, i, 123456) if i % 5 else None, bytes([0, i, 255]) if i % 2 else None, i % 2 == 0 if i % 6 else None) for i, s in enumerate(texts)]
    rows = spark.createDataFrame(data, "K long, S string, D double, N decimal(10,3), A timestamp, B binary, O boolean")
    assert db.append("T", rows) == []
    parts = db.read("T", ["S", "K"])
    want = sorted(map(repr, map(tuple, rows.collect())))
    assert sorted(map(repr, map(tuple, parts.collect()))) == want == sorted(map(repr, map(tuple, db.read("T").collect())))
    assert parts.rdd.getNumPartitions() == 3
    assert db.read("T").where("K < 0").count() == 0 and db.query('SELECT * FROM "T" WHERE "K" < 0', "K").count() == 0
    for strategy in Strategy:
        db.replace("T", rows.withColumn("D", F.lit(1.5)), strategy)
        assert db.query('SELECT COUNT(*) AS N, SUM("D") AS D FROM "T"').first()[:] == (12, 18.0)
    assert not any(x.startswith("DS_") for x in db.tables())


CLUSTER = """
import sys, tempfile
from pyspark.sql import SparkSession
at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4",
        "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"{at}/shared", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.local.dir": at}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from tidemark import catalogue, catalogue_rules
for name in sys.argv[2:]:
    print("ROWS", name, catalogue.QUERIES[name](spark, sys.argv[1]).count(), flush=True)
spark.stop()
"""


def test_database_queries_on_a_cluster():
    """Executors in processes of their own: the embedded database is the driver's alone."""
    names = ["jdbc_even_parts", "jdbc_isolated_rows", "jdbc_metadata", "jdbc_refresh", "jdbc_scan", "jdbc_statement", "jdbc_upsert"]
    home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # executors' work folders lie in Spark's home
    spark_home = os.path.dirname(pyspark.__file__)
    for x in os.listdir(spark_home):
        os.symlink(f"{spark_home}/{x}", f"{home}/{x}") if x != "work" else None
    env = os.environ | {"SPARK_HOME": home, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", CLUSTER, "/root/testdata/sf0.001", *names], env=env, cwd=home, capture_output=True, text=True, timeout=900)
    said = dict(x.split()[1:] for x in done.stdout.splitlines() if x.startswith("ROWS"))
    assert sorted(said) == names, done.stderr[-2000:]
    assert said["jdbc_metadata"] == "5" and said["jdbc_scan"] == said["jdbc_upsert"] == said["jdbc_even_parts"] == "1500" and said["jdbc_refresh"] == "4500"


def test_rows_beyond_the_limits_of_columns_are_found_at_once(spark, monkeypatch):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark._jvm.java.lang.Class.forName(driver)
    db = JdbcTables(spark, f"jdbc:derby:{tempfile.mkdtemp(dir='/tmp')}/db;create=true", connections=2, driver=driver)
    db.execute('CREATE TABLE "T" ("K" BIGINT NOT NULL PRIMARY KEY, "U" VARCHAR(20) NOT NULL UNIQUE, "V" VARCHAR(4) NOT NULL)', "INSERT INTO \"T\" VALUES (-1, 'u30', 'old')")
    text = F.when(F.col("id") % 10 == 1, "abcde").when(F.col("id") % 10 == 2, "abcd  ").when(F.col("id") % 10 == 3, None).otherwise("new")
    rows = spark.range(1, 201).select(F.col("id").alias("K"), F.concat(F.lit("u"), "id").alias("U"), text.alias("V"))
    said, merge = [], db.dialect.upsert_from
    monkeypatch.setattr(db.dialect, "upsert_from", lambda *a, **k: said.append(a) or merge(*a, **k), raising=False)
    refused = db.upsert("T", rows, ["K"], [], most_rejected=100)
    assert sorted(int(r.row["K"]) for r in refused) == sorted([30, *(k for k in range(1, 201) if k % 10 in (1, 3))])
    assert len(said) <= 2 and db.read("T").count() == 160
