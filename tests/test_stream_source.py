"""A table as a stream by a composite cursor."""

import datetime as dt
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cursor import ReadWindow, decode, typed
from tidemark.functions.types import spec_of
from tidemark.sources.parquet import ParquetTables
from tidemark.streaming import source
from tidemark.streaming.source import stream_by_cursor
from tidemark.streaming.upsert import stream_upsert

SCHEMA = "ts timestamp, id long, name string"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def drain(spark, path, place, schema, keys, **more):
    """One availableNow run from the checkpoint; all rows its sink holds so far, and the last offset's cursor."""
    stream = stream_by_cursor(spark, path, schema, keys, **more)
    q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    names = [n for n in os.listdir(f"{place}/check/offsets") if n.isdigit()]
    with open(f"{place}/check/offsets/{max(names, key=int)}") as f:
        last = json.loads(f.read().splitlines()[-1])["cursor"]
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{place}/out").collect()), key=repr), last


def test_rows_added_between_runs_come_once(spark):
    place = tempfile.mkdtemp(dir="/tmp")
    schema = spark.createDataFrame([], SCHEMA).schema
    rng = random.Random(3)
    first = [(at(rng.randrange(20)), i, rng.choice(["", "x", None, "y" * 50_000])) for i in range(300)]
    top = max(r[0] for r in first)
    first.append((None, -1, "no cursor"))
    spark.createDataFrame(first, schema).repartition(3).write.parquet(f"{place}/in")
    got, last = drain(spark, f"{place}/in", place, schema, ["ts", "id"])
    assert got == sorted(first[:-1], key=repr)
    ties = [(top, 1000 + i, "tie") for i in range(5)]  # ties of the last row read, with greater ids
    later = [(at(100 + i % 2), i, "later") for i in range(10)]
    repeated = [later[0], later[0]]
    spark.createDataFrame(ties + later + repeated, schema).repartition(2).write.mode("append").parquet(f"{place}/in")
    spark.createDataFrame([(at(0), -5, "behind")], schema).write.mode("append").parquet(f"{place}/in")
    got, last = drain(spark, f"{place}/in", place, schema, ["ts", "id"], part_bytes=1)
    assert got == sorted(first[:-1] + ties + later + repeated, key=repr)
    again, _ = drain(spark, f"{place}/in", place, schema, ["ts", "id"])
    assert again == got
    # the offset is a cursor that a task takes
    parts = [typed(p, spec_of(schema[k])) for p, k in zip(decode(last), ["ts", "id"], strict=True)]
    assert parts == [at(101), 9]
    assert ReadWindow("ts", ("id",), position=tuple(parts)).apply(spark.read.parquet(f"{place}/in")).isEmpty()


def test_null_ties_texts_and_missing_columns(spark):
    place = tempfile.mkdtemp(dir="/tmp")
    schema = spark.createDataFrame([], "k string, tie long, extra double").schema
    rows = [("a", None), ("a", 1), ("b|\\", None), ("ü", None), (None, 4)]
    spark.createDataFrame(rows, "k string, tie long").write.parquet(f"{place}/in")
    got, _ = drain(spark, f"{place}/in", place, schema, ["k", "tie"])
    assert got == sorted([(*r, None) for r in rows[:-1]], key=repr)
    spark.createDataFrame([("ü", None, 1.0), ("ü", 0, 2.0), ("z", 9, 3.0)], schema).write.mode("append").parquet(f"{place}/in")
    more, _ = drain(spark, f"{place}/in", place, schema, ["k", "tie"])
    assert [r for r in more if r not in got] == [("ü", 0, 2.0)]  # "z" is before "ü", and the null tie was passed


def test_empty_and_missing_tables(spark):
    place = tempfile.mkdtemp(dir="/tmp")
    schema = spark.createDataFrame([], SCHEMA).schema
    reader = source.CursorReader({"path": f"{place}/none", "keys": '["ts", "id"]', "lag_seconds": "0", "part_bytes": "1"}, schema)
    assert reader.latestOffset() == {"cursor": None} == reader.initialOffset() and reader.partitions({"cursor": None}, {"cursor": None}) == []
    spark.createDataFrame([(None, 1, "x")], schema).write.parquet(f"{place}/none")
    assert reader.latestOffset() == {"cursor": None}
    with pytest.raises(ValueError):
        stream_by_cursor(spark, place, spark.createDataFrame([], "x double").schema, ["x"])


def test_lag_and_pruning(spark):
    place = tempfile.mkdtemp(dir="/tmp")
    schema = spark.createDataFrame([], SCHEMA).schema
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
    rows = [(now - dt.timedelta(hours=h), h, "x") for h in range(48)]
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    try:
        spark.createDataFrame(rows, schema).repartitionByRange(8, "ts").write.parquet(f"{place}/in")
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    make = lambda lag: source.CursorReader({"path": f"file:{place}/in", "keys": '["ts", "id"]', "lag_seconds": str(lag), "part_bytes": "1"}, schema)
    reader = make(5 * 3600 - 60)
    assert json.loads(reader.latestOffset()["cursor"])[1] == "5"
    reader = make(0)
    end = reader.latestOffset()
    looked = []
    reader._last, real = lambda g, b: looked.append(g) or real(g, b), reader._last
    assert reader.latestOffset() == end and len(looked) == 1  # one row group tells the greatest position
    start = {"cursor": json.dumps([str(now - dt.timedelta(hours=2)), "2"])}
    parts = reader.partitions(start, end)
    assert len(parts) == 1 and sum(len(b) for p in parts for b in reader.read(p)) == 2


def test_versioned_table_to_table(spark):
    """A table that is upserted feeds another; a row that is updated comes again with its greater cursor."""
    place = tempfile.mkdtemp(dir="/tmp")
    tables = ParquetTables(spark, f"{place}/tables")
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") % 7 + 1_700_000_000).alias("ts"), "id", F.lit("old").alias("name"))
    tables.create("src", rows)
    tables.create("out", rows.limit(0))

    def follow():
        stream = stream_by_cursor(spark, f"{place}/tables/src", rows.schema, ["ts", "id"])
        assert stream_upsert(stream, tables, "out", ["id"], ["ts"], f"{place}/check").awaitTermination(120)
        return sorted(map(tuple, tables.read("out").collect())) == sorted(map(tuple, tables.read("src").collect()))

    assert follow()
    changed = spark.range(190, 210).select(F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), "id", F.lit("new").alias("name"))
    tables.upsert("src", changed, ["id"], ["ts"])
    assert tables.read("out").where("name = 'new'").isEmpty()
    assert follow() and tables.read("out").where("name = 'new'").count() == 20
