"""Aggregates over run records and errors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PER_PAGE = 200


def total_read_rows(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.sum("read_rows"), F.lit(0)).cast("long").alias("total_read_rows"))


def count_by_status(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


def count_by_task(records: DataFrame) -> DataFrame:
    return records.groupBy("task_id").agg(F.count("*").alias("n"))


def total_records(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n"))


def overview(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """One row: tasks, runs by outcome and rows read, in one aggregation of each table."""
    n = tasks.agg(F.count("*").alias("total_tasks")).withColumn("_one", F.lit(1))
    r = records.agg(
        F.count_if(F.col("status") == "RUNNING").alias("running_tasks"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status").isin("COMPLETED", "SUCCESS")).alias("success"),
        F.count("*").alias("total_records"), F.coalesce(F.sum("read_rows"), F.lit(0)).cast("long").alias("total_read_rows"),
    ).withColumn("_one", F.lit(1))
    return n.join(r, "_one").drop("_one")


def recent_failures(records: DataFrame, most: int = 20) -> DataFrame:
    return records.where("status = 'FAILED'").orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(most)


def record_page(records: DataFrame, task_id: int | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of run history, latest first: the first pages only, as a screen shows them."""
    size = max(1, min(MOST_PER_PAGE, size))
    rows = records if task_id is None else records.where(F.col("task_id") == task_id)
    return rows.orderBy(F.col("start_time").desc(), F.col("id").desc()).offset((max(1, page) - 1) * size).limit(size)


def error_page(errors: DataFrame, record_id: int, phase: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    size = max(1, min(MOST_PER_PAGE, size))
    rows = errors.where(F.col("record_id") == record_id)
    rows = rows if not phase else rows.where(F.col("phase") == phase.upper())
    return rows.orderBy("id").offset((max(1, page) - 1) * size).limit(size)


def schedulable(tasks: DataFrame) -> DataFrame:
    return tasks.where("enabled and cron_expression is not null and trim(cron_expression) <> ''")


def kept_records(records: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """What retention keeps: running records, and others that began within the days."""
    return records.where((F.col("status") == "RUNNING") | F.col("start_time").isNull() | (F.col("start_time") >= F.lit(now - dt.timedelta(days=days))))


def kept_errors(errors: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    return errors.where(F.col("created_at") >= F.lit(now - dt.timedelta(days=days)))
