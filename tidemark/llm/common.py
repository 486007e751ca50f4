"""Helpers shared by the text operators: durable tables, size-checked broadcast, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast when a count shows that it has at most this many rows of a few numbers each.
BROADCAST_ROWS = 200_000

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only in local mode with none set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return known.rstrip("/") if known else _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage, so later stages neither repeat the work above nor lose it with an executor. Files stay
    until release(), or until the cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by durable() that nothing reads any more: what came of them has been written itself."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._durable_path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def is_small(df: DataFrame) -> bool:
    """Whether df has at most BROADCAST_ROWS rows; no more than one row beyond them is counted."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def few_lists(df: DataFrame, lists: str) -> bool:
    """Whether df has at most BROADCAST_ROWS rows with some eight numbers each in a column of lists."""
    rows, numbers = df.agg(F.count("*"), F.sum(F.size(lists))).first()
    return rows <= BROADCAST_ROWS and (numbers or 0) <= 8 * BROADCAST_ROWS


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast after counting at most BROADCAST_ROWS + 1 rows; a larger table keeps the planner's own join."""
    return F.broadcast(df) if is_small(df) else df


def join_few(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows left join few, a table already written that has each key once.

    If few has at most BROADCAST_ROWS rows, its keys are broadcast and only the rows that match are shuffled, not all texts;
    otherwise the planner's own join does the same.
    """
    ids = few.select(*keys)
    if not is_small(ids):
        return rows.join(few, keys, "left")
    hit = rows.join(F.broadcast(ids), keys, "left_semi").join(few, keys)
    return hit.unionByName(rows.join(F.broadcast(ids), keys, "left_anti"), allowMissingColumns=True)


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text):
    """Array of the runs without ASCII white space in a text column; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component being the smallest node reached.

    Alternates large-star and small-star, each a grouped minimum with map-side combining, so a node with very many
    neighbours is never gathered in one place: the minimum of each node is aggregated first and then joined to the
    edges. Each round is written to the shared folder. Ends when a round changes nothing.
    """
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    e = durable(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    known = tuple(e.agg(*mark).first())
    for _ in range(max_rounds if known[0] else 0):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, durable(small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        release(last)
        before, known = known, tuple(e.agg(*mark).first())
        if before == known:
            break
    else:
        if known[0]:
            raise RuntimeError("components did not settle")
    star = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
