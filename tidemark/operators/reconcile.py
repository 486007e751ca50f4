"""Comparison of source and target: counts, keys that repeat, rows missing or changed, a digest of the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    both = source.agg(F.count("*").alias("source_rows")), target.agg(F.count("*").alias("target_rows"))
    one = [d.withColumn("_one", F.lit(1)) for d in both]
    return one[0].join(one[1], "_one").select("source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("same"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_rows(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of source whose key is not in target."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def canonical_row(df: DataFrame) -> Column:
    """A row as text: nulls as \\N, bytes in hex, everything else as it casts; parts parted by the unit separator."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        said = F.hex(c) if f.dataType.typeName() == "binary" else F.when(c, "1").when(~c, "0") if f.dataType.typeName() == "boolean" else c.cast("string")
        parts.append(F.coalesce(said, F.lit("\\N")))
    return F.concat_ws("\x1f", *parts)


def changed_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys in both whose other columns differ; nulls equal nulls."""
    s = source.select(*keys, F.struct(*columns).alias("_s"))
    t = target.select(*keys, F.struct(*columns).alias("_t"))
    return s.join(t, list(keys)).where(~F.col("_s").eqNullSafe(F.col("_t"))).select(*keys)


def table_digest(df: DataFrame) -> DataFrame:
    """rows and a digest that depends on the multiset of rows, not on their order: it sums two hashes of each row."""
    text = canonical_row(df)
    part = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", part(1).cast("string"), part(2).cast("string")), 256).alias("digest"))
