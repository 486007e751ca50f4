"""Keyset predicates and pages. A position is a list of (column, value); rows after it come next in ascending order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_predicate(keys: Sequence[str], values: Sequence | None) -> Column | None:
    """Rows after `values`; None for no position.

    The comparison of tuples is written out as (a > x) or (a = x and b > y) ..., for which sources prune row groups and
    use indexes; a comparison of structs would reach none of them.
    """
    if values is None:
        return None
    if not keys or len(keys) != len(values):
        raise ValueError(f"a position over {len(keys)} keys has {len(values)} values")
    steps = []
    for i, (key, value) in enumerate(zip(keys, values, strict=True)):
        same = [F.col(k) == F.lit(v) for k, v in zip(keys[:i], values[:i], strict=True)]
        steps.append(reduce(lambda a, b: a & b, [*same, F.col(key) > F.lit(value)]))
    return reduce(lambda a, b: a | b, steps)


def all_of(*predicates: Column | None) -> Column | None:
    """The conjunction of those given; None if there are none."""
    given = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def between(column: str, lower=None, upper=None) -> Column | None:
    """column > lower and column <= upper, each bound optional."""
    return all_of(None if lower is None else F.col(column) > F.lit(lower), None if upper is None else F.col(column) <= F.lit(upper))


def keyset_page(df: DataFrame, keys: Sequence[str], size: int, after: Sequence | None = None, extra: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The next `size` rows after a position, by ascending keys (nulls first)."""
    if not keys:
        raise ValueError("a page needs order keys")
    if size <= 0:
        raise ValueError("a page has at least one row")
    where = all_of(extra, keyset_predicate(keys, after))
    page = (df if where is None else df.where(where)).orderBy(*[F.col(k).asc() for k in keys]).limit(size)
    return page.select(*columns) if columns else page


def watermark_page(df: DataFrame, cursor: str, ties: Sequence[str], size: int, lower=None, upper=None, after: Sequence | None = None) -> DataFrame:
    """A page by (cursor, ties) of the rows within the bounds of the cursor."""
    keys = [cursor, *[t for t in ties if t != cursor]]
    return keyset_page(df, keys, size, after, between(cursor, lower, upper))


def iter_pages(df: DataFrame, keys: Sequence[str], size: int) -> Iterator[list]:
    """Pages as lists of rows, for callers that read along. A sync reads everything in one distributed scan instead.

    Raises if a key is null or a page does not advance, which would lose rows or never end.
    """
    after = None
    while True:
        rows = keyset_page(df, keys, size, after).collect()
        if not rows:
            return
        last = [rows[-1][k] for k in keys]
        if any(r[k] is None for r in rows for k in keys):
            raise ValueError("a key of the page is null")
        if last == after:
            raise ValueError("the position does not advance")
        yield rows
        if len(rows) < size:
            return
        after = last


def numbered_pages(df: DataFrame, keys: Sequence[str], size: int, folder: str) -> DataFrame:
    """All rows of df with their page number from 0 in `page`; no row passes through the driver.

    Rows are dealt by key range and sorted where they are, written once to `folder`, which must not exist, and counted
    there: the counts of the parts before a row's part make its place. Raises if a key is null, as iter_pages does.
    """
    if not keys:
        raise ValueError("a page needs order keys")
    if size <= 0:
        raise ValueError("a page has at least one row")
    # the id has the number of the part in its upper bits and the place in the part in the lower 33
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    ranged.write.parquet(folder)
    rows = df.sparkSession.read.schema(ranged.schema).parquet(folder).withColumn("_part", F.shiftright("_place", 33))
    if not rows.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).isEmpty():
        raise ValueError("a key of the page is null")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, F.floor(place / size).cast("long").alias("page"))
