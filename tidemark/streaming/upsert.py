"""A target kept up to date from a stream: each micro-batch is one idempotent upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_upsert(stream: DataFrame, target, table: str, keys: list[str], order: list[str], checkpoint: str, available_now: bool = True, version: str | None = None) -> StreamingQuery:
    """Start upserting a stream into a target table.

    A batch that is told twice after a failure changes nothing the second time. Within a batch the last row of a key by
    `order` counts; across batches the later batch does, so the stream should come in order, as files of increments do,
    or name a `version` column of the target that grows with the order: then batches may come in any order.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            target.upsert(table, batch, keys, order, **({"version": version} if version else {}))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_per_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drops repeats of an event within the delay that late rows may have."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
