"""Incremental indexing of a change stream: each micro-batch becomes a commit on top of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.operators.changes import validated
from stratavec.sources.store import VectorStore


def commit_name(prefix: str, batch: int) -> str:
    return f"{prefix}-{batch:06d}"


def index_stream(store: VectorStore, domain: str, stream: DataFrame, checkpoint: str, prefix: str = "stream", strict: bool = True):
    """Start a query that applies each batch of operations to the previous batch's index; returns the streaming query.

    A batch that is run again writes the same commit again, so a replay after a failure changes nothing. Rows keep the order
    in which the batch delivers them.
    """

    def apply(batch: DataFrame, number: int) -> None:
        ops = validated(batch, strict).withColumn("seq", F.monotonically_increasing_id())
        before = None
        for k in range(number - 1, -1, -1):
            try:
                store.manifest(domain, commit_name(prefix, k))
                before = commit_name(prefix, k)
                break
            except KeyError:
                continue
        store.build(domain, commit_name(prefix, number), ops, before)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def operation_rates(stream: DataFrame, time: str = "received_at", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Operations per event-time window and kind, with rows later than ``late`` dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "op").agg(F.count(F.lit(1)).alias("n"))
