"""Passes over a stream of book records, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from biblioflow.plans.model import Result


def apply_passes(stream: DataFrame, passes: list[Callable[[DataFrame], Result]], out: str, checkpoint: str) -> StreamingQuery:
    """Run passes on every micro-batch; books and changes are written under out, by batch.

    A batch that is run again after a failure replaces its own folder, so each record is
    written once.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = batch
        for i, one in enumerate(passes):
            result = one(before)
            if result.changes is not None:
                result.changes.write.mode("overwrite").parquet(f"{out}/changes/batch={number}/step={i}")
            before = result.books
        before.write.mode("overwrite").parquet(f"{out}/books/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliveries(stream: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Import records per channel and window of receipt; later than the watermark they do not count."""
    return stream.withWatermark("received_at", late).groupBy(F.window("received_at", window), "channel").agg(F.count("*").alias("records")).select(F.col("window.start").alias("start"), "channel", "records")
