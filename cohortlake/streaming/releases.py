"""Counts over a stream of events, released window by window and only once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.release import Ledger, noised


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Rows of each window and key of a stream; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def release_batches(ledger: Ledger, secret: bytes, epsilon: float):
    """A foreachBatch function: each closed window gets its noise and is stored under the batch's number, so a replayed batch changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        blocks = batch.select(F.concat_ws("|", F.col("start").cast("string"), "key").alias("block"), F.lit(1).alias("coord"), F.col("n").alias("value"))
        ledger.release(f"batch-{number}", lambda: noised(blocks, "stream", secret, 1.0, epsilon))

    return run
