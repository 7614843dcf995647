"""Structured Streaming over the batch operators: extensions, without a counterpart to match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alert_rates(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and high values of each event type in event-time windows; late rows are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 90).alias("high"))


def once(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, for resumable appends."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def score_batches(cases: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Score a stream of cases batch by batch with the static tables of `score`; each batch overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return cases.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
