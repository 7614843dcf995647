"""Times and rows of a run's stages, gathered over repeated runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class StageTimes:
    """(stage, run, seconds, rows) of every stage that was timed.

    A stage is a table that is made in whole; its rows are counted on the way by
    an observed metric, not by a second pass."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.runs = spark, [], {}

    def time(self, stage: str, make: Callable[[], DataFrame], end: Callable[[DataFrame], DataFrame | None]) -> DataFrame | None:
        """Make a table, bring it to its end (write it, say) and note what that took; gives what end gives."""
        seen = Observation()
        began = time.perf_counter()
        out = end(make().observe(seen, F.count(F.lit(1)).alias("rows")))
        self.note(stage, time.perf_counter() - began, seen.get["rows"])
        return out

    def note(self, stage: str, seconds: float, rows: int | None) -> None:
        run = self.runs[stage] = self.runs.get(stage, -1) + 1
        self.rows.append((stage, run, float(seconds), rows))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "stage string, run int, seconds double, rows long")


class StreamTimes(StreamingQueryListener):
    """The same of streaming queries: each phase of each batch is a run of the stage of its name."""

    def __init__(self, times: StageTimes):
        self.times = times

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for phase, ms in sorted(p.durationMs.items()):
            self.times.note(f"{p.name or p.id}.{phase}", ms / 1000, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def latency(times: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p50, p95, p99, most, mean) of value."""
    return times.groupBy(by).agg(*[F.round(F.percentile(value, p), 6).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))
