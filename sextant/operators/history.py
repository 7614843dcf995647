"""Histories as of a day: intervals, latest observations and what they indicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(entries: DataFrame, day: Column) -> DataFrame:
    """Entries whose half-open interval [start, stop) holds the day; no stop is open."""
    return entries.where((F.col("start") <= day) & (F.col("stop").isNull() | (day < F.col("stop"))))


def latest(observations: DataFrame, by: list[str], day: Column, tie: str) -> DataFrame:
    """The last observation of each key up to the day; of equal times the later-read row."""
    rows = observations.where(F.col("start") <= day)
    w = Window.partitionBy(*by).orderBy(F.desc("start"), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, when: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time: one shuffle on the key, no range join."""
    a = left.withColumn("_at", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(by, F.col(when).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_at", "_side", "_v")


def indicated(entries: DataFrame, by_code: DataFrame, by_answer: DataFrame | None = None) -> DataFrame:
    """Entries with what their code indicates, by by_code(code, ...), and their code and answer, by by_answer(code, answer, ...).

    An entry that both maps know has a row of each."""
    out = entries.join(by_code, "code")
    return out if by_answer is None else out.unionByName(entries.join(by_answer, ["code", "answer"]))


def fold_findings(rows: DataFrame) -> DataFrame:
    """One finding for each patient and concept: present wins, codes joined, the earliest date."""
    return rows.groupBy("patient", "concept_id").agg(F.max_by("assertion", (F.col("assertion") == "present").cast("int")).alias("assertion"), F.array_join(F.array_sort(F.collect_set("code")), "+").alias("codes"), F.min("start").alias("since"))


def age_on(birth: Column, day: Column) -> Column:
    """Whole years, the birthday counted in."""
    return F.year(day) - F.year(birth) - (F.date_format(day, "MMdd") < F.date_format(birth, "MMdd")).cast("int")
