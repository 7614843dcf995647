"""Ranking quality, calibration and agreement as grouped aggregates.

Outcomes are rows of (case_id, ord, condition_id, critical, p, rank, truth,
flagged, in_d): one for each case and condition. A ratio is the sum of
numerators over the sum of denominators, null without cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(num: Column, den: Column | None = None) -> Column:
    """Sum of num over sum of den (or over the count of rows)."""
    n = F.sum(num.cast("double"))
    d = F.count(F.lit(1)).cast("double") if den is None else F.sum(den.cast("double"))
    return F.round(F.try_divide(n, d), 6)


def hit() -> Column:
    return F.col("condition_id") == F.col("truth")


def of_truth(o: DataFrame) -> DataFrame:
    """One row for each case: its true condition's."""
    return o.where(hit())


def top_k(o: DataFrame, ks: tuple[int, ...] = (1, 3, 5), by: tuple[str, ...] = ()) -> DataFrame:
    return of_truth(o).groupBy(*by).agg(*[share(F.col("rank") <= k).alias(f"top{k}") for k in ks])


def point_metrics(o: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The six headline means."""
    return of_truth(o).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("rank") <= 1).alias("top1"),
        share(F.col("rank") <= 3).alias("top3"),
        share(F.col("rank") <= 5).alias("top5"),
        share(1 / F.col("rank")).alias("mrr"),
        share(F.col("critical") & (F.col("rank") <= 3), F.col("critical").cast("int")).alias("critical_recall3"),
        share(F.col("critical") & (F.col("rank") > 3), F.col("critical").cast("int")).alias("dangerous_rate"),
    )


def set_metrics(o: DataFrame) -> DataFrame:
    """Precision at 3 and recall at 5 against the differential; cases with an empty one leave recall out."""
    c = o.groupBy("case_id").agg(F.count_if(F.col("in_d") & (F.col("rank") <= 3)).alias("a"), F.count_if(F.col("in_d") & (F.col("rank") <= 4)).alias("b"), F.count_if(F.col("in_d")).alias("d"))
    return c.agg(F.round(F.avg(F.col("a") / 3), 6).alias("precision3"), F.round(F.avg(F.when(F.col("d") > 0, F.col("b") / F.col("d"))), 6).alias("recall4"))


def confusion(o: DataFrame, conditions: DataFrame) -> DataFrame:
    """Counts of (truth, predicted) over the whole grid."""
    counts = o.where("rank = 1").groupBy("truth", F.col("condition_id").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = conditions.select(F.col("condition_id").alias("truth")).crossJoin(conditions.select(F.col("condition_id").alias("predicted")))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def f1(o: DataFrame, conditions: DataFrame) -> DataFrame:
    """F1 of each class, 0 where undefined."""
    c = confusion(o, conditions)
    tp = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    t = c.groupBy(F.col("truth").alias("condition_id")).agg(tp.alias("tp"), F.sum("n").alias("support"))
    p = c.groupBy(F.col("predicted").alias("condition_id")).agg(F.sum("n").alias("predicted"))
    return t.join(p, "condition_id").select("condition_id", "support", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)), 6).alias("f1"))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal-width bins of a probability: count, mean probability, share of hits. Empty bins are left out."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("confidence"), F.round(F.avg(F.col(y).cast("double")), 6).alias("accuracy"))


def ece(rows: DataFrame, p: str, y: str, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error: mean gap of the bins weighted by their counts."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    t = rows.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap"))
    return t.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def brier(o: DataFrame) -> DataFrame:
    """Multi-class Brier score: squared gaps over all conditions, a case."""
    gap = F.col("p") - hit().cast("double")
    return o.agg(F.round(F.sum(gap * gap) / F.count_distinct("case_id"), 6).alias("brier"))


def log_loss(o: DataFrame, least: float = 1e-15) -> DataFrame:
    return of_truth(o).agg(F.round(-F.avg(F.log(F.greatest(F.col("p"), F.lit(least)))), 6).alias("log_loss"))


def kappa(pairs: DataFrame, a: str, b: str, grades: int = 3, weights: str = "none") -> DataFrame:
    """Cohen's kappa of two graders (0 .. grades - 1), unweighted, linear or quadratic."""
    gap = F.abs(F.col("i") - F.col("j")) / (grades - 1)
    w = {"none": (F.col("i") != F.col("j")).cast("double"), "linear": gap, "quadratic": gap * gap}[weights]
    cells = pairs.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy("i").agg(F.sum("n").alias("ni"))
    right = cells.groupBy("j").agg(F.sum("n").alias("nj"))
    grid = left.crossJoin(right).join(cells, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n")
    return grid.agg(F.round(1 - F.try_divide(F.sum(w * F.col("n")), F.sum(w * F.col("ni") * F.col("nj")) / total), 6).alias("kappa"))


def ndcg(judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, p3) from (query_id, item, rank, grade); only queries with a relevant item."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item"))
    gain = lambda r: F.when(F.col(r) <= k, F.col("grade") / F.log2(F.col(r) + 1.0)).otherwise(0.0)
    q = judged.withColumn("ideal", ideal).groupBy("query_id").agg(F.sum(gain("rank")).alias("dcg"), F.sum(gain("ideal")).alias("best"), (F.count_if((F.col("rank") <= 3) & (F.col("grade") > 0)) / 3).alias("p3"))
    return q.where("best > 0").select("query_id", F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg"), F.round("p3", 6).alias("p3"))
