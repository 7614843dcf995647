"""Fusing model and graph scores: a logarithmic opinion pool in long form, and its calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least score, the floor of a probability, the spread under which a model abstains.
LEAST_SCORE, FLOOR, FLAT = -700.0, 0.01, 1e-12


def log_sum_exp(x: Column, by: Window, where: Column | None = None) -> Column:
    """ln of the sum of exp(x) over a partition, of the rows where `where` holds."""
    y = x if where is None else F.when(where, x)
    top = F.max(y).over(by)
    return top + F.log(F.sum(F.exp(y - top)).over(by))


def log_softmax(scores: DataFrame, score: str, name: str, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return scores.withColumn(name, F.col(score) - log_sum_exp(F.col(score), Window.partitionBy(*by)))


def abstains(by: tuple[str, ...] = ("case_id",)) -> Column:
    """Whether the model says nothing about a case: no mass, or the same for all."""
    w, p = Window.partitionBy(*by), F.when(F.col("in_model"), F.col("p"))
    return F.coalesce((F.sum(p).over(w) <= 0) | (F.max(p).over(w) - F.min(p).over(w) < FLAT), F.lit(True))


def opinion_pool(s: DataFrame, alpha: Column, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """s with `fused`, a log-probability, from columns p, kg and in_model.

    The model's conditions share the graph's mass of them by
    (1 - alpha) ln p + alpha ln kg; the others keep the graph's mass. Where the
    model abstains, or alpha is 1, the graph's is the answer."""
    w, inside = Window.partitionBy(*by), F.col("in_model")
    s = s.withColumn("_alpha", alpha).withColumn("_lkg", F.col("kg") - log_sum_exp(F.col("kg"), w)).withColumn("_mute", abstains(by))
    lp = F.when(F.col("_alpha") == 0, F.when(F.col("p") > 0, F.log("p")).otherwise(LEAST_SCORE)).otherwise(F.log(F.greatest(F.col("p"), F.lit(FLOOR))))
    s = s.withColumn("_t", (1 - F.col("_alpha")) * lp + F.col("_alpha") * F.col("_lkg"))
    s = s.withColumn("_pool", F.col("_t") - log_sum_exp(F.col("_t"), w, inside)).withColumn("_mass", log_sum_exp(F.col("_lkg"), w, inside))
    fused = F.when(F.col("_mute") | (F.col("_alpha") == 1) | ~inside, F.col("_lkg")).otherwise(F.col("_mass") + F.col("_pool"))
    return s.withColumn("fused", F.greatest(fused, F.lit(LEAST_SCORE))).drop("_alpha", "_lkg", "_mute", "_t", "_pool", "_mass")


def calibrate(s: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Sigmoid of a + b ln p for the fitted conditions, which then share the mass they had; others stay."""
    w = Window.partitionBy(*by)
    j = s.join(fitted, "condition_id", "left").withColumn("_f", F.col("a").isNotNull())
    z = F.col("a") + F.col("b") * F.log(F.greatest(F.col("p"), F.lit(1e-9)))
    j = j.withColumn("_c", F.when(F.col("_f"), 1 / (1 + F.exp(-z))))
    before = F.sum(F.when(F.col("_f"), F.col("p"))).over(w)
    return j.withColumn("calibrated", F.when(F.col("_f"), F.col("_c") * before / F.sum("_c").over(w)).otherwise(F.col("p"))).drop("_f", "_c", "a", "b")


def alpha_source(arms: DataFrame, tuned: DataFrame, default: float = 0.5) -> DataFrame:
    """(arm, alpha, source) of each arm: its tuned weight, or the default where it has none."""
    return arms.join(tuned, "arm", "left").select("arm", F.coalesce("alpha", F.lit(default)).alias("alpha"), F.when(F.col("alpha").isNull(), "default").otherwise("tuned").alias("source"))
