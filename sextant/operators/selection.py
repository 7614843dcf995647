"""Which articles a bundle takes: a quota for each condition, an article once for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def planned(found: DataFrame, wanted: int) -> DataFrame:
    """The first so many distinct items of each condition, by found(condition, ord, item); ties go to the item."""
    first = found.groupBy("condition", "item").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("condition").orderBy("ord", "item"))
    return first.withColumn("place", place).where(F.col("place") <= wanted).select("condition", "place", "item")


def select_articles(plan: DataFrame, articles: DataFrame, quota: int) -> tuple[DataFrame, DataFrame]:
    """Taken (item, conditions) and refused (item, reason) of plan(condition, place, item).

    Each condition goes through its plan until it has its quota: articles that
    aren't among articles(item, reason) count for nothing, those with a reason
    are refused, all others are taken. An article that several conditions take
    is kept once, counts for each and lists them all. An article is refused only
    if some condition came as far as it."""
    rows = plan.join(articles.select("item", "reason").dropDuplicates(["item"]), "item")
    before = Window.partitionBy("condition").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("reason").isNull()
    seen = rows.withColumn("had", F.coalesce(F.sum(good.cast("int")).over(before), F.lit(0))).where(F.col("had") < quota)
    taken = seen.where(good).groupBy("item").agg(F.sort_array(F.collect_set("condition")).alias("conditions"))
    refused = seen.where(~good).groupBy("item").agg(F.min("reason").alias("reason"))
    return taken, refused


def licence_counts(taken: DataFrame, licences: DataFrame) -> DataFrame:
    """(licence, articles, uses): articles taken under each licence, and how often conditions use them."""
    return taken.join(licences, "item").groupBy("licence").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.size("conditions")).alias("uses"))
