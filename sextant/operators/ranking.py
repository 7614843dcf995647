"""Deterministic rankings: every order ends in the condition's ordinal or an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_scores(scores: DataFrame, score: str, by: str = "case_id", tie: str = "ord", first: Column | None = None, name: str = "rank") -> DataFrame:
    """Row number within each case by descending score, then tie; `first` comes before the score (flag-first)."""
    order = ([first.desc()] if first is not None else []) + [F.col(score).desc(), F.col(tie)]
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def true_rank(ranked: DataFrame) -> DataFrame:
    """(case_id, rank) of each case's true condition."""
    return ranked.where(F.col("condition_id") == F.col("truth")).select("case_id", "rank")


def competition_rank(scores: DataFrame, score: str, by: str = "case_id") -> DataFrame:
    """Equal scores share the better rank."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.col(score).desc())))


def first_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def first_occurrence(values: DataFrame, by: str, value: str, pos: str) -> DataFrame:
    """The first row of each distinct value, renumbered in the order they came."""
    first = values.groupBy(by, value).agg(F.min(pos).alias(pos))
    return first.withColumn(pos, F.row_number().over(Window.partitionBy(by).orderBy(pos)) - 1)


def hash_order(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """n rows in the order of SHA-256 of seed:key."""
    return rows.withColumn("digest", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("digest", key).limit(n)


def rank_without(ranked: DataFrame, removed: str) -> DataFrame:
    """Ranks when one condition is left out: one less below it."""
    out = ranked.where(F.col("condition_id") == removed).select("case_id", F.col("rank").alias("_r"))
    return ranked.where(F.col("condition_id") != removed).join(out, "case_id").withColumn("rank", F.col("rank") - (F.col("_r") < F.col("rank")).cast("int")).drop("_r")


def first_rule(rules: DataFrame, met: DataFrame) -> DataFrame:
    """The reason of the first rule of each condition that a case meets; met has case_id and rule_ord."""
    return met.join(rules, "rule_ord").groupBy("case_id", "condition_id").agg(F.min_by("reason", "rule_ord").alias("reason"))


def hash_places(rows: DataFrame, by: str, digest: str, tie: str) -> DataFrame:
    """rows with k, their place from 1 within by in the order of a hexadecimal digest, then tie, and n, how many there are.

    A group is ranked in 256 parts by the digest's first byte, and a part's
    places begin after the parts before it, so no task holds a whole group."""
    at = rows.withColumn("_part", F.substring(digest, 1, 2))
    sizes = at.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(by)
    sizes = sizes.withColumns({"_before": F.sum("_n").over(own.orderBy("_part")) - F.col("_n"), "n": F.sum("_n").over(own)}).drop("_n")
    k = F.row_number().over(Window.partitionBy(by, "_part").orderBy(digest, tie))
    return at.withColumn("_k", k).join(sizes, [by, "_part"]).withColumn("k", F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")
