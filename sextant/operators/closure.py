"""Transitive closure by a semi-naive fixpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.sources.shared import kept


def closure(edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(a, b, depth): every b that a reaches over edges(a, b), and the least number of steps.

    Each round joins only the pairs that the last one found with the edges, and
    keeps those that are new; it ends when none are, or at most_depth. A node on a
    cycle reaches itself, at the cycle's length. Repeated edges count once, edges
    with a null end not at all; no edges give no rows. Ends may be of any type
    that can be joined on, structs too."""
    steps = kept(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "closure-edges")
    onward = steps.select(F.col("a").alias("b"), F.col("b").alias("_next"))
    last, depth = steps, 1
    found = [last.withColumn("depth", F.lit(1))]
    while most_depth is None or depth < most_depth:
        known = reduce(DataFrame.union, found).select("a", "b")
        longer = last.join(onward, "b").select("a", F.col("_next").alias("b")).distinct()
        last = kept(longer.join(known, ["a", "b"], "left_anti"), "closure-round")
        if not last.take(1):
            break
        depth += 1
        found.append(last.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.union, found)


def closed_implications(implies: DataFrame, most_depth: int | None = None) -> DataFrame:
    """implies(concept_id, assertion, implied_id, implied_assertion) with all that follows step by step."""
    a, b = F.struct("concept_id", "assertion"), F.struct(F.col("implied_id").alias("concept_id"), F.col("implied_assertion").alias("assertion"))
    pairs = closure(implies.where("implied_id IS NOT NULL AND implied_assertion IS NOT NULL").select(a.alias("a"), b.alias("b")), most_depth)
    return pairs.where("a <> b").select("a.*", F.col("b.concept_id").alias("implied_id"), F.col("b.assertion").alias("implied_assertion"))
