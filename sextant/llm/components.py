"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import discard, written


def _star(edges: DataFrame, label: str) -> DataFrame:
    """Each node's least neighbour (itself included), joined back to its edges; (u, v, m)."""
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), label)
    return edges.join(least, "u")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node it reaches.

    Minima are partial aggregates and the joins read written tables, so a node
    with very many edges is split among tasks. Rounds grow with the logarithm
    of the longest path. Self-loops and repeated edges do no harm; rows with a
    null end are ignored; no edges give no rows."""
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(pairs, "cc-edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "cc-l")
        star = _star(large, "cc-small")
        small = star.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(small.where("u <> v").distinct(), "cc-edges")
        seen = _mark(after)
        discard(large)
        discard(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a set of edges; equal after a round that changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return row[0], row[1], row[2]
