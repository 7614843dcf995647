"""Gradient-boosted trees for several classes, grown level by level from grouped sums.

Features are cut into bins once. Rows that agree in all bins, their class and
their side of the split between learning and watching count as one cell with a
weight, so a table costs as many cells as it has distinct ones. A level of a
round's trees, one a class, is one aggregate: the sums of gradient and hessian by
class, node, feature and bin. Only those sums reach the driver, which picks the
splits; margins stay in the cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.shared import dropped, kept

#: The least hessian of a cell's weight, so that sure rows don't vanish.
LEAST_HESSIAN = 1e-16
#: Digits of a gain that count when splits are compared; ties go to the first feature and bin.
DIGITS = 9


@dataclass
class Tree:
    """Node 1 is the root, 2n and 2n + 1 are the children of n. feature is -1 for a leaf.

    A row goes right if its bin is over the node's, or is missing and the node says so."""

    feature: list[int]
    bin: list[int]
    missing_right: list[bool]
    value: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls([-1] * n, [0] * n, [False] * n, [0.0] * n)


@dataclass
class BoostedTrees:
    """features, their inner bin edges, classes in order, and rounds of one tree a class."""

    features: list[str]
    edges: list[list[float]]
    classes: list
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    #: Mean log loss of the watched rows after each round, the first before any.
    losses: list[float] = field(default_factory=list)

    def bins(self) -> Column:
        """Each feature's bin as an array: how many edges are under the value, -1 where it is missing."""
        out = []
        for name, edges in zip(self.features, self.edges, strict=True):
            x = F.col(f"`{name}`").cast("double")
            below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) if edges else F.lit(0)  # noqa: B023
            out.append(F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(below))
        return F.array(*out)

    def table(self, spark: SparkSession) -> DataFrame:
        """(round, class, node, feature, edge, missing_right, value): every node that splits or is a leaf."""
        rows = []
        for r, trees in enumerate(self.rounds):
            for c, t in zip(self.classes, trees, strict=True):
                reach = [1]
                for n in reach:
                    f = t.feature[n]
                    if f >= 0:
                        reach += [2 * n, 2 * n + 1]
                    rows.append((r, str(c), n, self.features[f] if f >= 0 else None, self.edges[f][t.bin[n]] if f >= 0 else None, t.missing_right[n] if f >= 0 else None, None if f >= 0 else t.value[n]))
        return spark.createDataFrame(rows, "round int, class string, node int, feature string, edge double, missing_right boolean, value double")

    def probabilities(self, rows: DataFrame, column: str = "probabilities") -> DataFrame:
        """rows with the probability of each class, an array in the order of classes."""
        x, m = _fresh(rows, "_x"), _fresh(rows, "_m")
        out = rows.withColumn(x, self.bins()).withColumn(m, F.array(*[F.lit(0.0)] * len(self.classes)))
        for trees in self.rounds:
            out = out.withColumn(m, _added(F.col(m), F.col(x), trees, self.depth))
        return out.withColumn(column, _softmax(F.col(m))).drop(x, m)


def _fresh(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name += "_"
    return name


def _literal(rows: list[list], kind: str) -> Column:
    """A constant array of arrays."""
    text = ", ".join("array(" + ", ".join(f"{v!r}D" if kind == "double" else str(v).lower() for v in row) + ")" for row in rows)
    return F.expr(f"array({text})")


def _node(trees: list[Tree], steps: int, k: Column, x: Column) -> Column:
    """The node that a row of bins x is at after so many steps in the tree of class k (from 0)."""
    feature, cut = _literal([t.feature for t in trees], "int"), _literal([t.bin for t in trees], "int")
    right = _literal([t.missing_right for t in trees], "boolean")

    def at(table: Column, n: Column) -> Column:
        return F.get(F.get(table, k), n)

    def step(n: Column, _) -> Column:
        f = at(feature, n)
        b = F.get(x, f)
        goes = F.when(b < 0, at(right, n)).otherwise(b > at(cut, n))
        return F.when(f < 0, n).otherwise(2 * n + goes.cast("int"))

    return F.aggregate(F.array_repeat(F.lit(0), steps), F.lit(1), step) if steps else F.lit(1)


def _added(margins: Column, x: Column, trees: list[Tree], depth: int) -> Column:
    """Margins with the values of a round's trees."""
    value = _literal([t.value for t in trees], "double")
    return F.transform(margins, lambda m, k: m + F.get(F.get(value, k), _node(trees, depth, k, x)))


def _softmax(margins: Column) -> Column:
    own = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(own, lambda e: e / F.aggregate(own, F.lit(0.0), lambda a, b: a + b))


def quantile_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 inner edges of each feature, at its quantiles; one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, 10_000).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [sorted({float(v) for v in found[i] or [] if not math.isnan(v)}) for i in range(len(features))]


def fit(rows: DataFrame, features: list[str], label: str, watched: Column, rounds: int = 50, depth: int = 6, rate: float = 0.1, patience: int = 50, bins: int = 64, penalty: float = 1.0, least_weight: float = 1.0, edges: list[list[float]] | None = None) -> BoostedTrees:
    """Boost on the rows where watched is false; stop when the log loss of the others has not fallen for so many rounds.

    Rows without a label are left out; missing feature values take the side that
    gains more. Trees after the round of the least loss are dropped. Classes are
    the distinct labels, a bounded number; a class without rows to learn from
    raises. watched rows may be none, then all rounds are kept."""
    some = rows.where(F.col(f"`{label}`").isNotNull())
    edges = quantile_edges(some, features, bins) if edges is None else edges
    known = some.groupBy(F.col(f"`{label}`").alias("c")).agg(F.count_if(~watched).alias("n")).orderBy("c").collect()
    if not known or any(r["n"] == 0 for r in known):
        raise ValueError("every class needs rows to learn from")
    model = BoostedTrees(list(features), edges, [r["c"] for r in known], depth)
    classes = len(known)
    y = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col(f"`{label}`")).cast("int") - 1
    cells = some.select(model.bins().alias("x"), y.alias("y"), F.coalesce(watched, F.lit(False)).alias("v")).groupBy("x", "y", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    now = kept(cells.withColumn("m", F.array(*[F.lit(0.0)] * classes)), "boost-cells")
    model.losses.append(_loss(now))
    best = 0
    for _ in range(rounds):
        trees = _grow(now.where("NOT v"), classes, model, depth, rate, penalty, least_weight)
        after = kept(now.withColumn("m", _added(F.col("m"), F.col("x"), trees, depth)), "boost-cells")
        dropped(now)
        now = after
        model.rounds.append(trees)
        model.losses.append(_loss(now))
        if model.losses[-1] < model.losses[best]:
            best = len(model.rounds)
        elif len(model.rounds) - best >= patience:
            break
    dropped(now)
    if not math.isnan(model.losses[0]):
        del model.rounds[best:]
    return model


def _loss(cells: DataFrame) -> float:
    """Mean log loss of the watched cells; not a number where there are none."""
    p = F.get(_softmax(F.col("m")), F.col("y"))
    s = cells.where("v").agg(F.sum(-F.col("w") * F.log(F.greatest(p, F.lit(1e-300)))), F.sum("w")).first()
    return s[0] / s[1] if s[1] else math.nan


def _grow(cells: DataFrame, classes: int, model: BoostedTrees, depth: int, rate: float, penalty: float, least: float) -> list[Tree]:
    """A round's trees, one a class, all grown together."""
    trees = [Tree.empty(depth) for _ in range(classes)]
    width = max((len(e) for e in model.edges), default=0) + 2  # bins, and the missing ones last
    p = F.posexplode(_softmax(F.col("m"))).alias("k", "p")
    rows = cells.select("x", "y", "w", p)
    rows = rows.select("k", "x", (F.col("w") * (F.col("p") - (F.col("k") == F.col("y")).cast("double"))).alias("g"), (F.col("w") * F.greatest(2 * F.col("p") * (1 - F.col("p")), F.lit(LEAST_HESSIAN))).alias("h"))
    for level in range(depth + 1):
        at = rows.withColumn("node", _node(trees, level, F.col("k"), F.col("x"))).where(F.col("node") >= 1 << level)
        if level == depth:  # all that is left are leaves
            for r in at.groupBy("k", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                trees[r["k"]].value[r["node"]] = -rate * r["g"] / (r["h"] + penalty)
            break
        sums = at.select("k", "node", F.posexplode("x").alias("f", "b"), "g", "h").groupBy("k", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found: dict[tuple[int, int], np.ndarray] = {}
        for r in sums.collect():  # at most classes * nodes * features * bins
            table = found.setdefault((r["k"], r["node"]), np.zeros((2, len(model.features), width)))
            table[:, r["f"], r["b"]] += r["g"], r["h"]
        for (k, node), (g, h) in found.items():
            split = best_split(g, h, [len(e) for e in model.edges], penalty, least)
            if split is None:
                trees[k].value[node] = float(-rate * g[0].sum() / (h[0].sum() + penalty))
            else:
                trees[k].feature[node], trees[k].bin[node], trees[k].missing_right[node] = split
        if all(t.feature[n] < 0 for t in trees for n in range(1 << level, 2 << level)):
            break
    return trees


def best_split(g: np.ndarray, h: np.ndarray, edges: list[int], penalty: float, least: float) -> tuple[int, int, bool] | None:
    """(feature, last bin of the left side, missing go right) with the most gain, or None where none gains.

    g and h are sums by feature and bin; the last column has the missing values."""
    best, most = None, 0.0
    whole_g, whole_h = g[0].sum(), h[0].sum()
    plain = whole_g**2 / (whole_h + penalty)
    for f, n in enumerate(edges):
        for right in (True, False):
            left_g = np.cumsum(g[f, :n]) + (0 if right else g[f, -1])
            left_h = np.cumsum(h[f, :n]) + (0 if right else h[f, -1])
            right_g, right_h = whole_g - left_g, whole_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - plain
            gain = np.where((left_h >= least) & (right_h >= least), gain, 0.0)
            for b, value in enumerate(gain):
                value = float(f"{value:.{DIGITS}g}")
                if value > most + 1e-12:
                    best, most = (f, b, right), value
    return best
