"""Resampling, paired tests and fits: sums in Spark, small results on the driver."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.sources.shared import kept


def poisson_steps() -> list[float]:
    """The distribution function of a Poisson count of mean 1, at 0 to 11."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        out.append(total)
        term /= k + 1
    return out


def resampled(rows: DataFrame, key: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """Each row once for each resample b, with the count w that its key has there.

    An MD5 of key, seed and b / 4 gives four counts, so every metric, every
    partitioning and any other engine sees the same resamples. The rows are made
    and summed within a task; only sums by resample are shuffled."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.col("_c").cast("string")))
    drawn = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(resamples // 4 - 1)))).withColumn("_d", digest)
    drawn = drawn.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    u = F.conv(F.substring(F.col("_d"), 1 + 8 * F.col("_j"), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    weight = sum((F.when(F.col("_u") >= e, 1).otherwise(0) for e in poisson_steps()), F.lit(0))
    return drawn.withColumn("b", F.col("_c") * 4 + F.col("_j")).withColumn("_u", u).withColumn("w", weight).drop("_c", "_d", "_j", "_u")


def poisson_bootstrap(pairs: DataFrame, key: str, num: str, den: str, resamples: int = 200, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentile interval of a ratio of sums: each case counts Poisson(1) times in each resample.

    This is the estimator that scales; it differs from drawing n cases with
    replacement. The counts are those of resampled(), drawn and summed batch by
    batch: a row is never repeated for its resamples."""
    for c in by:
        pairs = pairs.where(F.col(c).isNotNull())
    group = F.concat_ws("\0", F.lit(""), *[F.col(c).cast("string") for c in by])
    rows = pairs.select(group.alias("_g"), F.concat_ws(":", F.col(key).cast("string"), F.lit(f"{seed}:")).alias("_k"), F.col(num).cast("double").alias("num"), F.col(den).cast("double").alias("den"))
    steps = np.array(poisson_steps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a batch by group and resample."""
        for batch in batches:
            code = batch.column("_g").dictionary_encode()
            at, keys = code.indices.to_numpy(zero_copy_only=False), [k.encode() for k in batch.column("_k").to_pylist()]
            kept_rows = [np.flatnonzero(batch.column(c).is_valid().to_numpy(zero_copy_only=False)) for c in ("num", "den")]
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("num", "den")]
            sums = np.zeros((2, resamples, len(code.dictionary)))
            for c in range(resamples // 4):
                end = str(c).encode()
                drawn = np.frombuffer(b"".join([hashlib.md5(k + end).digest() for k in keys]), ">u4").reshape(-1, 4) / 4294967296.0
                w = np.searchsorted(steps, drawn, side="right")
                for j in range(4):
                    for i, own in enumerate(kept_rows):
                        sums[i, 4 * c + j] = np.bincount(at[own], w[own, j] * values[i][own], len(code.dictionary))
            n = len(code.dictionary)
            each = [pa.array(np.tile(np.arange(resamples), n), pa.int32()), *(pa.array(sums[i].T.ravel()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(code.dictionary.to_pylist(), object), resamples), pa.string()), *each], ["_g", "b", "num", "den"])

    each = rows.mapInArrow(run, "_g string, b int, num double, den double").groupBy("_g", "b").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("r"))
    if not by:
        return pairs.agg(F.try_divide(F.sum(num), F.sum(den)).alias("value")).crossJoin(each.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high")))
    point = pairs.groupBy(*by, group.alias("_g")).agg(F.try_divide(F.sum(num), F.sum(den)).alias("value"))
    ends = each.groupBy("_g").agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))
    return point.join(ends, "_g").select(*by, "value", "low", "high")


def kappa_interval(graded: DataFrame, query: str, a: str, b: str, grades: int = 3, weights: str = "none", resamples: int = 200, seed: int = 42) -> DataFrame:
    """(value, low, high) of Cohen's kappa, the interval by resampling queries with all their rows."""
    gap = F.abs(F.col("i") - F.col("j")) / (grades - 1)
    cost = {"none": (F.col("i") != F.col("j")).cast("double"), "linear": gap, "quadratic": gap * gap}[weights]
    cells = graded.groupBy(F.col(query).alias("q"), F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    drawn = resampled(cells, "q", resamples, seed).withColumn("n", F.col("n") * F.col("w")).select("b", "i", "j", "n")
    drawn = drawn.union(cells.select(F.lit(-1), "i", "j", "n")).groupBy("b", "i", "j").agg(F.sum("n").alias("n"))
    left, right = drawn.groupBy("b", "i").agg(F.sum("n").alias("ni")), drawn.groupBy("b", "j").agg(F.sum("n").alias("nj"))
    grid = left.join(right, "b").join(drawn, ["b", "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = grid.groupBy("b").agg((1 - F.try_divide(F.sum(cost * F.col("n")) * F.sum("n"), F.sum(cost * F.col("ni") * F.col("nj")))).alias("k"))
    drawn_only = F.when(F.col("b") >= 0, F.col("k"))
    return each.agg(F.max(F.when(F.col("b") < 0, F.col("k"))).alias("value"), F.percentile(drawn_only, 0.025).alias("low"), F.percentile(drawn_only, 0.975).alias("high"))


def discordant(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """How many pairs only the one, and only the other, got right."""
    return pairs.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact binomial under 25 discordant pairs, else chi-square with continuity correction."""
    n = only_a + only_b
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(only_a, only_b) + 1)) / 2**n)
    chi = max(0, abs(only_a - only_b) - 1) ** 2 / n
    return math.erfc(math.sqrt(chi / 2))


# Coefficients of a Chebyshev fit of the complementary error function, of relative error under 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def mcnemar_column(only_a: Column, only_b: Column) -> Column:
    """mcnemar() of two counts as a column, to about seven digits."""
    n, low = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("int")
    step = lambda a, i: F.struct((a["t"] * (n - i + 1) / i).alias("t"), (a["s"] + a["t"] * (n - i + 1) / i).alias("s"))
    upto = F.when(low > 0, F.sequence(F.lit(1), F.least(low, F.lit(24)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(upto, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"])
    z = F.greatest(F.abs(only_a - only_b) - 1, F.lit(0)) / F.sqrt(2 * n)
    u = 1 / (1 + 0.5 * z)
    poly = sum((F.lit(c) * F.pow(u, F.lit(i)) for i, c in enumerate(ERFC)), F.lit(0.0))
    return F.when(n == 0, 1.0).when(n < 25, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))).otherwise(u * F.exp(-z * z + poly))


def fit_temperature(rows: DataFrame, p: str, y: str, low: float = 0.05, high: float = 20.0, points: int = 41) -> DataFrame:
    """The temperature on a logarithmic grid with the least log loss, all points in one pass."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(float(x),) for x in np.exp(np.linspace(math.log(low), math.log(high), points))], "temperature double")
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-9)), F.lit(1e-9))
    z = F.log(q / (1 - q)) / F.col("temperature")
    loss = F.avg(F.log(1 + F.exp(F.when(F.col(y), -z).otherwise(z))))
    each = rows.crossJoin(F.broadcast(grid)).groupBy("temperature").agg(loss.alias("loss"))
    return each.agg(F.min_by("temperature", F.struct("loss", "temperature")).alias("temperature"), F.min("loss").alias("loss"))


def fit_platt(rows: DataFrame, p: str, y: str, steps: int = 25) -> tuple[float, float]:
    """Platt's a and b by Newton steps that are halved until the loss doesn't rise; a step is two aggregates.

    Smoothed aims keep both finite on separable scores."""
    # every step reads the points again: equal ones are one row with a count, written once
    points = kept(rows.groupBy(F.col(p).alias("p"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")), "points")
    n = points.agg(F.sum(F.when(F.col("y"), F.col("n"))).alias("pos"), F.sum(F.when(~F.col("y"), F.col("n"))).alias("neg")).first()
    n = {c: n[c] or 0 for c in ("pos", "neg")}
    hi, lo = (n["pos"] + 1) / (n["pos"] + 2), 1 / (n["neg"] + 2)
    a, b = math.log((n["pos"] + 1) / (n["neg"] + 1)), 0.0
    aim = F.when(F.col("y"), F.lit(hi)).otherwise(F.lit(lo))
    points = points.select(F.log(F.greatest(F.col("p"), F.lit(1e-9))).alias("x"), aim.alias("t"), "n")

    def losses(places: list[tuple[float, float]]) -> list[float]:
        z = [F.lit(c) + F.lit(d) * F.col("x") for c, d in places]
        each = [F.sum(F.col("n") * (F.greatest(v, F.lit(0.0)) - v * F.col("t") + F.log1p(F.exp(-F.abs(v))))) for v in z]
        return list(points.agg(*each).first())

    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, g = F.col("n") * q * (1 - q), F.col("n") * (q - F.col("t"))
        s = points.agg(F.sum(g), F.sum(g * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        hess = np.array([[s[2] + 1e-9, s[3]], [s[3], s[4] + 1e-9]])
        da, db = np.linalg.solve(hess, np.array([s[0], s[1]]))
        # a whole step, or the largest of its halves that doesn't raise the loss: all are tried in one aggregate
        tried = [(a - float(da) / 2**k, b - float(db) / 2**k) for k in range(11)]
        now, *then = losses([(a, b), *tried])
        found = next((p for p, loss in zip(tried, then, strict=True) if loss <= now), None)
        if found is None:
            break
        moved, (a, b) = abs(found[0] - a) + abs(found[1] - b), found
        if moved < 1e-9:
            break
    return a, b


def pool_adjacent(pdf: pd.DataFrame) -> pd.DataFrame:
    """Isotonic blocks of one group's (x, y, n) rows, sorted by x: their ends, mean and weight.

    Rows may be blocks themselves, with the end in a column high."""
    blocks: list[list[float]] = []
    for x, high, y, n in pdf.assign(high=pdf.get("high", pdf["x"])).sort_values("x")[["x", "high", "y", "n"]].itertuples(index=False):
        blocks.append([x, high, y * n, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return pd.DataFrame([(b[0], b[1], b[2] / b[3], b[3]) for b in blocks], columns=["low", "high", "value", "n"])


def fit_isotonic(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Isotonic regression over the exact scores: each range of scores is pooled by itself, then the blocks of all ranges.

    Blocks of a range only ever merge further, so the result is that of one
    pass; the last task sees blocks, not scores. Null scores are left out."""
    g = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("x")).agg(F.avg(F.col(y).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("n"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in parts if len(f)]
        if frames:
            yield pool_adjacent(pd.concat(frames))

    blocks = g.repartitionByRange("x").mapInPandas(run, "low double, high double, value double, n double")
    blocks = blocks.select(F.col("low").alias("x"), "high", F.col("value").alias("y"), "n").repartition(1)
    return blocks.mapInPandas(run, "low double, high double, value double, n double").drop("n")
