"""The exact bootstrap: cases drawn with replacement, at the cost of distinct cells.

Cases that agree in all metrics are one cell with a count, and drawing n cases
with replacement is a multinomial draw of counts over cells. It is made in two
steps that together are exactly that: first how many draws each of a fixed
number of parts gets, then each part spreads its own over its cells. A task holds
one part of the cells; only sums by part and resample are brought together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the cells of a group are dealt to by hash, and draws that are held at once.
PARTS, HELD = 64, 2_000_000


def _generator(*seed) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("\0".join(map(str, seed)).encode()).digest()[:16], "big"))


def resampled_sums(cases: DataFrame, columns: list[str], by: list[str], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(by, b, sums): the sums of columns over n cases drawn with replacement from the n cases of each group.

    b counts resamples from 0; b = -1 has the sums of the cases themselves. All
    columns see the same draws. Null values count as zero."""
    group = [F.col(c) for c in by]
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    key = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in by]) if by else F.lit("")
    cells = cases.select(*group, key.alias("_key"), values.alias("_v")).groupBy(*by, "_key", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(PARTS)).cast("int"))
    totals = cells.groupBy("_key", "_part").agg(F.sum("_n").alias("_n"))
    kinds = ", ".join(f"`{c}` {cases.schema[c].dataType.simpleString()}" for c in by)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """How many draws of each resample every part of a group gets."""
        pdf = pdf.sort_values("_part")
        n = pdf["_n"].to_numpy(float)
        got = _generator(seed, pdf["_key"].iloc[0]).multinomial(int(n.sum()), n / n.sum(), resamples)
        return pdf[["_key", "_part"]].assign(_got=[row.tolist() for row in got.T])

    def spread(got: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        """The sums of a part's cells for all resamples."""
        key, part, draws = pdf["_key"].iloc[0], int(pdf["_part"].iloc[0]), np.array(got["_got"].iloc[0])
        pdf = pdf.assign(_o=pdf["_v"].map(tuple)).sort_values("_o")
        v, own = np.stack(pdf["_v"].to_numpy()), pdf["_n"].to_numpy(float)
        rng, sums, step = _generator(seed, key, part), [own @ v], max(1, HELD // len(v))
        for a in range(0, resamples, step):
            sums += list(rng.multinomial(draws[a : a + step], own / own.sum()) @ v)
        out = pd.DataFrame({"b": np.arange(-1, resamples), "sums": [s.tolist() for s in sums]})
        for c in by:
            out[c] = [pdf[c].iloc[0]] * len(out)
        return out[[*by, "b", "sums"]]

    dealt = totals.groupBy("_key").applyInPandas(deal, "_key string, _part int, _got array<bigint>")  # PARTS numbers a group
    drawn = dealt.groupBy("_key", "_part").cogroup(cells.groupBy("_key", "_part")).applyInPandas(spread, f"{kinds + ', ' if by else ''}b int, sums array<double>")
    added = [F.sum(F.col("sums")[i]) for i in range(len(columns))]
    return drawn.groupBy(*by, "b").agg(F.array(*added).alias("sums"))


def bootstrap(cases: DataFrame, ratios: dict[str, tuple[str, str]], by: list[str] | None = None, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(by, metric, value, low, high): percentile intervals of ratios of sums, 95 %, cases drawn with replacement.

    ratios maps a metric's name to its columns of numerator and denominator; all
    see the same resamples. Resamples in which a denominator adds up to 0 are
    left out of its interval; a value over 0 is null. No cases give no rows."""
    by = by or []
    columns = [c for pair in ratios.values() for c in pair]
    sums = resampled_sums(cases, columns, by, resamples, seed)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(F.col("sums")[2 * i], F.col("sums")[2 * i + 1]).alias("r")) for i, m in enumerate(ratios)]))
    rows = sums.select(*by, "b", each.alias("e")).select(*by, "b", "e.*")
    drawn = F.when(F.col("b") >= 0, F.col("r"))
    return rows.groupBy(*by, "metric").agg(F.max(F.when(F.col("b") < 0, F.col("r"))).alias("value"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))


def differences(cases: DataFrame, metrics: dict[str, tuple[str, str, str]], by: list[str] | None = None, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(by, metric, value, low, high, excludes_zero, better) of paired differences b - a.

    metrics maps a name to the columns of a, of b and of the denominator that
    both share. better is a, b or neither, as the interval says."""
    rows, ratios = cases, {}
    for i, (name, (a, b, den)) in enumerate(metrics.items()):
        rows = rows.withColumn(f"_d{i}", F.col(b).cast("double") - F.col(a).cast("double"))
        ratios[name] = (f"_d{i}", den)
    out = bootstrap(rows, ratios, by, resamples, seed)
    side = F.when(F.col("low") > 0, "b").when(F.col("high") < 0, "a").otherwise("neither")
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0)).withColumn("better", side)
