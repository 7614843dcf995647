"""Systems with parts left out, at several levels of evidence, and the choice of the pool's weight.

A case is one row: arrays over the registry's conditions in their order hold the
model's probabilities (null where it can't score), the graph's scores and the
flags. Fusing for many weights and ranking the true condition are sums over such
rows' matrices, so nothing is sorted, and nothing shuffled but sums by system.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.fusion import FLAT, FLOOR, LEAST_SCORE

#: Decimals of a score that count when conditions are ranked.
DECIMALS = 9


def case_rows(scores: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each of keys, with every column as an array in the order of ord."""
    whole = F.sort_array(F.collect_list(F.struct("ord", *columns)))
    rows = scores.groupBy(*keys).agg(whole.alias("_r"))
    return rows.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def _log_sum(x: np.ndarray) -> np.ndarray:
    """ln of the sum of exp over each row's values that are there; less than any number where none is."""
    there = np.where(np.isnan(x), -np.inf, x)
    top = there.max(axis=1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(there - top).sum(axis=1, keepdims=True))


def mute(p: np.ndarray) -> np.ndarray:
    """Whether a model says nothing of a row: no mass, or the same for all it can score."""
    known = ~np.isnan(p)
    spread = np.where(known, p, -np.inf).max(axis=1) - np.where(known, p, np.inf).min(axis=1)
    return ~known.any(axis=1) | (np.nansum(p, axis=1) <= 0) | (spread < FLAT)


def graph_scores(kg: np.ndarray) -> np.ndarray:
    """The graph's posterior, as logs."""
    return np.maximum(kg - _log_sum(kg), LEAST_SCORE)


def _logs(p: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(p), np.nan, np.where(p > 0, np.log(np.where(p > 0, p, 1.0)), LEAST_SCORE))


def model_scores(p: np.ndarray) -> np.ndarray:
    """The model's logs; what it can't score, and rows where it is mute, at the least score."""
    logs = np.maximum(np.nan_to_num(_logs(p), nan=LEAST_SCORE), LEAST_SCORE)
    return np.where(mute(p)[:, None], LEAST_SCORE, logs)


def fused_scores(p: np.ndarray, kg: np.ndarray, alpha: float) -> np.ndarray:
    """The pool of fusion.opinion_pool over matrices; alpha is the graph's share, NaN what the model can't score."""
    own, known = kg - _log_sum(kg), ~np.isnan(p)
    if alpha == 1:
        return np.maximum(own, LEAST_SCORE)
    log = _logs(p) if alpha == 0 else np.log(np.maximum(p, FLOOR))
    t = np.where(known, (1 - alpha) * log + alpha * own, np.nan)
    silent = mute(p)[:, None]
    pooled = np.where(silent, 0.0, _log_sum(np.where(known, own, np.nan))) + t - np.where(silent, 0.0, _log_sum(t))
    return np.maximum(np.where(silent | ~known, own, pooled), LEAST_SCORE)


def ranks_of(scores: np.ndarray, truth: np.ndarray, flags: np.ndarray | None = None) -> np.ndarray:
    """The rank of each row's condition at place truth (from 0): flagged ones first if flags are given, ties by the registry's order."""
    near, rows, place = np.round(scores, DECIMALS), np.arange(len(truth)), np.arange(scores.shape[1])[None, :]
    own = near[rows, truth][:, None]
    ahead = (near > own) | ((near == own) & (place < truth[:, None]))
    if flags is not None:
        mine = flags[rows, truth][:, None]
        ahead = (flags & ~mine) | ((flags == mine) & ahead)
    return 1 + ahead.sum(axis=1)


#: What each ablation keeps: the model or another one, the graph, the flags. Fixed values.
SPECS = {"A0": ("p", True, True), "A1": ("p", False, False), "A1b": ("p", False, True), "A2": (None, True, True), "A4": ("p", True, False), "A7": ("other", True, True)}


def systems(alpha: float, other_alpha: float) -> dict[str, tuple[str | None, bool, bool, float]]:
    """Each ablation's model, graph, flags and weight; A7 also at the first model's weight."""
    out = {name: (*spec, other_alpha if spec[0] == "other" else alpha) for name, spec in SPECS.items()}
    return out | {"A7 (A0's alpha)": ("other", True, True, alpha)}


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix, nulls as NaN, column by column: sums over a row's few values are then sums of columns."""
    return np.asfortranarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _ranked(cases: DataFrame, keep: list[str], names: list, ranks: Callable[[dict[str, np.ndarray]], list[np.ndarray]], name: str, counted: bool = False) -> DataFrame:
    """keep, and a row with its rank for each of names; ranks makes them of a batch's matrices.

    With counted, a row of each of keep, name and rank, with the number n of such cases."""
    used = [c for c in ("p", "other", "kg") if c in cases.columns]
    kinds = ", ".join(f"`{c}` {cases.schema[c].dataType.simpleString()}" for c in keep)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                m = {c: _matrix(b.column(c)) for c in used} | {"truth": b.column("truth").to_numpy(zero_copy_only=False).astype(int), "flagged": _matrix(b.column("flagged").cast(pa.list_(pa.int8()))) > 0}
                yield b, np.stack(ranks(m), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, r in matrices(batches):
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * r.shape[1], pa.int32()), pa.array(r.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), each], [*keep, "ranks"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, r in matrices(batches):
            group = pa.Table.from_batches([b.select(keep)]).append_column("_i", pa.array(np.arange(len(r)))).group_by(keep, use_threads=False).aggregate([("_i", "list")])
            cells = [(g, i, *x) for g, rows in enumerate(group.column("_i_list").to_pylist()) for i, own in enumerate(r[rows].T) for x in zip(*np.unique(own, return_counts=True), strict=True)]
            at, i, rank, n = (np.array(c) for c in zip(*cells, strict=True))
            kept = group.select(keep).take(pa.array(at)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(i, pa.int32()), pa.array(rank, pa.int32()), pa.array(n, pa.int64())], [*keep, "_i", "rank", "n"])

    rows = cases.select(*keep, *used, "truth", "flagged")
    called = F.array(*map(F.lit, names))
    if counted:
        out = rows.mapInArrow(count, f"{kinds}, _i int, rank int, n bigint").groupBy(*keep, "_i", "rank").agg(F.sum("n").alias("n"))
        return out.select(*keep, F.get(called, F.col("_i")).alias(name), "rank", "n")
    out = rows.mapInArrow(run, f"{kinds}, ranks array<int>")
    return out.select(*keep, F.explode(F.arrays_zip(called.alias(name), F.col("ranks").alias("rank"))).alias("_e")).select(*keep, "_e.*")


def fused(cases: DataFrame, alpha: float, keep: list[str]) -> DataFrame:
    """(keep, fused, first, share): fusion.opinion_pool of each case where it is read, an array in the order of conditions.

    first is the place, from 0, of the condition with the highest share of the
    pool, ties by the registry's order; share is rounded as ranks are."""
    kinds = ", ".join(f"`{c}` {cases.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scores = fused_scores(_matrix(b.column("p")), _matrix(b.column("kg")), alpha)
                raised = np.exp(scores)
                shares = np.round(raised / raised.sum(axis=1, keepdims=True), DECIMALS)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), each, pa.array(shares.argmax(axis=1), pa.int32()), pa.array(shares.max(axis=1))], [*keep, "fused", "first", "share"])

    return cases.select(*keep, "p", "kg").mapInArrow(run, f"{kinds}, fused array<double>, first int, share double")


def system_ranks(cases: DataFrame, chosen: dict[str, tuple[str | None, bool, bool, float]], keep: list[str], counted: bool = False) -> DataFrame:
    """(keep, system, rank) of the true condition by every system, and by the graph and either model alone; with counted one row of all equal ones, and their number n."""
    def ranks(m: dict[str, np.ndarray]) -> list[np.ndarray]:
        out = []
        for model, graph, flags, alpha in chosen.values():
            scores = fused_scores(m[model], m["kg"], alpha) if model and graph else model_scores(m[model]) if model else graph_scores(m["kg"])
            out.append(ranks_of(scores, m["truth"], m["flagged"] if flags else None))
        return out + [ranks_of(m["kg"], m["truth"])] + [ranks_of(np.nan_to_num(m[c], nan=-1.0), m["truth"]) for c in ("p", "other")]

    return _ranked(cases, keep, [*chosen, "graph", "model", "other"], ranks, "system", counted)


def weight_sweep(cases: DataFrame, alphas: list[float], keep: list[str], flags: bool = False, counted: bool = False) -> DataFrame:
    """(keep, alpha, rank) of the true condition for every weight of the graph; with counted one row of all equal ones, and their number n."""
    return _ranked(cases, keep, alphas, lambda m: [ranks_of(fused_scores(m["p"], m["kg"], a), m["truth"], m["flagged"] if flags else None) for a in alphas], "alpha", counted)


def choose_weight(points: DataFrame, floors: DataFrame, golden: DataFrame) -> DataFrame:
    """(alpha, rule): the weight by the rule fixed beforehand.

    points is (alpha, level, mrr, recall), floors (level, floor), golden (alpha,
    holds). Of the weights at which all golden cases hold and whose recall is at
    the floor on every level, that of the best mean MRR; if there is none, of
    those at which the golden cases hold that of the best mean recall, then MRR;
    ties to the smaller weight. Where golden cases hold nowhere alpha is null."""
    each = points.join(floors, "level").groupBy("alpha").agg(F.avg("mrr").alias("mrr"), F.avg("recall").alias("recall"), F.min((F.col("recall") >= F.col("floor")).cast("int")).alias("safe"))
    kept = each.join(golden.where("holds"), "alpha").withColumn("mrr", F.round("mrr", DECIMALS)).withColumn("recall", F.round("recall", DECIMALS))
    safe = F.when(F.col("safe") == 1, F.struct("mrr", -F.col("alpha")))
    best = kept.agg(F.max_by("alpha", safe).alias("good"), F.max_by("alpha", F.struct("recall", "mrr", -F.col("alpha"))).alias("next"), F.coalesce(F.max("safe"), F.lit(0)).alias("any"), F.count(F.lit(1)).alias("n"))
    rule = F.when(F.col("n") == 0, "no weight keeps every golden case").when(F.col("any") == 1, "highest mean MRR meeting the constraint").otherwise("no weight met the constraint: highest mean recall")
    return best.select(F.when(F.col("any") == 1, F.col("good")).otherwise(F.col("next")).alias("alpha"), rule.alias("rule"))
