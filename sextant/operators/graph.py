"""The evidence graph as edge tables: merging, closure and naive-Bayes scores."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.shared import kept

#: What a present finding without an edge, and at most any edge, counts.
LEAK, CAP = 0.01, 0.9


def band(share: Column, bands: list[tuple[float, float]]) -> Column:
    """The weight of the first band that the share reaches."""
    out = F.lit(None).cast("double")
    for least, weight in reversed(bands):
        out = F.when(share >= least, F.lit(weight)).otherwise(out)
    return out


def strongest_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("condition_id", "concept_id").agg(F.max("weight").alias("weight"))


def naive_bayes(cases: DataFrame, present: DataFrame, edges: DataFrame, conditions: DataFrame) -> DataFrame:
    """(case_id, ord, condition_id, kg) of every case and condition; no evidence scores 0.

    A case's evidence starts from LEAK for each finding and every edge corrects
    it. conditions(ord, condition_id) is the registry, a dimension of some dozens
    of rows: each is a column of a concept's corrections, so that findings meet
    one row of each concept and a case is one row of one shuffle."""
    known = sorted(tuple(r) for r in conditions.select("ord", "condition_id").collect())
    kind = ", ".join(f"{n}:{conditions.schema[n].dataType.simpleString()}" for n in ("ord", "condition_id"))
    part = F.log(F.greatest(F.least(F.col("weight"), F.lit(CAP)), F.lit(LEAK))) - F.log(F.lit(LEAK))
    names = [f"_{i}" for i in range(len(known))]
    k = F.count(F.lit(1)).alias("k")
    corrections = edges.groupBy("concept_id").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.when(F.col("condition_id") == c, part)).alias(n) for n, (_, c) in zip(names, known)])
    found = present.join(corrections, "concept_id", "left").groupBy("case_id").agg(k, *[F.sum(n).alias(n) for n in names])
    leak = F.coalesce("k", F.lit(0)) * F.log(F.lit(LEAK))
    scores = [F.struct(F.lit(o).alias("ord"), F.lit(c).alias("condition_id"), F.round(leak + F.coalesce(n, F.lit(0.0)) + 0.0, 9).alias("kg")) for n, (o, c) in zip(names, known)]
    return cases.join(found, "case_id", "left").select("case_id", F.inline(F.array(*scores).cast(f"array<struct<{kind}, kg:double>>")))


def naive_bayes_levels(cases: DataFrame, keep: list[str], levels: list[float], edges: DataFrame, conditions: list[str], case_id: str = "case_id", tokens: str = "raws") -> DataFrame:
    """(keep, levels): naive_bayes() of every case at several levels of evidence, a map of arrays in the order of conditions.

    cases has an array of each case's tokens, null where it has none. A level
    keeps a token if the first 32 bits of the MD5 of case and token are less than
    that share; if all are 1, nothing is drawn. Each case is scored where it is
    read: nothing is shuffled. The graph's concepts are a dimension, whose
    corrections go along."""
    part = F.log(F.greatest(F.least(F.col("weight"), F.lit(CAP)), F.lit(LEAK))) - F.log(F.lit(LEAK))
    known: dict[str, np.ndarray] = {}
    for concept, condition, value in edges.select("concept_id", "condition_id", part.alias("v")).where("v IS NOT NULL").collect():
        if condition in conditions:
            known.setdefault(concept, np.zeros(len(conditions)))[conditions.index(condition)] += value
    kinds = ", ".join(f"`{c}` {cases.schema[c].dataType.simpleString()}" for c in keep)
    names = F.array(*map(F.lit, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("_tokens")
            sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
            case, flat = np.repeat(np.arange(b.num_rows), sizes), own.flatten().dictionary_encode()
            table = np.array([known.get(x, np.zeros(len(conditions))) for x in flat.dictionary.to_pylist()]).reshape(-1, len(conditions))
            at = flat.indices.to_numpy(zero_copy_only=False)
            drawn = np.zeros(len(at))
            if min(levels) < 1:
                ids, texts = [x.encode() + b":" for x in b.column("_id").to_pylist()], [x.encode() for x in flat.dictionary.to_pylist()]
                digests = b"".join([hashlib.md5(ids[i] + texts[j]).digest()[:4] for i, j in zip(case.tolist(), at.tolist(), strict=True)])
                drawn = np.frombuffer(digests, ">u4") / 4294967296.0
            out = np.empty((b.num_rows, len(levels), len(conditions)))
            for k, level in enumerate(levels):
                some = drawn < level
                rows, places = case[some], at[some]
                count = np.bincount(rows, minlength=b.num_rows)
                for c in range(len(conditions)):
                    out[:, k, c] = count * math.log(LEAK) + np.bincount(rows, table[places, c], b.num_rows)
            flat_out = pa.array(np.round(out, 9).ravel() + 0.0)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows * len(levels) + 1) * len(conditions), pa.int32()), flat_out)
            outer = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(levels), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), outer], [*keep, "_scores"])

    rows = cases.select(*keep, F.coalesce(F.col(case_id).cast("string"), F.lit("")).alias("_id"), F.array_compact(tokens).alias("_tokens"))
    return rows.mapInArrow(run, f"{kinds}, _scores array<array<double>>").select(*keep, F.map_from_arrays(names, "_scores").alias("levels"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """First source wins; a node that sources type differently is an anomaly."""
    return nodes.groupBy("id").agg(F.min_by("type", "src_ord").alias("type"), (F.count_distinct("type") > 1).alias("anomaly"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Pairs that one source states more than once."""
    return edges.groupBy("condition_id", "concept_id", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def noisy_or(rows: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    return rows.groupBy(*by).agg((1 - F.product(1 - F.col(weight))).alias("p"))


def usable(findings: DataFrame) -> DataFrame:
    """Findings without those that are both present and absent."""
    both = findings.groupBy("case_id", "concept_id").agg(F.count_distinct("assertion").alias("n"), F.first("assertion").alias("assertion"))
    return both.where("n = 1").drop("n")


def log_part(weight: Column) -> Column:
    """What a present finding adds to a condition's score; without an edge it counts as LEAK."""
    return F.log(F.greatest(F.least(F.coalesce(weight, F.lit(LEAK)), F.lit(CAP)), F.lit(LEAK)))


def contributions(present: DataFrame, edges: DataFrame, strong: float = 0.65) -> DataFrame:
    """(case_id, condition_id, concept_id, kind, part) of present(case_id, condition_id, concept_id).

    kind is strong, weak or none, by the edge's weight; the parts of a case add
    up to its score for the condition."""
    found = present.join(edges, ["condition_id", "concept_id"], "left")
    kind = F.when(F.col("weight").isNull(), "none").when(F.col("weight") >= strong, "strong").otherwise("weak")
    return found.select("case_id", "condition_id", "concept_id", kind.alias("kind"), log_part(F.col("weight")).alias("part"))


def occlusion(present: DataFrame, edges: DataFrame, conditions: DataFrame, of: str | None = None) -> DataFrame:
    """(case_id, concept_id, condition_id, effect): by how much a finding raises a condition's log-odds.

    Each case is scored with all its findings and without each single one; the
    effect is the difference of the log-odds of the softmax over conditions.
    Conditions are a registry, as for naive_bayes: each is a column, and findings
    go through one shuffle, by case. With of, a column of present that names a
    condition, only that one's effect is a row, none where it isn't in the registry."""
    known = [r[0] for r in conditions.select("condition_id").distinct().orderBy("condition_id").collect()]
    if not known:
        return present.select("case_id", "concept_id", F.lit(None).cast("string").alias("condition_id"), F.lit(None).cast("double").alias("effect")).where("false")
    names, leak = [f"_{i}" for i in range(len(known))], F.log(F.lit(LEAK))
    parts = edges.groupBy("concept_id").agg(*[F.max(F.when(F.col("condition_id") == c, log_part(F.col("weight")))).alias(n) for n, c in zip(names, known, strict=True)])
    keep = ["case_id", "concept_id", *([of] if of else [])]
    rows = present.select(*keep).join(kept(parts, "parts"), "concept_id", "left").select(*keep, *[F.coalesce(n, leak).alias(n) for n in names])
    own = Window.partitionBy("case_id")
    rows = rows.select(*keep, *names, *[F.sum(n).over(own).alias(f"w{n}") for n in names])

    def log_odds(scores: list[Column]) -> list[Column]:
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        raised = [F.exp(x - top) for x in scores]
        total = sum(raised[1:], raised[0])
        return [F.log(x) - F.log(total - x) for x in raised]

    pairs = list(zip(log_odds([F.col(f"w{n}") for n in names]), log_odds([F.col(f"w{n}") - F.col(n) for n in names]), strict=True))
    effects = [F.struct(F.lit(c).alias("condition_id"), (whole - less).alias("effect")) for c, (whole, less) in zip(known, pairs, strict=True)]
    if of:
        chosen = F.coalesce(*[F.when(F.col(of) == c, e) for c, e in zip(known, effects, strict=True)])
        return rows.select("case_id", "concept_id", chosen.alias("_e")).where("_e IS NOT NULL").select("case_id", "concept_id", "_e.*")
    return rows.select("case_id", "concept_id", F.inline(F.array(*effects)))


def crosswalk_problems(edges: DataFrame, specs: DataFrame, conditions: int) -> DataFrame:
    """(concept_id, problem): every way in which a mapped concept breaks the rules, one row each."""
    code, value = F.substring_index("concept_id", "_@_", 1), F.when(F.contains("concept_id", F.lit("_@_")), F.substring_index("concept_id", "_@_", -1))
    k = edges.groupBy("concept_id").agg(F.count_distinct("condition_id").alias("n_conditions"), F.count_distinct("source").alias("n_sources"))
    k = k.withColumns({"code": code, "value": value}).join(specs.select("code", "default_value", F.lit(True).alias("known")), "code", "left")
    tests = [("unknown code", F.col("known").isNull()), ("default value", F.col("value") == F.col("default_value")), ("one source", F.col("n_sources") == 1), ("some conditions only", F.col("n_conditions") < conditions)]
    return k.select("concept_id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))).alias("problem"))


def path_scores(present: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, condition_id, score): what the paths from findings to a condition add up to."""
    return present.join(edges, "concept_id").groupBy("case_id", "condition_id").agg(F.sum(log_part(F.col("weight")) - F.log(F.lit(LEAK))).alias("score"))


def differential(a: DataFrame, b: DataFrame, keys: list[str], value: str, part: str, tolerance: float = 1e-9) -> DataFrame:
    """(part, compared, differing, most) of two stores' rows: rows of one side only differ."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("compared"), F.count_if(gap.isNull() | (gap > tolerance)).alias("differing"), F.round(F.max(gap), 6).alias("most"))
