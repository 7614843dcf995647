"""Gates, rules and fallbacks: what may be read, shown, configured or delivered, as columns and small tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validate", "test")


def check_split(split: str, *, test_open: bool) -> str:
    """The split's name, if it may be read; called before any file of it is opened."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, not one of {SPLITS}")
    if split == "test" and not test_open:
        raise PermissionError("the test split is closed until its evaluation begins")
    return split


def split_gate(split: Column, test_open: Column) -> Column:
    """read, closed or unknown: what check_split decides, as a column."""
    return F.when(~split.isin(*SPLITS) | split.isNull(), "unknown").when((split == "test") & ~test_open, "closed").otherwise("read")


def _path(c: Column) -> Column:
    """A path with forward slashes, without empty and single-dot parts."""
    p = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"/(\./)+|/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"(?<=.)/\.?$", "")


def calibrator_mismatch(expected: Iterable[str] = ("kind", "backend", "model_dir", "alpha")) -> Column:
    """The first of the expected keys in which a calibrator (column key) isn't what the system (column want_key) needs, or null.

    A value that is missing on either side never matches an alpha or a folder."""
    tests = []
    for k in expected:
        have, want = F.col(k), F.col(f"want_{k}")
        same = F.abs(have - want) <= 1e-9 if k == "alpha" else _path(have) == _path(want) if k == "model_dir" else have.eqNullSafe(want)
        tests.append(F.when(~F.coalesce(same, F.lit(False)), F.lit(k)))
    return F.coalesce(*tests)


def shown_probability(calibrated: Column, mute: Column, graph_ok: Column, fitted: Column) -> Column:
    """The calibrated probability beside a rank, null where the score isn't the one that the calibrator was fitted to."""
    return F.when(~mute & graph_ok & fitted, calibrated)


def retrieval_rule(methods: DataFrame) -> DataFrame:
    """(configured, replaced, precision, team_decides) from (method, difference, low, high, precision).

    The hybrid stays unless a method alone is better with an interval that
    excludes 0; of several the one with the largest difference, then by name."""
    better = (F.col("method") != "hybrid") & (F.col("low") > 0)
    best = F.max(F.when(better, F.struct("difference", F.col("method").alias("m")))).alias("best")
    one = methods.agg(best).select(F.coalesce("best.m", F.lit("hybrid")).alias("method"), F.col("best").isNotNull().alias("replaced"))
    return methods.join(one, "method").select(F.col("method").alias("configured"), "replaced", "precision", (F.col("precision") < 0.5).alias("team_decides"))


def checkpoint(arms: DataFrame, rate: float = 0.2, failed: float = 0.1) -> DataFrame:
    """(arm, passed, reasons) from (arm, cases, claims, unsupported, failed, delivered): why an arm's answers may not be used."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("cases") == 0, "did not run"),
            F.when((F.col("cases") > 0) & (F.col("claims") == 0), "no claim to judge"),
            F.when(F.try_divide(F.col("unsupported"), F.col("claims")) >= rate, "unsupported claims"),
            F.when(F.try_divide(F.col("failed"), F.col("cases")) > failed, "failed calls"),
            F.when(F.col("delivered") > 0, "a defect was delivered"),
        )
    )
    return arms.select("arm", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def paired_claims(pairs: DataFrame) -> DataFrame:
    """(supported, tested) over (alone, grounded, low, high): supported only if all pairs were tested and each interval lies above 0."""
    return pairs.agg((F.count_if(F.col("low") > 0) == F.count(F.lit(1))).alias("supported"), F.count("low").alias("tested"))


def fallback_reason(client: Column, candidates: Column, late: Column, text: Column, treatment: Column, grounded: Column, unsupported: Column) -> Column:
    """Why the template's explanation stands in for a written one, the first reason that holds, or null."""
    return (
        F.when(~client, "no client")
        .when(candidates == 0, "nothing to explain")
        .when(late, "answered after its timeout")
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "no text")
        .when(treatment, "treatment language")
        .when(~grounded | (unsupported > 0), "not grounded")
    )


def facts_to_edges(facts: DataFrame, registry: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Edges of hand-written facts (condition_id, concept_id, strength, reference), and the facts that are refused with why.

    Facts of one pair are one edge with the greatest weight and all references in order."""
    weight = F.coalesce(*[F.when(F.col("strength") == k, F.lit(v)) for k, v in weights.items()])
    known = facts.join(registry.select("condition_id", F.lit(True).alias("known")), "condition_id", "left").withColumn("weight", weight)
    problem = F.when(F.col("known").isNull(), "unknown condition").when(F.col("weight").isNull(), "unknown strength").when(F.trim(F.coalesce("reference", F.lit(""))) == "", "no reference")
    judged = known.withColumn("problem", problem)
    good = judged.where("problem IS NULL").groupBy("condition_id", "concept_id").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("reference")).alias("sources"))
    return good, judged.where("problem IS NOT NULL").select("condition_id", "concept_id", "problem")


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """(n, missing, differing) of two implementations of one value."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap.isNull()).alias("missing"), F.count_if(gap > tolerance).alias("differing"))


#: Misses of the comparator under which a share's test can't be reached, and the level of a test. Fixed values.
UNREACHABLE, SIGNIFICANT = 5, 0.05


def verdicts(checks: DataFrame) -> DataFrame:
    """(claim, status, checks, failed, failed_at_a_ceiling) of the checks of each claim.

    checks is (claim, metric, rule, a, b, cases, p): `significant` asks for a over
    b and a test under SIGNIFICANT, `higher` for a over b. A failed check is at a
    ceiling where b is perfect, or, but for metric mrr, misses too few cases for a
    test. A claim is supported if all its checks pass; nulls fail."""
    better = F.col("a") > F.col("b")
    passed = F.coalesce(F.when(F.col("rule") == "significant", better & (F.col("p") < SIGNIFICANT)).otherwise(better), F.lit(False))
    ceiling = F.coalesce((F.col("b") >= 1) | ((F.col("metric") != "mrr") & (F.round((1 - F.col("b")) * F.col("cases")) <= UNREACHABLE)), F.lit(False))
    status = F.when(F.min(passed.cast("int")) == 1, "supported").otherwise("not supported")
    return checks.groupBy("claim").agg(status.alias("status"), F.count(F.lit(1)).alias("checks"), F.count_if(~passed).alias("failed"), F.count_if(~passed & ceiling).alias("failed_at_a_ceiling"))


def sheet_problems(sheet: DataFrame, key: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(joined, problems) of a filled-in sheet and its key.

    joined has the rows whose id both have exactly once; problems (id, problem,
    n) all others: missing and unknown ids, ids that repeat in either, rows
    without an id."""
    n = lambda df, name: df.groupBy(id_col).agg(F.count(F.lit(1)).alias(name))
    both = n(sheet, "_s").withColumnRenamed(id_col, "id").join(n(key, "_k").withColumnRenamed(id_col, "_id"), F.col("id").eqNullSafe(F.col("_id")), "full")
    both = both.select(F.coalesce("id", "_id").alias("id"), F.coalesce("_s", F.lit(0)).alias("_s"), F.coalesce("_k", F.lit(0)).alias("_k"))
    tests = [("no id", F.col("id").isNull(), F.col("_s") + F.col("_k")), ("missing", F.col("id").isNotNull() & (F.col("_s") == 0), F.col("_k")), ("unknown", F.col("id").isNotNull() & (F.col("_k") == 0), F.col("_s")), ("repeated in the sheet", F.col("id").isNotNull() & (F.col("_s") > 1), F.col("_s")), ("repeated in the key", F.col("id").isNotNull() & (F.col("_k") > 1), F.col("_k"))]
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(name).alias("problem"), c.alias("n"))) for name, t, c in tests]))
    problems = both.select("id", F.explode(found).alias("p")).select("id", "p.*")
    good = both.where("id IS NOT NULL AND _s = 1 AND _k = 1").select(F.col("id").alias(id_col))
    return sheet.join(good, id_col).join(key, id_col), problems


def consensus(first: DataFrame, second: DataFrame, settled: DataFrame, grades: int = 3) -> tuple[DataFrame, DataFrame]:
    """(grades, problems) of two judges' rows(item, grade) and the settled ones.

    Equal grades stand; others need one settled grade. Problems (item, problem):
    judged by one only, not settled, settled though agreed, settled twice, settled
    without being judged, a grade outside 0 to grades - 1. Items with a problem
    get no grade."""
    one = lambda df, name: df.groupBy("item").agg(F.max("grade").alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
    rows = one(first, "a").join(one(second, "b"), "item", "full").join(one(settled, "s"), "item", "full")
    a, b, s = (F.col(c) for c in "abs")
    outside = lambda x: F.coalesce(~x.between(0, grades - 1), F.lit(False))
    tests = [("judged by one only", (a.isNull() != b.isNull())), ("settled without being judged", a.isNull() & b.isNull()), ("not settled", a.isNotNull() & b.isNotNull() & (a != b) & s.isNull()), ("settled though agreed", (a == b) & s.isNotNull()), ("settled twice", F.col("s_n") > 1), ("grade out of range", outside(a) | outside(b) | outside(s))]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests]))
    rows = rows.select("item", a, b, s, found.alias("problems"))
    good = rows.where(F.size("problems") == 0).select("item", F.when(a == b, a).otherwise(s).alias("grade"))
    return good, rows.select("item", F.explode("problems").alias("problem"))
