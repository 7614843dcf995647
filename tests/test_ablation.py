"""Systems, weights and the choice of a weight against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import ablation as B
from sextant.operators import fusion as P


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p, other = ([None if j == 3 else rng.choice([0.0, 0.2, rng.random()]) for j in range(4)] for _ in range(2))
        if i % 9 == 0:
            p = [0.25, 0.25, 0.25, None]
        if i % 11 == 0:
            p = [0.0, 0.0, 0.0, None]
        rows.append((i, [0.4, 1.0][i % 2], p, other, [round(rng.uniform(-900, 0), 3) if rng.random() < 0.2 else -1.0 * rng.randrange(4) for _ in range(4)], [rng.random() < 0.2 for _ in range(4)], rng.randrange(4), rng.random() < 0.5, i % 7 == 0))
    return rows


SCHEMA = "case_id int, level double, p array<double>, other array<double>, kg array<double>, flagged array<boolean>, truth int, critical boolean, golden boolean"


def test_fusing_rows_equals_fusing_in_long_form(spark):
    rows = made(60)
    long = spark.createDataFrame([(r[0], j, r[2][j], r[4][j], r[2][j] is not None) for r in rows for j in range(4)], "case_id int, ord int, p double, kg double, in_model boolean")
    p, kg = (np.array([[math.nan if v is None else v for v in r[c]] for r in rows], float) for c in (2, 4))
    for alpha in (0.0, 0.05, 0.5, 1.0):
        want = {(r.case_id, r.ord): r.fused for r in P.opinion_pool(long, F.lit(alpha)).collect()}
        got = B.fused_scores(p, kg, alpha)
        assert max(abs(got[i, j] - want[i, j]) for i in range(60) for j in range(4)) < 1e-9


def plain_rank(scores, truth, flags=None):
    order = sorted(range(4), key=lambda j: (-(flags[j] if flags else 0), -round(scores[j], 9), j))
    return order.index(truth) + 1


def test_systems_rank_as_by_sorting(spark):
    rows = made(80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.case_id, r.system): r["rank"] for r in B.system_ranks(df, B.systems(0.05, 0.5), ["case_id"]).collect()}
    assert len(got) == 80 * 10
    for r in rows:
        i, p, other, kg, flags, truth = r[0], r[2], r[3], r[4], r[5], r[6]
        matrix = lambda v: np.array([[math.nan if x is None else x for x in v]], float)
        fused = {(m, a): B.fused_scores(matrix(p if m == "p" else other), matrix(kg), a)[0] for m, a in (("p", 0.05), ("other", 0.5), ("other", 0.05))}
        known = [x for x in p if x is not None]
        alone = [-700.0] * 4 if sum(known) <= 0 or max(known) - min(known) < 1e-12 else [-700.0 if not x else max(math.log(x), -700) for x in p]
        want = {"A0": (fused["p", 0.05], flags), "A4": (fused["p", 0.05], None), "A7": (fused["other", 0.5], flags), "A7 (A0's alpha)": (fused["other", 0.05], flags), "A1": (alone, None), "A1b": (alone, flags), "A2": (kg, flags), "graph": (kg, None), "model": ([-1 if x is None else x for x in p], None), "other": ([-1 if x is None else x for x in other], None)}
        for name, (scores, f) in want.items():
            if name == "A2" and min(kg) < -600:
                continue  # the posterior is floored there
            assert got[i, name] == plain_rank(scores, truth, f), (i, name)
    swept = {(r.case_id, r.alpha): r["rank"] for r in B.weight_sweep(df, [0.05, 0.5], ["case_id"]).collect()}
    assert all(swept[r[0], 0.05] == got[r[0], "A4"] for r in rows)
    assert B.system_ranks(df.where("false"), B.systems(0.05, 0.5), ["case_id"]).collect() == []


@pytest.mark.parametrize(("golden", "floor", "want"), [((1, 1, 1), 0.5, (0.1, "highest mean MRR")), ((1, 0, 1), 0.5, (0.2, "highest mean MRR")), ((1, 1, 1), 0.95, (0.2, "no weight met")), ((0, 0, 0), 0.1, (None, "no weight keeps"))])
def test_the_weight_is_chosen_by_the_rule(spark, golden, floor, want):
    points = [(0.0, 1.0, 0.5, 0.8), (0.0, 0.4, 0.4, 0.4), (0.1, 1.0, 0.5, 0.8), (0.1, 0.4, 0.7, 0.6), (0.2, 1.0, 0.6, 0.9), (0.2, 0.4, 0.6, 0.6)]
    got = B.choose_weight(spark.createDataFrame(points, "alpha double, level double, mrr double, recall double"), spark.createDataFrame([(1.0, floor), (0.4, floor)], "level double, floor double"), spark.createDataFrame([(a, bool(g)) for a, g in zip((0.0, 0.1, 0.2), golden)], "alpha double, holds boolean")).collect()
    assert len(got) == 1 and got[0].alpha == want[0] and got[0].rule.startswith(want[1])
