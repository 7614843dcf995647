"""Boosted trees and the forward pass against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import boosting as B
from sextant.operators import transformer as X


class Naive:
    """Boosting row by row, a recursive tree at a time."""

    def __init__(self, x, y, classes, edges, rounds, depth, rate, penalty=1.0, least=1.0):
        self.x = np.array([[(-1 if v is None else sum(e < v for e in es)) for v, es in zip(r, edges)] for r in x])
        self.edges, self.penalty, self.least, self.rate = edges, penalty, least, rate
        self.m = np.zeros((len(x), classes))
        for _ in range(rounds):
            p = self.soft()
            gain = []
            for k in range(classes):
                g, h = p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
                gain.append(self.grow(np.arange(len(x)), g, h, depth))
            self.m += np.stack(gain, axis=1)

    def soft(self):
        e = np.exp(self.m - self.m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def grow(self, rows, g, h, depth):
        """What each row of the table gains; rows outside get nothing."""
        out = np.zeros(len(self.x))

        def score(i):
            return g[i].sum() ** 2 / (h[i].sum() + self.penalty)

        best = None
        if depth:
            for f, es in enumerate(self.edges):
                for right in (True, False):
                    for b in range(len(es)):
                        b_of = self.x[rows, f]
                        goes = np.where(b_of < 0, right, b_of > b)
                        l, r = rows[~goes], rows[goes]
                        if min(h[l].sum(), h[r].sum()) < self.least:
                            continue
                        won = float(f"{score(l) + score(r) - score(rows):.9g}")
                        if won > (best[0] if best else 0) + 1e-12:
                            best = (won, l, r)
        if best is None:
            out[rows] = -self.rate * g[rows].sum() / (h[rows].sum() + self.penalty)
            return out
        return self.grow(best[1], g, h, depth - 1) + self.grow(best[2], g, h, depth - 1)


def data(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.choice([None, *range(9)]), rng.uniform(0, 1)
        label = "xyz"[min(2, int(((a or 4) / 8 + b + rng.uniform(0, 0.4)) * 1.2))]
        rows.append((i, a, b, label))
    return rows


def test_trees_equal_the_naive_booster(spark):
    rows = data(300)
    df = spark.createDataFrame(rows, "id int, a int, b double, label string").repartition(3)
    edges = [[1.0, 3.0, 5.0], [0.2, 0.4, 0.6, 0.8]]
    model = B.fit(df, ["a", "b"], "label", F.lit(False), rounds=4, depth=3, rate=0.3, edges=edges)
    naive = Naive([r[1:3] for r in rows], np.array(["xyz".index(r[3]) for r in rows]), 3, edges, 4, 3, 0.3)
    got = {r.id: r.probabilities for r in model.probabilities(df).collect()}
    assert len(model.rounds) == 4 and model.classes == ["x", "y", "z"]
    assert np.abs(np.array([got[i] for i in range(300)]) - naive.soft()).max() < 1e-9
    table = model.table(spark).collect()
    assert {r["class"] for r in table} == {"x", "y", "z"} and all((r.feature is None) == (r.value is not None) for r in table)


def test_boosting_stops_when_the_watched_loss_does(spark):
    df = spark.createDataFrame([(*r, i % 4 == 0) for i, r in enumerate(data(600))], "id int, a int, b double, label string, watched boolean")
    model = B.fit(df, ["a", "b"], "label", F.col("watched"), rounds=12, depth=3, rate=0.9, patience=2, bins=16)
    assert model.losses[0] == pytest.approx(math.log(3)) and min(model.losses) < 0.75 * model.losses[0]
    assert len(model.rounds) == int(np.argmin(model.losses)) and len(model.losses) <= len(model.rounds) + 3
    p = [r.p for r in model.probabilities(df.withColumn("_x", F.lit(1)), "p").collect()]
    assert all(abs(sum(x) - 1) < 1e-9 for x in p)
    with pytest.raises(ValueError, match="class"):
        B.fit(df.withColumn("watched", F.col("label") == "x"), ["a"], "label", F.col("watched"))
    with pytest.raises(ValueError, match="class"):
        B.fit(df.where("false"), ["a"], "label", F.lit(False))


def plain_logits(w, row, token_of, heads, blocks):
    """One row by loops over tokens and heads."""
    width = len(w["cls"])

    def linear(v, name):
        return [sum(a * b for a, b in zip(line, v)) + c for line, c in zip(w[f"{name}.weight"], w[f"{name}.bias"])]

    def norm(v, name):
        mean = sum(v) / width
        var = sum((a - mean) ** 2 for a in v) / width
        return [(a - mean) / math.sqrt(var + 1e-5) * s + t for a, s, t in zip(v, w[f"{name}.weight"], w[f"{name}.bias"])]

    x = [[w["tokenizer.bias"][t][j] + sum(row[c] * w["tokenizer.weight"][c][j] for c in range(len(row)) if token_of[c] == t) for j in range(width)] for t in range(len(w["tokenizer.bias"]))]
    x.append(list(w["cls"]))
    for i in range(blocks):
        name, last = f"blocks.{i}", i == blocks - 1
        asked = [norm(v, f"{name}.attention_norm") for v in x] if i else x
        q, k, v = ([linear(a, f"{name}.attention.W_{z}") for a in asked] for z in "qkv")
        size, new = width // heads, []
        for at in [len(x) - 1] if last else range(len(x)):
            joined = []
            for h in range(heads):
                s = slice(h * size, (h + 1) * size)
                match = [math.exp(sum(a * b for a, b in zip(q[at][s], other[s])) / math.sqrt(size)) for other in k]
                joined += [sum(m / sum(match) * value[s][d] for m, value in zip(match, v)) for d in range(size)]
            y = [a + b for a, b in zip(x[at], linear(joined, f"{name}.attention.W_out"))]
            both = linear(norm(y, f"{name}.ffn_norm"), f"{name}.ffn.linear_first")
            half = len(both) // 2
            new.append([a + b for a, b in zip(y, linear([a * max(b, 0) for a, b in zip(both[:half], both[half:])], f"{name}.ffn.linear_second"))])
        x = new
    return linear([max(a, 0) for a in norm(x[-1], "head.norm")], "head.linear")


def test_forward_pass_equals_loops_and_no_batch_changes_it(spark):
    needed = X.shapes(columns=12, tokens=5, classes=3, width=8, hidden=6, blocks=2)
    weights = X.gathered(X.drawn(spark, needed, seed=7), needed)
    token_of = [c % 5 for c in range(12)]
    model = X.Transformer(weights, token_of, heads=4, blocks=2)
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(12)]) for i in range(40)]
    odd = [(100, None), (101, [1.0]), (102, [None] * 12)]
    df = spark.createDataFrame(rows + odd, "id int, v array<double>")
    got = {r.id: r.logits for r in X.class_logits(df.repartition(3), "id", "v", model).collect()}
    assert [got[i] for i, _ in odd] == [None] * 3
    for i, v in rows:
        assert np.abs(np.array(got[i]) - plain_logits(weights, v, token_of, 4, 2)).max() < 1e-6
        assert np.abs(model.logits(np.array([v])) - got[i]).max() < 1e-9
    with pytest.raises(ValueError, match="cls"):
        X.gathered(X.drawn(spark, needed).where("name <> 'cls' OR place > 0"), needed)
