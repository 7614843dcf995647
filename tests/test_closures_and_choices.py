"""Closure, question gains, bootstraps, sparse rows, label ratios and article selection against plain versions."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import closure as C
from sextant.operators import features as Y
from sextant.operators import matching as L
from sextant.operators import questions as Q
from sextant.operators import resampling as E
from sextant.operators import selection as V
from sextant.operators import statistics as T
from sextant.operators import tokens as K


def reached(edges):
    """{(a, b): least steps} by breadth-first search."""
    out, nexts = {}, {}
    for a, b in edges:
        if a is not None and b is not None:
            nexts.setdefault(a, set()).add(b)
    for a in nexts:
        front, depth, seen = nexts[a], 1, set()
        while front:
            for b in front:
                out[a, b] = depth
            seen |= front
            front, depth = {c for b in front for c in nexts.get(b, ())} - seen, depth + 1
    return out


def test_closure_with_cycles_repeats_and_nulls(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(35)] + [(100, 101), (101, 102), (102, 100), (5, None), (None, 5), (7, 7), (7, 7)]
    df = spark.createDataFrame(edges, "a int, b int")
    want = reached(edges)
    assert {(r.a, r.b): r.depth for r in C.closure(df).collect()} == want and want[100, 100] == 3 and want[7, 7] == 1
    assert {(r.a, r.b): r.depth for r in C.closure(df, 2).collect()} == {k: v for k, v in want.items() if v <= 2}
    assert C.closure(df.where("false")).collect() == []


def test_implications_close_and_expand(spark):
    implies = spark.createDataFrame([("a", "present", "q", "present"), ("q", "present", "r", "present"), ("r", "present", "q", "present"), ("b", "absent", "r", "absent")], "concept_id string, assertion string, implied_id string, implied_assertion string")
    closed = C.closed_implications(implies)
    assert {(r.concept_id, r.implied_id) for r in closed.collect()} == {("a", "q"), ("a", "r"), ("q", "r"), ("r", "q"), ("b", "r")}
    findings = spark.createDataFrame([(1, "a", "present"), (2, "a", "present"), (2, "b", "absent")], "case_id int, concept_id string, assertion string")
    got = {(r.case_id, r.concept_id, r.assertion) for r in K.expand(findings, closed).collect()}
    assert got == {(1, "a", "present"), (1, "q", "present"), (1, "r", "present"), (2, "a", "present"), (2, "b", "absent"), (2, "q", "present")}  # r is implied both ways


def test_question_gains_equal_loops(spark):
    rng = random.Random(2)
    conditions, concepts = ["c1", "c2", "c3", "c4"], [f"k{i}" for i in range(7)]
    weights = {(c, k): rng.choice([0.0, 0.03, 0.3, 0.65, 0.95]) for c in conditions for k in concepts if rng.random() < 0.8}
    weights |= {(c, "same"): 0.5 for c in conditions}
    edges = spark.createDataFrame([(c, k, w) for (c, k), w in weights.items()], "condition_id string, concept_id string, weight double")
    dims = spark.createDataFrame(list(enumerate(conditions, 1)), "ord int, condition_id string")
    implied = [("k0", "k1"), ("k2", "k1"), ("k0", "k3")]
    questions = Q.answers(edges, dims, spark.createDataFrame(implied, "concept_id string, implied string")).withColumn("never", F.when(F.col("concept_id") == "k4", F.array(F.lit("m"))))
    scores = {i: [rng.uniform(-4, 0) for _ in conditions] for i in range(20)}
    settled = {i: [k for k in concepts if rng.random() < 0.2] for i in scores}
    kinds = {i: [None, "m", "f"][i % 3] for i in scores}
    p = Q.posteriors(spark.createDataFrame([(i, o, s) for i, v in scores.items() for o, s in enumerate(v, 1)], "case_id int, ord int, kg double"))
    cases = p.join(spark.createDataFrame([(i, settled[i] or None, kinds[i]) for i in scores], "case_id int, settled array<string>, kind string"), "case_id")
    got = {(r.case_id, r.concept_id): r for r in Q.question_gains(cases, questions, conditions).collect()}
    want = {}
    for i, v in scores.items():
        top = [math.exp(x - max(v)) for x in v]
        post = [x / sum(top) for x in top]
        for k in [*concepts, "same"]:
            if k in settled[i] or (k == "k4" and kinds[i] == "m"):
                continue

            def clip(c, k):
                return min(max(weights.get((c, k), 0.01), 0.01), 0.9)

            plus = [math.log(clip(c, k)) + sum(math.log(clip(c, x)) for y, x in implied if y == k) for c in conditions]
            theta = [1 / (1 + math.exp(math.log(1 - clip(c, k)) - a)) for c, a in zip(conditions, plus)]
            if max(theta) == min(theta):
                continue
            q = sum(a * b for a, b in zip(post, theta))
            parts = [a * max(0.0, t * math.log2(t / q) + (1 - t) * math.log2((1 - t) / (1 - q))) for a, t in zip(post, theta)]
            if round(sum(parts), 9) > 0:
                order = [j for j in sorted(range(4), key=lambda j: (-round(parts[j], 9), j)) if parts[j] >= 0.01 * sum(parts)]
                want[i, k] = (q, sum(parts), [conditions[j] for j in order if theta[j] > q][:3], [conditions[j] for j in order if theta[j] < q][:3])
    assert set(got) == set(want) and len(want) > 40
    for key, (q, gain, yes, no) in want.items():
        r = got[key]
        assert r.q == pytest.approx(q) and r.gain == pytest.approx(gain, abs=1e-8) and (r.if_present, r.if_denied) == (yes, no)


def test_cells_draw_as_cases_do(spark):
    rng = random.Random(9)
    data = [(i, float(rng.random() < 0.3), 1.0, rng.choice([0.0, 0.5, 1.0]), ["x", "y", None][i % 3]) for i in range(900)]
    df = spark.createDataFrame(data, "case_id int, hit double, one double, part double, seg string").repartition(4)
    sums = [r.sums for r in E.resampled_sums(df, ["one", "hit", "part"], [], 1000).where("b >= 0").collect()]
    assert len(sums) == 1000 and {s[0] for s in sums} == {900.0}  # every resample draws as many cases as there are
    plain = np.random.default_rng(1)
    hits, parts = (np.array([d[j] for d in data]) for j in (1, 3))
    drawn = [plain.integers(0, 900, 900) for _ in range(2000)]
    for j, col in ((1, hits), (2, parts)):
        a, b = np.sort([s[j] for s in sums]), np.sort([col[i].sum() for i in drawn])
        assert abs(a.mean() - b.mean()) < 0.15 * b.std() and abs(a.std() / b.std() - 1) < 0.1
        grid = np.linspace(b[0], b[-1], 60)
        assert np.abs(np.searchsorted(a, grid) / 1000 - np.searchsorted(b, grid) / 2000).max() < 0.07  # both distributions, side by side
    both = np.corrcoef([s[1] for s in sums], [s[2] for s in sums])[0, 1]
    assert both == pytest.approx(np.corrcoef([hits[i].sum() for i in drawn], [parts[i].sum() for i in drawn])[0, 1], abs=0.1)
    again = E.bootstrap(df.repartition(7), {"hit": ("hit", "one")}, ["seg"]).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, E.bootstrap(df, {"hit": ("hit", "one")}, ["seg"]).collect())) and len(again) == 3
    for r in again:
        own = np.array([d[1] for d in data if d[4] == r.seg])
        half = 1.96 * math.sqrt(own.mean() * (1 - own.mean()) / len(own))
        assert r.value == pytest.approx(own.mean()) and r.low == pytest.approx(own.mean() - half, abs=0.02) and r.high == pytest.approx(own.mean() + half, abs=0.02)
    diff = E.differences(df.withColumn("more", F.col("hit") + 0.1), {"d": ("hit", "more", "one")}).first()
    assert diff.better == "b" and diff.excludes_zero and diff.value == pytest.approx(0.1)
    assert E.bootstrap(df.where("false"), {"hit": ("hit", "one")}).collect() == []


def test_platt_stays_finite_on_separable_scores(spark):
    rows = [(1e-6, False)] * 30 + [(0.999, True)] * 30
    a, b = T.fit_platt(spark.createDataFrame(rows, "p double, y boolean"), "p", "y")
    assert math.isfinite(a) and math.isfinite(b) and b > 0
    x = np.log([r[0] for r in rows])
    q = 1 / (1 + np.exp(-(a + b * x)))
    aim = np.where([r[1] for r in rows], 31 / 32, 1 / 32)
    assert np.abs([(q - aim).sum(), ((q - aim) * x).sum()]).max() < 1e-6  # no loss is less


def test_sparse_rows_equal_dense_ones(spark):
    rng = random.Random(3)
    entries = [(rng.randrange(50), rng.choice("abcdefgh"), rng.choice([None, 0.0, 1.0, 2.5])) for _ in range(200)] + [(3, None, 1.0)]
    fit = spark.createDataFrame([e for e in entries if e[1] not in ("g", "h")], "id int, token string, value double")
    ids, df = spark.createDataFrame([(i,) for i in range(55)], "id int"), spark.createDataFrame(entries, "id int, token string, value double")
    vocab = Y.vocabulary(fit.repartition(5))
    assert {r.token: r.idx for r in vocab.collect()} == {c: i for i, c in enumerate("abcdef")}
    rows = Y.sparse_rows(ids, df, vocab)
    want = {i: [0.0] * 6 for i in range(55)}
    unknown = Counter(i for i, t in {(i, t) for i, t, _ in entries} if t in ("g", "h"))
    for i, t, v in entries:
        if t is not None and t < "g":
            want[i]["abcdef".index(t)] += 1.0 if v is None else v
    got = rows.withColumn("d", Y.dense(6)).collect()
    assert {r.id: r.d for r in got} == want and all(r.indices == sorted(r.indices) and 0.0 not in r["values"] for r in got)
    assert {r.id: r.unknown for r in got if r.unknown} == dict(unknown)
    chunks = {r.chunk: r for r in Y.csr_chunks(rows, "id", 20).collect()}
    assert {k: r.ids for k, r in chunks.items()} == {0: list(range(20)), 1: list(range(20, 40)), 2: list(range(40, 55))}
    for r in chunks.values():
        for j, i in enumerate(r.ids):
            line = [0.0] * 6
            for at in range(r.starts[j], r.starts[j + 1]):
                line[r.indices[at]] = r["values"][at]
            assert line == want[i]


@pytest.mark.parametrize("least", [0.72, 0.5, 0.95])
def test_no_alike_labels_are_lost(spark, least):
    rng = random.Random(8)
    words = ["blue", "bolt", "cold", "gear", "large", "plate", "old", "ring", "né", "aa", "a"]
    labels = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)} | {"x", "xx", "aaaa", "aaaaa", "abab", "baba", "日本語", "日本"}
    df = spark.createDataFrame([(x,) for x in [*labels, *labels, None, ""]], "label string")
    got = {(r.a, r.b): r.ratio for r in L.similar_labels(df, least).collect()}
    want = {}
    for a in labels:
        for b in labels:
            if a.encode() < b.encode() and (r := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= least:
                want[a, b] = r
    assert got == want and want


def test_articles_are_chosen_as_by_a_loop(spark):
    rng = random.Random(6)
    found = [(f"c{c}", rng.randrange(40), rng.randrange(60)) for c in range(6) for _ in range(40)]
    articles = {i: rng.choice([None, None, "treatment", "licence"]) for i in range(60) if rng.random() < 0.8}
    plan, taken, refused = {}, {}, {}
    for c, _, _ in found:
        first = {}
        for cc, o, i in found:
            if cc == c:
                first[i] = min(o, first.get(i, o))
        plan[c] = sorted(first, key=lambda i: (first[i], i))[:15]
    for c, items in plan.items():
        n = 0
        for i in items:
            if n >= 5:
                break
            if i in articles and articles[i]:
                refused[i] = articles[i]
            elif i in articles:
                taken.setdefault(i, set()).add(c)
                n += 1
    p = V.planned(spark.createDataFrame(found, "condition string, ord int, item int"), 15)
    a, b = V.select_articles(p, spark.createDataFrame(list(articles.items()), "item int, reason string"), 5)
    assert {r.item: r.conditions for r in a.collect()} == {k: sorted(v) for k, v in taken.items()}
    assert {r.item: r.reason for r in b.collect()} == refused and any(len(v) > 1 for v in taken.values())
    counts = V.licence_counts(a, spark.createDataFrame([(i, f"L{i % 2}") for i in range(60)], "item int, licence string")).collect()
    assert {r.licence: (r.articles, r.uses) for r in counts} == {f"L{x}": (sum(i % 2 == x for i in taken), sum(len(v) for i, v in taken.items() if i % 2 == x)) for x in (0, 1)}


def test_open_gains_equal_question_gains_without_a_product(spark):
    conditions = ["a", "b", "c"]
    dims = spark.createDataFrame([(i, c) for i, c in enumerate(conditions, 1)], "ord int, condition_id string")
    edges = spark.createDataFrame([("a", "k0", 0.9), ("b", "k1", 0.35), ("c", "k1", 0.65), ("a", "k2", 0.5), ("b", "k3", 0.5), ("a", "k4", 0.5), ("b", "k4", 0.5), ("c", "k4", 0.5)], "condition_id string, concept_id string, weight double")
    questions = Q.answers(edges, dims).withColumn("never", F.when(F.col("concept_id") == "k1", F.array(F.lit("m"))))
    rows = [(1, [0.2, 0.3, 0.5], ["k0", "other"], "f"), (2, [0.2, 0.3, 0.5], None, "m"), (3, [1.0, 0.0, 0.0], [], "f"), (4, [0.4, 0.4, 0.2], ["k0", "k1"], None), (5, [0.4, 0.3, 0.3], ["k0", "k1", "k2", "k3"], "f")]
    cases = spark.createDataFrame(rows, "case_id int, p array<double>, settled array<string>, kind string")
    want = {(r.case_id, r.concept_id): r for r in Q.question_gains(cases, questions, conditions).collect()}
    out = Q.open_gains(cases, questions)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.case_id, r.concept_id): r for r in out.collect()}
    assert got.keys() == want.keys() and {1, 2, 4} == {k for k, _ in got}
    for k, r in want.items():
        assert got[k].q == pytest.approx(r.q) and got[k].gain == pytest.approx(r.gain, abs=1.1e-9)
    best = {r.case_id: r for r in Q.named(Q.open_gains(cases, questions, best=True), conditions).collect()}
    for case in (1, 2, 4):
        least = min((r for k, r in want.items() if k[0] == case), key=lambda r: (-r.gain, r.concept_id))
        assert (best[case].concept_id, best[case].if_present, best[case].if_denied) == (least.concept_id, least.if_present, least.if_denied)
    assert len(best) == 3 and Q.open_gains(cases, questions.where("false")).count() == 0
