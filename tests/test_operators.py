"""Hand-worked values and properties of single operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.operators import decisions, fusion, graph, history, metrics, resampling, statistics, text, tokens
from sextant.sources import files
from sextant.streaming import extensions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens_parse_and_judge(spark):
    raw = spark.createDataFrame([(1, "E_91"), (1, "E_54_@_V_161"), (1, "E_56_@_4"), (1, "E_54_@_V_11"), (1, "E_7_@_0")], "case_id int, raw string")
    specs = spark.createDataFrame([("E_91", "B", None), ("E_54", "M", "V_1"), ("E_56", "C", "0"), ("E_7", "C", "0")], "code string, data_type string, default_value string")
    judged = {r.raw: (r.kind, r.positive) for r in tokens.positive(tokens.parse(raw), specs).collect()}
    assert judged == {"E_91": ("binary", True), "E_54_@_V_161": ("value", True), "E_56_@_4": ("ordinal", True), "E_54_@_V_11": ("na", False), "E_7_@_0": ("ordinal", False)}
    assert tokens.positive_codes(tokens.positive(tokens.parse(raw), specs)).first().codes == ["E_54", "E_56", "E_91"]
    with pytest.raises(Exception, match="malformed"):
        tokens.parse(spark.createDataFrame([(1, "x")], "case_id int, raw string")).collect()


def test_mcnemar_by_hand():
    assert statistics.mcnemar(0, 0) == 1.0
    assert statistics.mcnemar(1, 9) == pytest.approx(2 * (1 + 10) / 1024)
    assert statistics.mcnemar(10, 15) == pytest.approx(math.erfc(math.sqrt(16 / 25 / 2)))


def test_bootstraps_agree_with_the_normal_interval(spark):
    rng = random.Random(1)
    data = [(i, float(rng.random() < 0.3), 1.0) for i in range(3000)]
    df = spark.createDataFrame(data, "case_id long, num double, den double")
    r = statistics.poisson_bootstrap(df, "case_id", "num", "den").first()
    exact = resampling.bootstrap(df, {"rate": ("num", "den")}).first()
    value, low, high = exact.value, exact.low, exact.high
    half = 1.96 * math.sqrt(value * (1 - value) / 3000)
    assert r.value == pytest.approx(value)
    for a, b in ((r.low, r.high), (low, high)):
        assert a == pytest.approx(value - half, abs=0.004) and b == pytest.approx(value + half, abs=0.004)


def test_isotonic_blocks():
    got = statistics.pool_adjacent(pd.DataFrame({"x": [0.1, 0.2, 0.3, 0.4], "y": [0.0, 1.0, 0.0, 1.0], "n": [1.0, 1, 1, 1]}))
    assert got["value"].tolist() == [0.0, 0.5, 1.0]


def test_isotonic_fit_keeps_close_scores_apart(spark):
    rng = random.Random(5)
    data = [(0.2 + rng.randrange(400) * 1e-6, None) for _ in range(4000)] + [(rng.randrange(50) * 1e-5, None) for _ in range(1000)]
    data = [(x, rng.random() < (0.1 + (x - 0.2) * 2000 if x >= 0.2 else x * 100)) for x, _ in data]
    by = {}
    for x, y in data:
        by.setdefault(x, []).append(float(y))
    xs = sorted(by)
    mean = lambda i, j: sum(sum(by[x]) for x in xs[i:j]) / sum(len(by[x]) for x in xs[i:j])
    want, i = [], 0
    while i < len(xs):  # the greatest convex minorant: the furthest end of the least mean
        j = min(range(i + 1, len(xs) + 1), key=lambda j: (round(mean(i, j), 12), -j))
        want.append((xs[i], xs[j - 1], mean(i, j)))
        i = j
    got = rows(statistics.fit_isotonic(spark.createDataFrame(data, "p double, y boolean").repartition(7), "p", "y"))
    assert len(want) > 8 and [r[:2] for r in got] == [w[:2] for w in want]
    assert [r[2] for r in got] == pytest.approx([w[2] for w in want])


def scalar_pool(p, kg, inside, alpha):
    lse = lambda x: max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
    lkg = [k - lse(kg) for k in kg]
    model = [x for x, i in zip(p, inside) if i]
    if sum(model) <= 0 or max(model) - min(model) < 1e-12 or alpha == 1:
        return lkg
    t = [(1 - alpha) * ((math.log(x) if x > 0 else -700) if alpha == 0 else math.log(max(x, 0.01))) + alpha * k for x, k in zip(p, lkg)]
    z, mass = lse([x for x, i in zip(t, inside) if i]), lse([k for k, i in zip(lkg, inside) if i])
    return [max(-700, mass + x - z) if i else k for x, k, i in zip(t, lkg, inside)]


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5, 1.0])
def test_pool_equals_the_scalar(spark, alpha):
    cases = {1: ([0.7, 0.2, 0.1, 0.0], [-1.0, -2, -3, -4]), 2: ([0.25] * 4, [-1.0, -5, -2, -9]), 3: ([0.0, 0.0, 0.0, 0.0], [-1.0, -1, -1, -1]), 4: ([0.001, 0.999, 0.0, 0.0], [-3.0, -1, -700, -2])}
    inside = [True, True, True, False]
    data = [(c, str(j), float(p[j]), float(kg[j]), inside[j]) for c, (p, kg) in cases.items() for j in range(4)]
    df = spark.createDataFrame(data, "case_id int, condition_id string, p double, kg double, in_model boolean")
    got = {(r.case_id, int(r.condition_id)): r.fused for r in fusion.opinion_pool(df, F.lit(alpha)).collect()}
    for c, (p, kg) in cases.items():
        assert [got[c, j] for j in range(4)] == pytest.approx(scalar_pool(p, kg, inside, alpha), abs=1e-9)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red apple apple"), (2, "green pear")], "id int, t string")
    asked = spark.createDataFrame([(9, "apple"), (9, "apple")], "query int, term string")
    got = text.bm25(text.tokenised(docs, "id", "t"), asked).collect()
    want = math.log(1 + 1.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5))
    assert [(r.query, r.doc) for r in got] == [(9, 1)] and got[0].score == pytest.approx(want)


def test_words_and_runs(spark):
    df = spark.createDataFrame([("The oesophagus, pains 5 x glass viruses gas",)], "t string")
    assert df.select(text.words(F.col("t")).alias("w")).first().w == ["esophagus", "pain", "5", "glass", "viruse", "gas"]
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(["good one", "bad drug", "fine two", "fine three"])], "doc int, pos int, sentence string")
    assert rows(text.clean_runs(s, F.col("sentence").contains("drug"), 8).select("text")) == [("fine two fine three",), ("good one",)]


def test_as_of_history(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 20.0), (2, 10, 30.0)], "k int, since int, v double")
    assert rows(history.as_of(left, right, "k", "at", "since", "v")) == [(1, 1, None), (1, 5, 20.0), (2, 9, None)]
    d = spark.createDataFrame([("2000-02-29", "2024-02-28"), ("2000-02-29", "2024-02-29")], "b string, d string")
    ages = d.select(history.age_on(F.to_date("b"), F.to_date("d")).alias("a")).collect()
    assert [r.a for r in ages] == [23, 24]


def test_kappa_and_ndcg(spark):
    g = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (0, 2)], "a int, b int")
    po, pe = 3 / 4, (2 * 1 + 1 * 1 + 1 * 2) / 16
    assert metrics.kappa(g, "a", "b").first().kappa == pytest.approx((po - pe) / (1 - pe), abs=1e-6)
    j = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 2, 2), (2, 3, 1, 0)], "query_id int, item int, rank int, grade int")
    assert rows(metrics.ndcg(j)) == [(1, round(1 / math.log2(3), 6), round(1 / 3, 6))]


def test_sniffing_and_guarding(spark):
    assert files.sniff("a;b;c\n1,5;2;3".encode()) == (";", "UTF-8")
    assert files.sniff("a\tb\né".encode("cp1252")) == ("\t", "windows-1252")
    assert spark.createDataFrame([("=x",)], "c string").select(files.guarded(F.col("c"))).first()[0] == " =x"
    assert files.parse_jats("<a><sec><title>T</title><p>one <i>two</i></p></sec></a>") == [("T", "one two")] and files.parse_jats("<a>") == []


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 95.0), (1, "2024-01-01 01:00:00", "a", 5.0), (2, "2024-01-03 00:00:00", "b", 99.0)], "event_id long, s string, event_type string, value double")
    src.select("event_id", F.to_timestamp("s").alias("ts"), "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = extensions.alert_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("rates").select("event_type", "n", "high")) == [("a", 2, 1), ("b", 1, 1)]
    q = extensions.score_batches(extensions.once(stream, "event_id"), lambda b: b.select("event_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("event_id")) == [(1,), (2,)]


def test_the_test_split_stays_closed():
    assert decisions.check_split("train", test_open=False) == "train" and decisions.check_split("test", test_open=True) == "test"
    with pytest.raises(PermissionError):
        decisions.check_split("test", test_open=False)
    with pytest.raises(ValueError, match="unknown split"):
        decisions.check_split("tset", test_open=True)


def test_calibrator_gate_names_the_first_mismatch(spark):
    data = [("fused", "trees", "models\\a", 0.5, None), ("ml", None, "x", 0.5, "kind"), ("fused", None, "models/a", 0.5, "backend"), ("fused", "trees", None, 0.5, "model_dir"), ("fused", "trees", "./models//a/.", 0.1, "alpha"), ("fused", "trees", "models/a", None, "alpha")]
    df = spark.createDataFrame(data, "kind string, backend string, model_dir string, alpha double, expected string")
    want = df.withColumns({"want_kind": F.lit("fused"), "want_backend": F.lit("trees"), "want_model_dir": F.lit("models/a"), "want_alpha": F.lit(0.5)})
    assert want.where(~decisions.calibrator_mismatch().eqNullSafe(F.col("expected"))).count() == 0


def test_occlusion_is_leaving_one_out(spark):
    edges = {("a", "x"): 0.9, ("a", "y"): 0.35, ("b", "x"): 0.12, ("b", "z"): 0.65, ("c", "y"): 0.03}
    cases = {1: ["x", "y"], 2: ["x", "y", "z", "w"], 3: ["w"]}

    def odds(found):
        s = {c: sum(math.log(max(min(edges.get((c, f), 0.01), 0.9), 0.01)) for f in found) for c in "abc"}
        total = sum(math.exp(v) for v in s.values())
        return {c: math.log(math.exp(v) / (total - math.exp(v))) for c, v in s.items()}

    want = {(k, f, c): odds(fs)[c] - odds([x for x in fs if x != f])[c] for k, fs in cases.items() for f in fs for c in "abc"}
    present = spark.createDataFrame([(k, f) for k, fs in cases.items() for f in fs], "case_id int, concept_id string")
    table = spark.createDataFrame([(c, f, w) for (c, f), w in edges.items()], "condition_id string, concept_id string, weight double")
    conditions = spark.createDataFrame([("a",), ("b",), ("c",)], "condition_id string")
    got = {(r.case_id, r.concept_id, r.condition_id): r.effect for r in graph.occlusion(present, table, conditions).collect()}
    assert got == pytest.approx(want)


def test_occlusion_goes_through_one_window_and_names_one_condition(spark):
    rows = [(1, "x", "a"), (1, "y", "a"), (2, "x", "b"), (2, "w", "b"), (3, "x", "none such"), (4, "z", None)]
    present = spark.createDataFrame(rows, "case_id int, concept_id string, truth string")
    table = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.35), ("b", "y", 0.12)], "condition_id string, concept_id string, weight double")
    conditions = spark.createDataFrame([("a",), ("b",)], "condition_id string")
    every = graph.occlusion(present.drop("truth"), table, conditions)
    assert every._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    want = {(r.case_id, r.concept_id): r.effect for r in every.collect() if (r.case_id, r.condition_id) in {(1, "a"), (2, "b")}}
    got = graph.occlusion(present, table, conditions, "truth").collect()
    assert {(r.case_id, r.concept_id): r.effect for r in got} == want and len(got) == len(want) == 4
    assert {r.condition_id for r in got if r.case_id == 2} == {"b"}


def test_kappa_interval_holds_kappa(spark):
    rng = random.Random(4)
    data = [(q, g, g if rng.random() < 0.7 else rng.randrange(3)) for q in range(40) for g in (rng.randrange(3) for _ in range(20))]
    r = statistics.kappa_interval(spark.createDataFrame(data, "q int, a int, b int"), "q", "a", "b").first()
    n = len(data)
    agree, chance = sum(a == b for _, a, b in data) / n, sum(sum(x[1] == g for x in data) * sum(x[2] == g for x in data) for g in range(3)) / n**2
    assert r.value == pytest.approx((agree - chance) / (1 - chance)) and r.low < r.value < r.high and r.high - r.low < 0.2


def test_overlapping_word_sets_equal_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}x" for i in range(40)]
    data = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for i in range(80)] + [(90, ""), (91, None)]
    sets = {i: set(t.split()) for i, t in data if t}
    for least in (0.2, 0.5, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        got = text.overlapping(spark.createDataFrame(data, "i int, t string"), "i", "t", least)
        assert {(r.a, r.b) for r in got.collect()} == want


def test_rules_decide_as_written(spark):
    m = "method string, difference double, low double, high double, precision double"
    none = [("bm25", 0.1, -0.1, 0.3, 0.9), ("hybrid", None, None, None, 0.4)]
    assert tuple(decisions.retrieval_rule(spark.createDataFrame(none, m)).first()) == ("hybrid", False, 0.4, True)
    two = [*none, ("dense", 0.2, 0.1, 0.3, 0.7), ("other", 0.15, 0.1, 0.2, 0.9)]
    assert tuple(decisions.retrieval_rule(spark.createDataFrame(two, m)).first()) == ("dense", True, 0.7, False)
    pairs = spark.createDataFrame([("a", "b", 0.1, 0.2), ("a", "c", 0.0, 0.2)], "alone string, grounded string, low double, high double")
    assert tuple(decisions.paired_claims(pairs).first()) == (False, 2)
    arms = spark.createDataFrame([("ok", 100, 50, 9, 10, 0), ("bad", 100, 50, 10, 11, 1), ("idle", 0, 0, 0, 0, 0)], "arm string, cases int, claims int, unsupported int, failed int, delivered int")
    got = {r.arm: (r.passed, r.reasons) for r in decisions.checkpoint(arms).collect()}
    assert got == {"ok": (True, []), "bad": (False, ["unsupported claims", "failed calls", "a defect was delivered"]), "idle": (False, ["did not run"])}


def test_rows_are_numbered_in_order_over_all_parts(spark):
    edges = spark.range(500).selectExpr("CAST(id % 250 AS STRING) AS a", "IF(id % 7 = 0, NULL, id % 250) AS b").repartition(5)
    got = sorted(tuple(r) for r in files.to_rows(edges).select("ordinal", "row").collect())
    assert [o for o, _ in got] == list(range(500))
    assert [r for _, r in got] == sorted(r for _, r in got)
    assert files.to_rows(edges.where("a = 'none'")).collect() == []


def test_scores_of_every_condition_against_a_loop(spark):
    conditions = [(1, "x"), (2, "y"), (3, "z")]
    edges = {("x", "f"): 0.95, ("x", "g"): 0.3, ("y", "f"): 0.001, ("other", "f"): 0.5}
    present = {1: ["f", "g"], 2: ["h"], 3: []}
    got = graph.naive_bayes(
        spark.createDataFrame([(c,) for c in present], "case_id long"),
        spark.createDataFrame([(c, f) for c, fs in present.items() for f in fs], "case_id long, concept_id string"),
        spark.createDataFrame([(*k, w) for k, w in edges.items()], "condition_id string, concept_id string, weight double"),
        spark.createDataFrame(conditions, "ord int, condition_id string"),
    ).collect()
    want = {(c, o, d): round(sum(math.log(max(min(edges.get((d, f), 0.01), 0.9), 0.01)) for f in fs), 9) for c, fs in present.items() for o, d in conditions}
    assert {(r.case_id, r.ord, r.condition_id): r.kg for r in got} == pytest.approx(want)
    assert len(got) == len(want)
