"""Tests of pairs, verdicts, problem rows, masks and linear models by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sextant.operators import decisions as D
from sextant.operators import features as Y
from sextant.operators import statistics as T
from sextant.operators import tokens as K


def test_the_column_of_pairs_equals_the_function(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(0, 40, 4)] + [(0, 24), (12, 12), (24, 0), (25, 0), (500, 420)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", T.mcnemar_column(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(T.mcnemar(r.a, r.b), rel=3e-7, abs=1e-12), (r.a, r.b)


def test_verdicts_by_hand(spark):
    rows = [("x", "top3", "significant", 0.9, 0.8, 100, 0.01), ("x", "mrr", "higher", 0.9, 0.8, 100, None), ("y", "top3", "significant", 0.9, 0.8, 100, 0.2), ("y", "top3", "significant", 0.99, 0.96, 100, 0.2), ("y", "mrr", "higher", 0.9, 0.99, 100, None), ("z", "mrr", "higher", 1.0, 1.0, 9, None), ("w", "top3", "significant", None, 0.5, 10, 0.01)]
    got = {r.claim: tuple(r)[1:] for r in D.verdicts(spark.createDataFrame(rows, "claim string, metric string, rule string, a double, b double, cases long, p double")).collect()}
    assert got == {"x": ("supported", 2, 0, 0), "y": ("not supported", 3, 3, 1), "z": ("not supported", 1, 1, 1), "w": ("not supported", 1, 1, 1 if round(0.5 * 10) <= 5 else 0)}


def test_sheets_join_once_and_problems_are_told(spark):
    sheet = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("x", 4), (None, 5)], "id string, grade int")
    key = spark.createDataFrame([("a", "q1"), ("b", "q2"), ("c", "q3"), ("d", "q4"), ("d", "q5"), (None, "q6")], "id string, query string")
    joined, problems = D.sheet_problems(sheet, key, "id")
    assert [tuple(r) for r in joined.collect()] == [("a", 1, "q1")]
    assert {tuple(r) for r in problems.collect()} == {(None, "no id", 2), ("b", "repeated in the sheet", 2), ("x", "unknown", 1), ("c", "missing", 1), ("d", "missing", 2), ("d", "repeated in the key", 2)}


def test_consensus_by_hand(spark):
    rows = lambda xs: spark.createDataFrame(xs, "item int, grade int")
    good, problems = D.consensus(rows([(1, 2), (2, 1), (3, 0), (4, 1), (5, 1), (6, 7), (7, 0)]), rows([(1, 2), (2, 0), (3, 1), (4, 1), (6, 7), (7, 1)]), rows([(2, 1), (4, 1), (9, 1), (7, 0), (7, 1)]))
    assert {tuple(r) for r in good.collect()} == {(1, 2), (2, 1)}
    assert {tuple(r) for r in problems.collect()} == {(3, "not settled"), (4, "settled though agreed"), (5, "judged by one only"), (6, "grade out of range"), (7, "settled twice"), (9, "settled without being judged")}


def test_masked_copies_hide_whole_codes(spark):
    tokens = spark.createDataFrame([(i, f"E_{c}_@_V_{v}") for i in range(200) for c in range(6) for v in range(1 + (i + c) % 2)], "case_id int, raw string")
    rows = K.masked(tokens, 0.3).collect()
    assert {r.case_id for r in rows} == set(range(200))
    own, asked = {}, {}
    for r in tokens.collect():
        own.setdefault(r.case_id, set()).add(r.raw)
    for r in rows:
        asked[r.case_id] = set(r.asked)
    for i in range(200):
        kept = {r.raw for r in rows if r.case_id == i and r.raw}
        assert kept == {x for x in own[i] if x.split("_@_")[0] in asked[i]}
    assert 0.22 < sum(map(len, asked.values())) / 1200 < 0.38
    assert not K.masked(tokens, 0.0).where("raw IS NOT NULL").count() and K.masked(tokens, 1.0).count() == tokens.count()


def test_linear_softmax_by_hand(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    entries = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "zz", 9.0)], "id int, token string, value double")
    coefficients = spark.createDataFrame([("x", "a", 0.5), ("y", "b", -1.0)], "class string, token string, coefficient double")
    intercepts = spark.createDataFrame([("x", 0.1), ("y", 0.2)], "class string, intercept double")
    got = {(r.id, r["class"]): (r.logit, r.p) for r in Y.linear_softmax(ids, entries, coefficients, intercepts).collect()}
    assert got[1, "x"][0] == pytest.approx(1.1) and got[1, "y"][0] == pytest.approx(-0.8) and got[2, "x"][0] == pytest.approx(0.1)
    assert got[1, "x"][1] == pytest.approx(math.exp(1.1) / (math.exp(1.1) + math.exp(-0.8))) and got[2, "x"][1] + got[2, "y"][1] == pytest.approx(1)


def test_places_in_parts_equal_a_whole_order(spark):
    import hashlib

    from sextant.operators import ranking as R

    rows = [(i, "big" if i % 10 else "small", hashlib.sha256(str(i // 2).encode()).hexdigest()) for i in range(500)]
    got = {r.i: (r.k, r.n) for r in R.hash_places(spark.createDataFrame(rows, "i int, g string, d string"), "g", "d", "i").collect()}
    for g in ("big", "small"):
        own = sorted((d, i) for i, x, d in rows if x == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]


def test_kept_tables_go_when_asked(spark):
    from sextant.sources.shared import drop_kept, kept

    a = kept(spark.range(5), "some")
    assert a.count() == 5 and drop_kept(spark) >= 1 and drop_kept(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        a.count()


def test_forms_answers_and_digests_by_hand(spark):
    from sextant.sources import files as I

    present = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz")], "case_id int, concept_id string")
    denied = spark.createDataFrame([(1, "b"), (1, "b"), (2, "c")], "case_id int, concept_id string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "concept_id string")
    assert sorted(map(tuple, K.form_problems(present, denied, known).collect())) == [(1, "b", "both present and denied"), (2, "zz", "unknown concept")]
    findings = spark.createDataFrame([(1, "a", "present")], "case_id int, concept_id string, assertion string")
    implies = spark.createDataFrame([("a", "present", "q", "present")], "concept_id string, assertion string, implied_id string, implied_assertion string")
    assert [tuple(r) for r in K.recorded_answers(findings, K.expand(findings, implies)).collect()] == [(1, "q", "a is present")]
    rows = [(i % 7, None if i % 3 else "x") for i in range(40)]
    one = lambda xs, n: I.content_digest(spark.createDataFrame(xs, "a int, b string").repartition(n), "p").first()
    assert one(rows, 1) == one(rows[::-1], 5) != one([*rows, rows[0], rows[0]], 2)
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<double>")
    passages = spark.createDataFrame([(1, "p"), (9, "q"), (2, None)], "id int, article string")
    articles = spark.createDataFrame([("p",)], "article string")
    got = {r.check: r.problems for r in I.bundle_problems(passages, articles, vectors, "article", "id", "v", 2).collect()}
    assert got == {"counts differ by": 0, "vectors of another size": 2, "passages without an article": 2, "passages without a vector": 1}


def test_stated_problems_read_their_rows_once(spark):
    rows = [(1, "a", True), (1, "a", True), (1, "b", True), (1, "b", False), (2, "zz", False), (2, None, True), (None, "a", True), (None, "a", False), (3, "zz", True), (3, "zz", False), (4, "a", None)]
    stated = spark.createDataFrame(rows, "case_id int, concept_id string, positive boolean").repartition(2)
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "concept_id string")
    out = K.stated_problems(stated, known)
    want = {(1, "b", "both present and denied"), (2, "zz", "unknown concept"), (2, None, "unknown concept"), (3, "zz", "both present and denied"), (3, "zz", "unknown concept")}
    got = list(map(tuple, out.collect()))
    assert len(got) == len(want) and set(got) == want
    lists = K.form_problems(stated.where("positive"), stated.where("NOT positive"), known)
    assert set(map(tuple, lists.collect())) == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [case_id") == 1
