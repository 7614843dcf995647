"""Results and work that must not grow faster than the tables."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import ablation as B
from sextant.operators import features as Y
from sextant.operators import graph as G
from sextant.operators import statistics as T
from sextant.operators import text as X
from sextant.plans import registry


@pytest.fixture
def folder(tmp_path):
    def write(**tables):
        for name, sql in tables.items():
            duckdb.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return write


def test_sets_of_suppliers_are_compared_by_class(spark, folder):
    """400 suppliers with three sets: a row each and three pairs, not 79,800."""
    at = folder(lineitem="SELECT s AS l_suppkey, CASE x WHEN 0 THEN 'A' ELSE 'N' END AS l_returnflag, 'O' AS l_linestatus, x / 100.0::DOUBLE AS l_tax FROM range(1, 401) a(s), range(70) b(x) WHERE x <= CASE s % 3 WHEN 0 THEN 69 WHEN 1 THEN 30 ELSE 0 END")
    rows = registry.queries()["jn18_set_containment"](spark, at).collect()
    members = {r.a: r.b for r in rows if r.part == "member"}
    assert members == {s: {0: 3, 1: 1, 2: 2}[s % 3] for s in range(1, 401)}
    pairs = {(r.a, r.b): (r.a_in_b, r.b_in_a, r.jaccard) for r in rows if r.part == "pair"}
    assert len(rows) == 403 and pairs == {(1, 2): (False, True, round(1 / 31, 6)), (1, 3): (True, False, round(31 / 70, 6)), (2, 3): (True, False, round(1 / 70, 6))}


def counted(spark, df):
    """df, and an accumulator of how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


def test_platt_makes_its_points_once(spark):
    """However many steps it takes; equal points count as often as they stand there."""
    rows = [(0.1, False)] * 40 + [(0.1, True)] * 7 + [(0.6, True)] * 30 + [(0.6, False)] * 21 + [(0.9, True)] * 12 + [(0.9, False)]
    df, made = counted(spark, spark.createDataFrame(rows, "p double, y boolean"))
    a, b = T.fit_platt(df, "p", "y")
    assert made.value == len(rows)
    x, y = np.log([r[0] for r in rows]), np.array([r[1] for r in rows])
    q, aim = 1 / (1 + np.exp(-(a + b * x))), np.where(y, 50 / 51, 1 / 64)
    assert np.abs([(q - aim).sum(), ((q - aim) * x).sum()]).max() < 1e-6


def test_ranks_are_counted_and_levels_scored_as_cases_are(spark):
    """Counted ranks are the ranks of the cases, and scores by level those of naive_bayes() of what a level keeps."""
    rows = [(i, i % 3, [0.1 * (i % 5), 0.3, None], [-1.0 * (i % 4), -0.5, -2.0], [i % 2 == 0, False, False], i % 2 == 0) for i in range(50)]
    cases = spark.createDataFrame(rows, "id int, truth int, p array<double>, kg array<double>, flagged array<boolean>, critical boolean")
    each = B.weight_sweep(cases, [0.2, 0.7], ["critical"], True).groupBy("critical", "alpha", "rank").count().collect()
    counted_ranks = B.weight_sweep(cases, [0.2, 0.7], ["critical"], True, counted=True).collect()
    assert sorted(tuple(r) for r in each) == sorted((r.critical, r.alpha, r["rank"], r.n) for r in counted_ranks) and sum(r.n for r in counted_ranks) == 100
    tokens = [(i, None if i == 7 else [f"c{j}" for j in range(i % 6)]) for i in range(40)]
    edges = spark.createDataFrame([("A", "c1", 0.5), ("B", "c1", 0.2), ("A", "c3", 0.95), ("B", "c4", 0.0)], "condition_id string, concept_id string, weight double")
    got = G.naive_bayes_levels(spark.createDataFrame(tokens, "case_id int, raws array<string>"), ["case_id"], [1.0, 0.4], edges, ["A", "B"]).collect()
    part = {("A", "c1"): 0.5, ("B", "c1"): 0.2, ("A", "c3"): 0.9}
    own = dict(tokens)
    for r in got:
        for level, scores in r.levels.items():
            kept = [c for c in own[r.case_id] or [] if int(hashlib.md5(f"{r.case_id}:{c}".encode()).hexdigest()[:8], 16) / 2**32 < level]
            assert scores == pytest.approx([sum(math.log(part.get((k, c), 0.01)) for c in kept) for k in "AB"], abs=1e-8)


def test_bootstrap_makes_no_row_for_each_resample(spark):
    """200 resamples of a case are summed where it is read: no generator stands in the plan; the draws are resampled()'s."""
    df = spark.createDataFrame([(i, i % 2, float(i % 7), 1.0 + i % 3) for i in range(90)], "id int, g int, num double, den double")
    out = T.poisson_bootstrap(df, "id", "num", "den", by=("g",))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    each = T.resampled(df, "id").groupBy("g", "b").agg((F.sum(F.col("w") * F.col("num")) / F.sum(F.col("w") * F.col("den"))).alias("r"))
    want = {r.g: (r.low, r.high) for r in each.groupBy("g").agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high")).collect()}
    assert {r.g: (r.low, r.high) for r in out.collect()} == {g: pytest.approx(x) for g, x in want.items()}
    empty = T.poisson_bootstrap(df.where("false"), "id", "num", "den").collect()
    assert [tuple(r) for r in empty] == [(None, None, None)]


def test_bm25_deals_documents_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(X, "DOCS", 10)
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma") for i in range(200)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta1"), (2, "gamma")], "query int, term string")
    out = X.bm25(X.tokenised(docs, "doc_id", "text"), asked)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.query, r.doc): r.n for r in out.collect()} == {(1, i): 1 + (i % 3 == 1) for i in range(200)} | {(2, i): 1 for i in range(200)}


def test_fused_pool_keeps_a_case_one_row(spark, folder):
    """No window or sort goes over rows of cases and conditions; cases of unknown priority count as in SQL."""
    at = folder(
        customer="SELECT k AS c_custkey, 'BUILDING' AS c_mktsegment, 1.0::DOUBLE AS c_acctbal FROM range(12) a(k)",
        orders="SELECT k AS o_orderkey, k % 13 AS o_custkey, CASE WHEN k % 7 = 3 THEN NULL WHEN k % 11 = 0 THEN 'none' ELSE ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + (k * k) % 5] END AS o_orderpriority, CASE k % 2 WHEN 0 THEN 'F' ELSE 'O' END AS o_orderstatus FROM range(300) a(k)",
        lineitem="SELECT k // 3 AS l_orderkey, ['A', 'N', 'R'][1 + k % 3] AS l_returnflag, CASE k % 5 WHEN 0 THEN 'O' ELSE 'F' END AS l_linestatus, CASE WHEN k % 17 > 0 THEN k % 50 END::DOUBLE AS l_quantity, (k % 11) / 100.0::DOUBLE AS l_discount FROM range(840) a(k)",
    )
    duck = duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    for name in ("fu04_opinion_pool", "fu15_fused_ece"):
        df = registry.queries()[name](spark, at)
        assert "Window" not in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join") == 1, name
        want, got = duck.execute(registry.oracle_sql()[name]).fetchall(), [tuple(r) for r in df.collect()]
        assert len(got) == len(want) and all(g[:-1] == w[:-1] and g[-1] == pytest.approx(w[-1], abs=2e-6) for g, w in zip(sorted(got), sorted(want), strict=True)), name


def test_places_are_grouped_as_bits(spark, folder, monkeypatch):
    """Tokens that are there or not: a task groups words of an id, in parts of so many ids, and no row of each token."""
    rng = np.random.default_rng(2)
    entries = [(int(i), f"t{int(k):03d}") for i, k in zip(rng.integers(0, 40, 900), rng.integers(0, 105, 900), strict=True)] + [(50, "t031"), (50, "t032"), (50, "t064"), (51, "t104"), (None, "t001"), (3, None), (99, "t002")]
    vocab = Y.vocabulary(spark.createDataFrame([(f"t{k:03d}",) for k in range(100)], "token string"))
    monkeypatch.setattr(Y, "PART", 5)
    rows = Y.sparse_rows(spark.range(60), spark.createDataFrame(entries, "id int, token string"), vocab, binary=True)
    assert rows.rdd.getNumPartitions() == 12
    found = {i: {int(t[1:]) for j, t in entries if j == i and t} for i in range(60)}
    got = {r.id: (r.indices, r["values"], r.unknown) for r in rows.collect()}
    assert got == {i: (sorted(k for k in own if k < 100), [1.0] * sum(k < 100 for k in own), sum(k > 99 for k in own)) for i, own in found.items()}
    for r in Y.csr_chunks(rows, "id", 7).collect():
        assert r.ids == list(range(60))[7 * r.chunk : 7 * r.chunk + 7] and r.starts[0] == 0 and [r.indices[a:b] for a, b in zip(r.starts, r.starts[1:])] == [got[i][0] for i in r.ids]
    at = folder(
        customer="SELECT 1 AS c_custkey, 'BUILDING' AS c_mktsegment, 1.0::DOUBLE AS c_acctbal",
        orders="SELECT k AS o_orderkey, 1 AS o_custkey, '1-URGENT' AS o_orderpriority, 'F' AS o_orderstatus FROM range(9) a(k)",
        lineitem="SELECT k // 4 AS l_orderkey, 'A' AS l_returnflag, 'O' AS l_linestatus, CASE WHEN k <> 5 THEN k * 20 END::DOUBLE AS l_quantity, 0.03::DOUBLE AS l_discount FROM range(44) a(k)",
    )
    df = registry.queries()["ml03_sparse_transform"](spark, at)
    assert not re.search(r"Aggregate \[id#\d+L?, token", df._jdf.queryExecution().optimizedPlan().toString())
    duck = duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    for name in ("ml03_sparse_transform", "ml03_csr_chunks"):
        assert sorted(tuple(r) for r in registry.queries()[name](spark, at).collect()) == sorted(duck.execute(registry.oracle_sql()[name]).fetchall()), name
