"""Queries of rankings and top-k (WN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import metrics as M
from sextant.operators import ranking as R
from sextant.plans import standin as S
from sextant.plans.registry import query


@query("kg07_nb_ranking_metrics", S.with_graph("""
    , r AS (SELECT k.*, c.truth, row_number() OVER (PARTITION BY k.case_id ORDER BY kg DESC, k.ord) AS rank FROM kg k JOIN cases c USING (case_id))
    SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS top3, round(avg(1.0 / rank), 6) AS mrr
    FROM r WHERE condition_id = truth"""))  # fmt: skip
def nb_metrics(t):
    ranked = R.rank_scores(S.kg_scores(t), "kg").join(S.cases(t).select("case_id", "truth"), "case_id")
    return M.of_truth(ranked).agg(F.count(F.lit(1)).alias("n"), M.share(F.col("rank") <= 1).alias("top1"), M.share(F.col("rank") <= 3).alias("top3"), M.share(1 / F.col("rank")).alias("mrr"))


@query("wn01_score_ranking", S.with_outcomes("SELECT case_id, condition_id, rank FROM o"))
def score_ranking(t):
    return R.rank_scores(S.ml_scores(t), "p").select("case_id", "condition_id", "rank")


@query("wn02_flag_first_ranking", S.with_outcomes("SELECT case_id, condition_id, row_number() OVER (PARTITION BY case_id ORDER BY flagged DESC, p DESC, ord) AS rank FROM o"))
def flag_first(t):
    return R.rank_scores(S.outcomes(t).drop("rank"), "p", first=F.col("flagged")).select("case_id", "condition_id", "rank")


@query("wn03_true_rank", S.with_outcomes("SELECT case_id, rank FROM o WHERE condition_id = truth"))
def true_rank(t):
    return R.true_rank(S.outcomes(t))


@query("wn04_competition_rank", S.with_outcomes("SELECT case_id, condition_id, rank() OVER (PARTITION BY case_id ORDER BY p DESC) AS rank FROM o"))
def competition(t):
    return R.competition_rank(S.ml_scores(t), "p").select("case_id", "condition_id", "rank")


@query("wn09_top_confusions", S.with_outcomes("""
    SELECT truth, condition_id AS predicted, count(*) AS n FROM o JOIN pri q ON q.condition_id = o.truth
    WHERE rank = 1 AND truth <> o.condition_id GROUP BY truth, o.condition_id, q.ord, o.ord ORDER BY n DESC, q.ord, o.ord LIMIT 5""".replace("truth, condition_id AS", "truth, o.condition_id AS")))  # fmt: skip
def top_confusions(t):
    order = S.conditions(t).select(F.col("condition_id").alias("truth"), F.col("ord").alias("t_ord"))
    wrong = S.outcomes(t).where("rank = 1 AND truth <> condition_id").join(order, "truth")
    return wrong.groupBy("truth", "t_ord", "condition_id", "ord").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t_ord", "ord").limit(5).select("truth", F.col("condition_id").alias("predicted"), "n")


@query("wn10_first_occurrence", """
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS pos
    FROM (SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)) AS first FROM events GROUP BY ALL)""")  # fmt: skip
def first_occurrence(t):
    rows = t.events.select("user_id", "event_type", F.struct("ts", "event_id").alias("pos"))
    return R.first_occurrence(rows, "user_id", "event_type", "pos")


RULES = [(1, "1-URGENT", "large balance"), (2, "1-URGENT", "building segment"), (3, "2-HIGH", "open order"), (4, "2-HIGH", "negative balance")]


@query("wn11_first_match_rule", f"""WITH {S.CASES}, met AS (
    SELECT case_id, 1 AS k, '1-URGENT' AS condition_id, 'large balance' AS reason FROM cases WHERE bal > 5000 UNION ALL
    SELECT case_id, 2, '1-URGENT', 'building segment' FROM cases WHERE seg = 'BUILDING' UNION ALL
    SELECT case_id, 3, '2-HIGH', 'open order' FROM cases WHERE sex = 'O' UNION ALL
    SELECT case_id, 4, '2-HIGH', 'negative balance' FROM cases WHERE bal < 0)
    SELECT case_id, condition_id, min_by(reason, k) AS reason FROM met GROUP BY ALL""")  # fmt: skip
def first_match(t):
    rules = t.rows(RULES, "rule_ord int, condition_id string, reason string")
    c = S.cases(t)
    tests = F.array(F.when(F.col("bal") > 5000, 1), F.when(F.col("seg") == "BUILDING", 2), F.when(F.col("sex") == "O", 3), F.when(F.col("bal") < 0, 4))
    met = c.select("case_id", F.explode(F.array_compact(tests)).alias("rule_ord"))
    return R.first_rule(rules, met)


@query("wn16_suggested_tests", S.with_outcomes("SELECT DISTINCT case_id, 'test-' || left(condition_id, 1) AS test FROM o WHERE rank < 3 OR flagged"))
def suggested_tests(t):
    return S.outcomes(t).where("rank < 3 OR flagged").select("case_id", F.concat(F.lit("test-"), F.substring("condition_id", 1, 1)).alias("test")).distinct()


@query("wn17_hash_ordered_sample", "SELECT o_orderkey, sha256('seed:' || o_orderkey) AS digest FROM orders ORDER BY digest, o_orderkey LIMIT 50")
def hash_sample(t):
    return R.hash_order(t.orders.select("o_orderkey"), "seed", "o_orderkey", 50)


@query("wn18_rank_without_class", S.with_outcomes("""
    , x AS (SELECT case_id, condition_id, rank, max(CASE WHEN condition_id = '3-MEDIUM' THEN rank END) OVER (PARTITION BY case_id) AS cut FROM o)
    SELECT case_id, condition_id, CAST(rank - CASE WHEN cut < rank THEN 1 ELSE 0 END AS BIGINT) AS rank FROM x WHERE condition_id <> '3-MEDIUM'"""))  # fmt: skip
def without_class(t):
    return R.rank_without(S.outcomes(t), "3-MEDIUM").select("case_id", "condition_id", F.col("rank").cast("long").alias("rank"))


@query("wn14_reasons_each_side", S.with_graph("""
    , e AS (SELECT t.case_id, s.concept_id, ln(greatest(least(s.weight, 0.9), 0.01)) - ln(0.35) AS effect FROM tok t JOIN strongest s ON s.concept_id = t.raw AND s.condition_id = '1-URGENT'),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id, effect > 0 ORDER BY abs(effect) DESC, concept_id) AS k FROM e WHERE abs(effect) >= 0.1)
    SELECT case_id, concept_id, round(effect, 6) AS effect FROM r WHERE k <= 2"""))  # fmt: skip
def reasons_each_side(t):
    e = S.G.strongest_edges(S.edges(t)).where("condition_id = '1-URGENT'").select(F.col("concept_id").alias("raw"), (F.log(F.greatest(F.least("weight", F.lit(0.9)), F.lit(0.01))) - F.log(F.lit(0.35))).alias("effect"))
    rows = S.tokens(t).join(e, "raw").where(F.abs("effect") >= 0.1).withColumn("side", F.col("effect") > 0)
    top = R.first_k(rows, ["case_id", "side"], [F.abs("effect").desc(), F.col("raw")], 2)
    return top.select("case_id", F.col("raw").alias("concept_id"), F.round("effect", 6).alias("effect"))


@query("wn07_first_k_with_quota", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM (SELECT source, min(doc_id) AS doc_id, n_chars, md5(text) FROM documents WHERE text IS NOT NULL GROUP BY source, n_chars, md5(text))) WHERE k <= 5")
def quota(t):
    once = t.documents.where("text IS NOT NULL").groupBy("source", "n_chars", F.md5("text")).agg(F.min("doc_id").alias("doc_id"))
    return R.first_k(once, ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id")


@query("ag15_tie_expected_top3", S.with_outcomes("""
    , w AS (SELECT case_id, condition_id, truth, rank() OVER (PARTITION BY case_id ORDER BY p DESC) - 1 AS above, count(*) OVER (PARTITION BY case_id, p) AS tied FROM o)
    SELECT round(avg(greatest(0.0, least(1.0, (3.0 - above) / tied))), 6) AS expected_top3 FROM w WHERE condition_id = truth"""))  # fmt: skip
def tie_expected(t):
    by = Window.partitionBy("case_id")
    w = S.outcomes(t).withColumn("above", F.rank().over(by.orderBy(F.desc("p"))) - 1).withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("case_id", "p")))
    return M.of_truth(w).agg(F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (3.0 - F.col("above")) / F.col("tied")))), 6).alias("expected_top3"))
