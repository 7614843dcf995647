"""Queries of aggregate metrics and reports (AG, ST08)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import metrics as M
from sextant.operators import ranking as R
from sextant.operators import timing as O
from sextant.plans import standin as S
from sextant.plans.registry import N, query

SHARE = "round(sum(CASE WHEN {} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN {} THEN 1.0 ELSE 0 END), 0), 6)"
OF_TRUTH = "FROM o WHERE condition_id = truth"


def share(num: str, den: str = "true") -> str:
    return SHARE.format(num, den)


@query("ag01_class_prior", f"WITH {S.CASES} SELECT truth, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM cases GROUP BY truth")
def class_prior(t):
    counts = S.cases(t).groupBy("truth").agg(N.alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("all"))).select("truth", "n", F.round(F.col("n") / F.col("all"), 6).alias("prior"))


@query("ag02_class_balance", f"""WITH {S.CASES}, g AS (SELECT truth, count(*) AS n, round(avg(CASE WHEN sex = 'F' THEN 1.0 ELSE 0 END), 6) AS share_f, round(quantile_cont(bal, 0.5), 6) AS median_bal FROM cases GROUP BY truth)
    SELECT *, round(max(n) OVER () / n, 6) AS imbalance, n < 1000 AS low FROM g""")  # fmt: skip
def class_balance(t):
    g = S.cases(t).groupBy("truth").agg(N.alias("n"), F.round(F.avg((F.col("sex") == "F").cast("double")), 6).alias("share_f"), F.round(F.percentile("bal", 0.5), 6).alias("median_bal"))
    return g.crossJoin(g.agg(F.max("n").alias("most"))).withColumn("imbalance", F.round(F.col("most") / F.col("n"), 6)).withColumn("low", F.col("n") < 1000).drop("most")


@query("ag03_token_census", f"WITH {S.TOK} SELECT raw, count(*) AS n FROM tok GROUP BY raw ORDER BY n DESC, raw LIMIT 10")
def token_census(t):
    return S.tokens(t).groupBy("raw").agg(N.alias("n")).orderBy(F.desc("n"), "raw").limit(10)


@query("ag04_split_summary", """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_q, round(quantile_cont(l_quantity, 0.5), 6) AS median_q, quantile_disc(l_quantity, 0.9) AS p90, round(avg(least(5.0, l_quantity) / l_quantity), 6) AS ceiling5
    FROM lineitem GROUP BY l_returnflag""")  # fmt: skip
def split_summary(t):
    q = F.col("l_quantity")
    p90 = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)")
    return t.lineitem.groupBy("l_returnflag").agg(N.alias("n"), F.round(F.avg(q), 6).alias("mean_q"), F.round(F.percentile(q, 0.5), 6).alias("median_q"), p90.alias("p90"), F.round(F.avg(F.least(F.lit(5.0), q) / q), 6).alias("ceiling5"))


@query("ag05_concept_prevalence", f"""WITH {S.PRI}, {S.CASES}, {S.TOK}, k AS (SELECT DISTINCT raw FROM tok), n AS (SELECT truth, count(*) AS total FROM cases GROUP BY truth),
    x AS (SELECT truth, raw, count(*) AS c FROM cases JOIN tok USING (case_id) GROUP BY ALL)
    SELECT p.condition_id, k.raw AS concept_id, round(coalesce(c, 0) / total, 3) AS share FROM pri p CROSS JOIN k JOIN n ON n.truth = p.condition_id LEFT JOIN x ON x.truth = p.condition_id AND x.raw = k.raw""")  # fmt: skip
def concept_prevalence(t):
    c, tok = S.cases(t), S.tokens(t)
    pair = c.join(tok, "case_id").groupBy(F.col("truth").alias("condition_id"), F.col("raw").alias("concept_id")).agg(N.alias("c"))
    grid = c.groupBy(F.col("truth").alias("condition_id")).agg(N.alias("total")).crossJoin(tok.select(F.col("raw").alias("concept_id")).distinct())
    return grid.join(pair, ["condition_id", "concept_id"], "left").select("condition_id", "concept_id", F.round(F.coalesce("c", F.lit(0)) / F.col("total"), 3).alias("share"))


@query("ag06_red_flag_rates", S.with_outcomes(f"SELECT condition_id, {share('flagged AND condition_id = truth', 'condition_id = truth')} AS own, {share('flagged AND condition_id <> truth', 'condition_id <> truth')} AS others, {share('flagged')} AS any_flag FROM o GROUP BY condition_id"))
def red_flag_rates(t):
    own = M.hit()
    return S.outcomes(t).groupBy("condition_id").agg(M.share(F.col("flagged") & own, own.cast("int")).alias("own"), M.share(F.col("flagged") & ~own, (~own).cast("int")).alias("others"), M.share(F.col("flagged")).alias("any_flag"))


@query("ag16_ratio_metric", S.with_outcomes(f"SELECT seg, {share('flagged AND condition_id = truth', 'flagged')} AS ratio FROM o GROUP BY seg"))
def ratio(t):
    return S.outcomes(t).groupBy("seg").agg(M.share(F.col("flagged") & M.hit(), F.col("flagged").cast("int")).alias("ratio"))


@query("ag17_top_k_accuracy", S.with_outcomes(f"SELECT {share('rank <= 1')} AS top1, {share('rank <= 3')} AS top3, {share('rank <= 5')} AS top5 {OF_TRUTH}"))
def top_k(t):
    return M.top_k(S.outcomes(t))


@query("ag18_mrr", S.with_outcomes(f"SELECT round(avg(1.0 / rank), 6) AS mrr {OF_TRUTH}"))
def mrr(t):
    return M.of_truth(S.outcomes(t)).agg(M.share(1 / F.col("rank")).alias("mrr"))


@query("ag19_ag20_precision_recall", S.with_outcomes("""SELECT round(avg(a / 3), 6) AS precision3, round(avg(CASE WHEN d > 0 THEN b / d END), 6) AS recall4 FROM (
    SELECT case_id, count(*) FILTER (in_d AND rank <= 3) AS a, count(*) FILTER (in_d AND rank <= 4) AS b, count(*) FILTER (in_d) AS d FROM o GROUP BY case_id)"""))  # fmt: skip
def precision_recall(t):
    return M.set_metrics(S.outcomes(t))


@query("ag21_f1_by_class", S.with_outcomes("""
    , c AS (SELECT truth, condition_id AS predicted FROM o WHERE rank = 1)
    SELECT condition_id, (SELECT count(*) FROM c WHERE truth = condition_id) AS support,
    round(coalesce(2.0 * (SELECT count(*) FROM c WHERE truth = condition_id AND predicted = condition_id) / nullif((SELECT count(*) FROM c WHERE truth = condition_id) + (SELECT count(*) FROM c WHERE predicted = condition_id), 0), 0), 6) AS f1 FROM pri"""))  # fmt: skip
def f1(t):
    return M.f1(S.outcomes(t), S.conditions(t))


@query("ag22_ag23_critical_recall", S.with_outcomes(f"SELECT {share('critical AND rank <= 3', 'critical')} AS critical_recall3, {share('critical AND rank > 3', 'critical')} AS dangerous_rate {OF_TRUTH}"))
def critical(t):
    return M.point_metrics(S.outcomes(t)).select("critical_recall3", "dangerous_rate")


@query("ag24_ag25_flag_sensitivity_precision", S.with_outcomes(f"SELECT {share('flagged AND condition_id = truth', 'condition_id = truth AND critical')} AS sensitivity, {share('flagged AND condition_id = truth', 'flagged')} AS strict_precision, {share('flagged AND (condition_id = truth OR in_d)', 'flagged')} AS mapped_precision FROM o"))
def flags(t):
    f, own = F.col("flagged"), M.hit()
    return S.outcomes(t).agg(M.share(f & own, (own & F.col("critical")).cast("int")).alias("sensitivity"), M.share(f & own, f.cast("int")).alias("strict_precision"), M.share(f & (own | F.col("in_d")), f.cast("int")).alias("mapped_precision"))


TOP = "top AS (SELECT case_id, p, condition_id = truth AS y, least(CAST(floor(p * 10) AS INT), 9) AS bin FROM o WHERE rank = 1)"


@query("ag26_reliability_table", S.with_outcomes(f", {TOP} SELECT bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(CASE WHEN y THEN 1.0 ELSE 0 END), 6) AS accuracy FROM top GROUP BY bin"))
def reliability(t):
    return M.reliability(S.outcomes(t).where("rank = 1").withColumn("y", M.hit()), "p", "y")


@query("ag27_top_label_ece", S.with_outcomes(f", {TOP} SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT bin, count(*) AS n, abs(avg(p) - avg(CASE WHEN y THEN 1.0 ELSE 0 END)) AS gap FROM top GROUP BY bin)"))
def top_ece(t):
    return M.ece(S.outcomes(t).where("rank = 1").withColumn("y", M.hit()), "p", "y")


@query("ag28_one_vs_rest_ece", S.with_outcomes("""SELECT condition_id, round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT condition_id, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n,
    abs(avg(p) - avg(CASE WHEN condition_id = truth THEN 1.0 ELSE 0 END)) AS gap FROM o GROUP BY 1, 2) GROUP BY condition_id"""))  # fmt: skip
def ovr_ece(t):
    return M.ece(S.outcomes(t).withColumn("y", M.hit()), "p", "y", by=("condition_id",))


@query("ag29_brier", S.with_outcomes("SELECT round(sum((p - CASE WHEN condition_id = truth THEN 1 ELSE 0 END) ** 2) / count(DISTINCT case_id), 6) AS brier FROM o"))
def brier(t):
    return M.brier(S.outcomes(t))


@query("ag30_log_loss", S.with_outcomes(f"SELECT round(-avg(ln(greatest(p, 1e-15))), 6) AS log_loss {OF_TRUTH}"))
def log_loss(t):
    return M.log_loss(S.outcomes(t))


@query("ag31_confusion_matrix", S.with_outcomes("""SELECT a.condition_id AS truth, b.condition_id AS predicted, coalesce(n, 0) AS n FROM pri a CROSS JOIN pri b
    LEFT JOIN (SELECT truth, condition_id, count(*) AS n FROM o WHERE rank = 1 GROUP BY ALL) x ON x.truth = a.condition_id AND x.condition_id = b.condition_id"""))  # fmt: skip
def confusion(t):
    return M.confusion(S.outcomes(t), S.conditions(t))


@query("ag32_recall_by_condition", S.with_outcomes(f"SELECT truth, {share('rank <= 1')} AS top1, {share('rank <= 3')} AS top3, {share('rank <= 5')} AS top5 {OF_TRUTH} GROUP BY truth"))
def recall_by_condition(t):
    return M.top_k(S.outcomes(t), by=("truth",))


@query("ag33_miss_analysis", S.with_outcomes("""
    SELECT a.truth, CASE WHEN a.rank > 5 THEN '>5' ELSE CAST(a.rank AS VARCHAR) END AS bucket, b.condition_id AS above, count(*) AS n
    FROM o a JOIN o b ON b.case_id = a.case_id AND b.rank < a.rank WHERE a.condition_id = a.truth AND a.rank > 3 GROUP BY ALL"""))  # fmt: skip
def misses(t):
    o = S.outcomes(t)
    missed = M.of_truth(o).where("rank > 3").select("case_id", F.col("rank").alias("at"), F.when(F.col("rank") > 5, ">5").otherwise(F.col("rank").cast("string")).alias("bucket"))
    return o.join(missed, "case_id").where("rank < at").groupBy("truth", "bucket", F.col("condition_id").alias("above")).agg(N.alias("n"))


@query("ag34_error_overlap", S.with_outcomes("""
    , f AS (SELECT case_id, condition_id, truth, row_number() OVER (PARTITION BY case_id ORDER BY flagged DESC, p DESC, ord) AS r2, rank FROM o)
    SELECT count(*) FILTER (rank > 1 AND r2 > 1) AS persisting, count(*) FILTER (rank = 1 AND r2 > 1) AS new, count(*) FILTER (rank > 1 AND r2 = 1) AS resolved FROM f WHERE condition_id = truth"""))  # fmt: skip
def overlap(t):
    o = R.rank_scores(S.outcomes(t), "p", first=F.col("flagged"), name="r2")
    a, b = F.col("rank") > 1, F.col("r2") > 1
    return M.of_truth(o).agg(F.count_if(a & b).alias("persisting"), F.count_if(~a & b).alias("new"), F.count_if(a & ~b).alias("resolved"))


POINT = f"count(*) AS n, {share('rank <= 1')} AS top1, {share('rank <= 3')} AS top3, {share('rank <= 5')} AS top5, round(avg(1.0 / rank), 6) AS mrr, {share('critical AND rank <= 3', 'critical')} AS critical_recall3, {share('critical AND rank > 3', 'critical')} AS dangerous_rate"


@query("ag35_point_metrics", S.with_outcomes(f"SELECT {POINT} {OF_TRUTH}"))
def point(t):
    return M.point_metrics(S.outcomes(t))


@query("ag36_seed_summary", f"WITH {S.CASES} SELECT seg, round(avg(bal), 6) AS mean, round(coalesce(stddev_samp(bal), 0), 6) AS sd, min(bal) AS least, max(bal) AS most FROM cases GROUP BY seg")
def seed_summary(t):
    return S.cases(t).groupBy("seg").agg(F.round(F.avg("bal"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("bal"), F.lit(0.0)), 6).alias("sd"), F.min("bal").alias("least"), F.max("bal").alias("most"))


@query("ag37_subgroup_breakdown", S.with_outcomes(f"""SELECT truth, sex, seg, count(*) AS n, {share('rank <= 1')} AS top1, {share('rank <= 3')} AS top3, round(avg(1.0 / rank), 6) AS mrr
    {OF_TRUTH} GROUP BY GROUPING SETS ((truth), (sex), (seg))"""))  # fmt: skip
def subgroups(t):
    rows = M.of_truth(S.outcomes(t))
    sets = [[F.col("truth")], [F.col("sex")], [F.col("seg")]]
    return rows.groupingSets(sets, "truth", "sex", "seg").agg(N.alias("n"), M.share(F.col("rank") <= 1).alias("top1"), M.share(F.col("rank") <= 3).alias("top3"), M.share(1 / F.col("rank")).alias("mrr"))


GRADES = "g AS (SELECT doc_id, quality + toxic AS a, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE quality + toxic END AS b FROM labels)"


def _grades(t):
    a = F.col("quality") + F.col("toxic")
    return t.labels.select("doc_id", a.alias("a"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(a).alias("b"))


@query("ag40_cohens_kappa", f"""WITH {GRADES}, w AS (SELECT 'none' AS kind, 1 AS ord), n AS (SELECT count(*) AS n FROM g), i AS (SELECT a AS i, count(*) AS ni FROM g GROUP BY a), j AS (SELECT b AS j, count(*) AS nj FROM g GROUP BY b),
    grid AS (SELECT i, j, ni, nj, (SELECT count(*) FROM g WHERE a = i AND b = j) AS nij FROM i CROSS JOIN j)
    SELECT kind, round(1 - sum(w * nij) / (sum(w * ni * nj) / (SELECT n FROM n)), 6) AS kappa FROM (
        SELECT 'none' AS kind, CASE WHEN i <> j THEN 1.0 ELSE 0 END AS w, * FROM grid UNION ALL SELECT 'linear', abs(i - j) / 2, * FROM grid UNION ALL SELECT 'quadratic', (abs(i - j) / 2) ** 2, * FROM grid) GROUP BY kind""")  # fmt: skip
def kappa(t):
    g, out = _grades(t), None
    for kind in ("none", "linear", "quadratic"):
        one = M.kappa(g, "a", "b", 3, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.union(one)
    return out


JUDGED = "j AS (SELECT d.source AS query_id, d.doc_id AS item, l.quality + (1 - l.toxic) AS grade, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels l USING (doc_id))"


def _judged(t):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id").withColumn("rank", rank).select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"), (F.col("quality") + 1 - F.col("toxic")).alias("grade"), "rank")


@query("ag41_ndcg_p3", f"""WITH {JUDGED}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS ideal FROM j),
    q AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN grade / log2(ideal + 1) ELSE 0 END) AS best, count(*) FILTER (rank <= 3 AND grade > 0) / 3 AS p3 FROM i GROUP BY query_id)
    SELECT query_id, round(dcg / best, 6) AS ndcg, round(p3, 6) AS p3 FROM q WHERE best > 0""")  # fmt: skip
def ndcg(t):
    return M.ndcg(_judged(t))


@query("ag42_pool_summary", f"WITH {JUDGED}, c AS (SELECT s.source, count(j.item) AS n FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN j ON j.query_id = s.source GROUP BY s.source) SELECT min(n) AS least, round(quantile_cont(n, 0.5), 6) AS median, max(n) AS most, count(*) FILTER (n = 0) AS empty FROM c")
def pool_summary(t):
    n = t.documents.select(F.col("source").alias("query_id")).distinct().join(_judged(t).groupBy("query_id").agg(N.alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.agg(F.min("n").alias("least"), F.round(F.percentile("n", 0.5), 6).alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("empty"))


@query("ag46_latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency(t):
    return O.latency(t.events, "event_type", "value")


@query("ag47_dissection_effect", S.with_outcomes("""
    , r AS (SELECT o.case_id, o.truth, o.condition_id, o.rank, o.rank - CASE WHEN x.rank < o.rank THEN 1 ELSE 0 END AS without FROM o JOIN o x ON x.case_id = o.case_id AND x.condition_id = '1-URGENT' WHERE o.condition_id = o.truth AND o.truth <> '1-URGENT')
    SELECT count(*) FILTER (rank > 3 AND without <= 3) AS pushed_out, round(avg(CASE WHEN without <= 3 THEN 1.0 ELSE 0 END), 6) AS top3_without FROM r"""))  # fmt: skip
def dissection(t):
    o = S.outcomes(t)
    w = R.rank_without(o, "1-URGENT").select("case_id", "condition_id", F.col("rank").alias("without"))
    rows = M.of_truth(o).join(w, ["case_id", "condition_id"])
    return rows.agg(F.count_if((F.col("rank") > 3) & (F.col("without") <= 3)).alias("pushed_out"), M.share(F.col("without") <= 3).alias("top3_without"))


@query("ag48_cutoff_sweep", f"WITH {S.CASES} SELECT k AS cutoff, {share('bal >= k * 1000')} AS flagged FROM cases CROSS JOIN (VALUES (6), (7), (8)) v(k) GROUP BY k")
def cutoffs(t):
    ks = t.rows([(6,), (7,), (8,)], "cutoff int")
    return S.cases(t).crossJoin(F.broadcast(ks)).groupBy("cutoff").agg(M.share(F.col("bal") >= F.col("cutoff") * 1000).alias("flagged"))


@query("ag49_top_is_not_most_probable", S.with_all("""
    , a AS (SELECT case_id, condition_id, row_number() OVER (PARTITION BY case_id ORDER BY kg DESC, ord) AS k FROM kg)
    SELECT count(*) AS n FROM a JOIN o USING (case_id, condition_id) WHERE a.k = 1 AND o.rank <> 1"""))  # fmt: skip
def top_not_probable(t):
    a = R.rank_scores(S.kg_scores(t), "kg", name="k").where("k = 1").select("case_id", "condition_id")
    return S.outcomes(t).where("rank <> 1").join(a, ["case_id", "condition_id"], "left_semi").agg(N.alias("n"))


@query("ag53_miss_counts", S.with_outcomes("SELECT seg, count(*) FILTER (rank > 3) AS misses, count(*) FILTER (rank > 3 AND critical) AS critical_misses FROM o WHERE condition_id = truth GROUP BY seg"))
def miss_counts(t):
    return M.of_truth(S.outcomes(t)).groupBy("seg").agg(F.count_if(F.col("rank") > 3).alias("misses"), F.count_if((F.col("rank") > 3) & F.col("critical")).alias("critical_misses"))


@query("st08_evaluate_all", S.with_outcomes(f", x AS (SELECT {POINT} {OF_TRUTH}) SELECT metric, value FROM (UNPIVOT (SELECT top1, top3, top5, mrr, critical_recall3, dangerous_rate FROM x) ON COLUMNS(*) INTO NAME metric VALUE value)"))
def evaluate_all(t):
    names = ["top1", "top3", "top5", "mrr", "critical_recall3", "dangerous_rate"]
    return M.point_metrics(S.outcomes(t)).unpivot([], names, "metric", "value")


@query("ag50_model_report", S.with_outcomes(f"SELECT coalesce(truth, 'all') AS truth, {POINT} {OF_TRUTH} GROUP BY ROLLUP (truth)"))
def model_report(t):
    o = S.outcomes(t)
    return M.point_metrics(o, ("truth",)).unionByName(M.point_metrics(o).withColumn("truth", F.lit("all")))


@query("ag43_realised_mask_sizes", f"""WITH {S.TOK}, m AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sha256(case_id || ':' || raw)) AS k, count(*) OVER (PARTITION BY case_id) AS n FROM tok)
    SELECT share, round(count(*) FILTER (k <= round_even(n * share, 0)) / count(DISTINCT case_id), 6) AS mean_tokens FROM m CROSS JOIN (VALUES (0.25), (0.5), (1.0)) v(share) GROUP BY share""")  # fmt: skip
def mask_sizes(t):
    shares = t.rows([(0.25,), (0.5,), (1.0,)], "share double")
    w = Window.partitionBy("case_id")
    m = S.tokens(t).withColumn("k", F.row_number().over(w.orderBy(F.sha2(F.concat_ws(":", F.col("case_id").cast("string"), "raw"), 256)))).withColumn("n", F.count(F.lit(1)).over(w))
    kept = F.count_if(F.col("k") <= F.bround(F.col("n") * F.col("share"), 0))
    return m.crossJoin(F.broadcast(shares)).groupBy("share").agg(F.round(kept / F.count_distinct("case_id"), 6).alias("mean_tokens"))
