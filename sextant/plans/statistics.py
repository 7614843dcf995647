"""Queries of statistics, fits, decisions and models (ST, FU07-09, ML08-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import boosting as B
from sextant.operators import decisions as D
from sextant.operators import fusion as P
from sextant.operators import metrics as M
from sextant.operators import ranking as R
from sextant.operators import resampling as E
from sextant.operators import statistics as T
from sextant.operators import transformer as X
from sextant.plans import standin as S
from sextant.plans.registry import N, query

FLAG_FIRST = ", f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY flagged DESC, p DESC, ord) AS r2 FROM o), h AS (SELECT * FROM f WHERE condition_id = truth)"


def both(t):
    """Each case's true condition with its rank by score and its rank flags first."""
    return M.of_truth(R.rank_scores(S.outcomes(t), "p", first=F.col("flagged"), name="r2"))


def drawn_sql(rows: str, key: str) -> str:
    """SQL for resampled(): rows has the key and more columns; the result adds b and w."""
    steps = " + ".join(f"CASE WHEN u >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in T.poisson_steps())
    return f"""SELECT *, {steps} AS w FROM (SELECT * EXCLUDE (xc, xd, xj), xc * 4 + xj AS b, ('0x' || substr(xd, CAST(1 + 8 * xj AS INT), 8))::UBIGINT / 4294967296.0::DOUBLE AS u
        FROM (SELECT *, md5({key} || ':42:' || xc) AS xd FROM ({rows}) CROSS JOIN range(50) x(xc)) CROSS JOIN range(4) y(xj))"""


def interval_sql(rows: str, by: str = "") -> str:
    """SQL for poisson_bootstrap() of rows with case_id, num and den."""
    group, using = (f"GROUP BY {by}", f"JOIN e USING ({by})") if by else ("", "CROSS JOIN e")
    cols = f"{by}, " if by else ""
    return f"""pairs AS ({rows}), r AS (SELECT {cols}b, sum(w * num) / nullif(sum(w * den), 0) AS r FROM ({drawn_sql("SELECT * FROM pairs", "case_id")}) GROUP BY {cols}b),
        e AS (SELECT {cols}quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM r {group}), v AS (SELECT {cols}sum(num) / sum(den) AS value FROM pairs {group}),
        ci AS (SELECT v.*, low, high FROM v {using})"""


ROUNDED = "round(value, 6) + 0.0 AS value, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high"


def interval(pairs, by: tuple[str, ...] = ()):
    """poisson_bootstrap of (case_id, num, den), rounded, a negative zero made zero."""
    ci = T.poisson_bootstrap(pairs, "case_id", "num", "den", by=by)
    return ci.withColumns({c: F.round(c, 6) + 0.0 for c in ("value", "low", "high")})


@query("st01_bootstrap_ratio_ci", S.with_outcomes(", " + interval_sql("SELECT case_id, seg, CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END AS num, 1.0::DOUBLE AS den FROM o WHERE condition_id = truth", "seg") + " SELECT seg, " + ROUNDED + " FROM ci"))
def bootstrap_ci(t):
    """Hash-drawn Poisson resamples."""
    pairs = both(t).select("case_id", "seg", (F.col("rank") <= 3).cast("double").alias("num"), F.lit(1.0).alias("den"))
    return interval(pairs, ("seg",))


@query("st02_binned_gap_ci", S.with_outcomes(", " + interval_sql("SELECT case_id, least(CAST(floor(p * 10) AS INT), 9) AS bin, p - CASE WHEN condition_id = truth THEN 1.0::DOUBLE ELSE 0 END AS num, 1.0::DOUBLE AS den FROM o WHERE rank = 1", "bin") + " SELECT bin, " + ROUNDED + " FROM ci"))
def binned_gap(t):
    top = S.outcomes(t).where("rank = 1").withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"))
    pairs = top.select("case_id", "bin", (F.col("p") - M.hit().cast("double")).alias("num"), F.lit(1.0).alias("den"))
    return interval(pairs, ("bin",))


@query("st03_mcnemar_counts", S.with_outcomes(FLAG_FIRST + " SELECT count(*) FILTER (rank = 1 AND r2 <> 1) AS only_a, count(*) FILTER (rank <> 1 AND r2 = 1) AS only_b FROM h"))
def mcnemar_counts(t):
    return T.discordant(both(t), F.col("rank") == 1, F.col("r2") == 1)


_ERFC_SQL = " + ".join(f"{c}::DOUBLE * u ** {i}" for i, c in enumerate(T.ERFC))
#: SQL for mcnemar() of c(only_a, only_b), to six decimals.
MCNEMAR_SQL = f"""m AS (SELECT only_a, only_b, only_a + only_b AS n, least(only_a, only_b) AS low, greatest(abs(only_a - only_b) - 1, 0) / sqrt(2.0::DOUBLE * nullif(only_a + only_b, 0)) AS z FROM c),
    y AS (SELECT *, 1 / (1 + 0.5 * z) AS u FROM m)
    SELECT only_a, only_b, round(CASE WHEN n = 0 THEN 1 WHEN n < 25 THEN least(1, 2 * list_sum(list_transform(range(0, low + 1), lambda i: (factorial(CAST(n AS INT)) / (factorial(CAST(i AS INT)) * factorial(CAST(n - i AS INT))))::DOUBLE)) / 2.0 ** n)
        ELSE u * exp(-z * z + {_ERFC_SQL}) END, 6) AS p FROM y"""


@query("st03_mcnemar_p", S.with_outcomes(FLAG_FIRST + ", c AS (SELECT count(*) FILTER (rank = 1 AND r2 <> 1) AS only_a, count(*) FILTER (rank <> 1 AND r2 = 1) AS only_b FROM h), " + MCNEMAR_SQL))
def mcnemar_p(t):
    c = T.discordant(both(t), F.col("rank") == 1, F.col("r2") == 1).first()
    return t.rows([(c["only_a"], c["only_b"], round(T.mcnemar(c["only_a"], c["only_b"]), 6))], "only_a long, only_b long, p double")


def _metrics(t):
    """Numerators of both orders' metrics on each case, and their denominators."""
    h, cols = both(t), {"one": F.lit(1.0), "crit": F.col("critical").cast("double")}
    for r, x in (("rank", "a"), ("r2", "b")):
        hit = (F.col(r) <= 3).cast("double")
        cols |= {f"top3_{x}": hit, f"mrr_{x}": 1 / F.col(r), f"crit3_{x}": hit * F.col("critical").cast("double")}
    return h.withColumns(cols)


@query("st01_exact_bootstrap")
def exact_bootstrap(t):
    """A thousand draws of the cases of each segment with replacement, the same for all metrics."""
    return E.bootstrap(_metrics(t), {"top3": ("top3_a", "one"), "mrr": ("mrr_a", "one"), "critical_top3": ("crit3_a", "crit")}, ["seg"])


@query("st04_exact_differences")
def exact_differences(t):
    """Flags first against scores alone, on the same draws: what ST07 and ST16 report beside McNemar's test."""
    return E.differences(_metrics(t), {"top3": ("top3_a", "top3_b", "one"), "mrr": ("mrr_a", "mrr_b", "one"), "critical_top3": ("crit3_a", "crit3_b", "crit")})


@query("st04_paired_difference_ci", S.with_outcomes(FLAG_FIRST + ", " + interval_sql("SELECT case_id, CASE WHEN r2 <= 3 THEN 1.0::DOUBLE ELSE 0 END - CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END AS num, 1.0::DOUBLE AS den FROM h") + " SELECT " + ROUNDED + ", low > 0 OR high < 0 AS excludes_zero FROM ci"))
def paired_difference(t):
    pairs = both(t).select("case_id", ((F.col("r2") <= 3).cast("double") - (F.col("rank") <= 3).cast("double")).alias("num"), F.lit(1.0).alias("den"))
    return interval(pairs).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


@query("st05_paired_rate_difference", S.with_outcomes(FLAG_FIRST + " SELECT seg, round(avg(CASE WHEN r2 <= 3 THEN 1.0 ELSE 0 END) - avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS difference FROM h GROUP BY seg"))
def rate_difference(t):
    return both(t).groupBy("seg").agg(F.round(F.avg((F.col("r2") <= 3).cast("double")) - F.avg((F.col("rank") <= 3).cast("double")), 6).alias("difference"))


@query("st06_degradation_contrast", S.with_outcomes(FLAG_FIRST + " SELECT round((avg(CASE WHEN r2 <= 1 THEN 1.0 ELSE 0 END) FILTER (sex = 'F') - avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) FILTER (sex = 'F')) - (avg(CASE WHEN r2 <= 1 THEN 1.0 ELSE 0 END) FILTER (sex <> 'F') - avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) FILTER (sex <> 'F')), 6) AS contrast FROM h"))
def contrast(t):
    hit = lambda r, where: F.avg(F.when(where, (F.col(r) <= 1).cast("double")))
    f, g = F.col("sex") == "F", F.col("sex") != "F"
    return both(t).agg(F.round((hit("r2", f) - hit("rank", f)) - (hit("r2", g) - hit("rank", g)), 6).alias("contrast"))


@query("st07_compare_systems", S.with_outcomes(FLAG_FIRST + """ SELECT round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS top3_a, round(avg(CASE WHEN r2 <= 3 THEN 1.0 ELSE 0 END), 6) AS top3_b, round(avg(1.0 / rank), 6) AS mrr_a, round(avg(1.0 / r2), 6) AS mrr_b,
    round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) FILTER (critical), 6) AS critical_a, round(avg(CASE WHEN r2 <= 3 THEN 1.0 ELSE 0 END) FILTER (critical), 6) AS critical_b FROM h"""))  # fmt: skip
def compare(t):
    crit = F.col("critical").cast("int")
    out = []
    for r, x in (("rank", "a"), ("r2", "b")):
        out += [M.share(F.col(r) <= 3).alias(f"top3_{x}"), M.share(1 / F.col(r)).alias(f"mrr_{x}"), M.share((F.col(r) <= 3) & F.col("critical"), crit).alias(f"critical_{x}")]
    return both(t).agg(*out)


_CHECK_SQL = """c AS (SELECT critical, seg AS level, count(*) AS n, avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS top_a, avg(CASE WHEN r2 <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS top_b, avg(1.0::DOUBLE / rank) AS mrr_a, avg(1.0::DOUBLE / r2) AS mrr_b,
        count(*) FILTER (rank <= 3 AND r2 > 3) AS only_a, count(*) FILTER (rank > 3 AND r2 <= 3) AS only_b FROM h GROUP BY ALL)"""


@query("st07_compare_levels", S.with_outcomes(FLAG_FIRST + ", " + _CHECK_SQL + ", " + MCNEMAR_SQL.replace("SELECT only_a, only_b, only_a + only_b AS n,", "SELECT critical, level, n AS cases, top_a, top_b, mrr_a, mrr_b, only_a, only_b, only_a + only_b AS n,").replace("SELECT only_a, only_b, round(", "SELECT critical, level, cases, round(top_a, 6) AS top_a, round(top_b, 6) AS top_b, round(mrr_a, 6) AS mrr_a, round(mrr_b, 6) AS mrr_b, only_a, only_b, round(")))
def compare_levels(t):
    """Both orders in each segment, critical cases apart: shares, mean reciprocal ranks and McNemar's test."""
    return _compared(t).select("critical", "level", F.col("n").alias("cases"), *[F.round(c, 6).alias(c) for c in ("top_a", "top_b", "mrr_a", "mrr_b")], "only_a", "only_b", F.round("p", 6).alias("p"))


def _compared(t):
    top = lambda r: F.avg((F.col(r) <= 3).cast("double"))
    g = both(t).groupBy("critical", F.col("seg").alias("level")).agg(N.alias("n"), top("rank").alias("top_a"), top("r2").alias("top_b"), F.avg(1 / F.col("rank")).alias("mrr_a"), F.avg(1 / F.col("r2")).alias("mrr_b"), F.count_if((F.col("rank") <= 3) & (F.col("r2") > 3)).alias("only_a"), F.count_if((F.col("rank") > 3) & (F.col("r2") <= 3)).alias("only_b"))
    return g.withColumn("p", T.mcnemar_column(F.col("only_a"), F.col("only_b")))


@query("st10_verdict_rules", S.with_outcomes(FLAG_FIRST + ", " + _CHECK_SQL + ", " + MCNEMAR_SQL.replace("SELECT only_a, only_b, only_a + only_b AS n,", "SELECT critical, level, n AS cases, top_a, top_b, mrr_a, mrr_b, only_a, only_b, only_a + only_b AS n,").replace("    SELECT only_a, only_b, round(", ", d AS (SELECT critical, level, cases, top_a, top_b, mrr_a, mrr_b, only_a, only_b, round(") + """),
    k AS (SELECT CASE WHEN critical THEN 'critical' ELSE 'other' END || ' ' || m AS claim, level, m, CASE WHEN m = 'top3' THEN top_b ELSE mrr_b END AS a, CASE WHEN m = 'top3' THEN top_a ELSE mrr_a END AS b, cases, p FROM d, (VALUES ('top3'), ('mrr')) v(m)),
    j AS (SELECT *, CASE WHEN m = 'top3' THEN p < 0.05 AND a > b ELSE a > b END AS passed, b >= 1 OR (m <> 'mrr' AND round((1 - b) * cases) <= 5) AS ceiling FROM k)
    SELECT claim, CASE WHEN bool_and(passed) THEN 'supported' ELSE 'not supported' END AS status, count(*) AS checks, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (NOT passed AND ceiling) AS failed_at_a_ceiling FROM j GROUP BY claim"""))  # fmt: skip
def verdicts(t):
    """Flags first against scores alone: a claim for either group and metric, checked in every segment."""
    d = _compared(t)
    group = F.when(F.col("critical"), "critical").otherwise("other")
    part = lambda m, rule, a, b: d.select(F.concat(group, F.lit(f" {m}")).alias("claim"), F.lit(m).alias("metric"), F.lit(rule).alias("rule"), F.col(a).alias("a"), F.col(b).alias("b"), F.col("n").alias("cases"), F.round("p", 6).alias("p"))
    return D.verdicts(part("top3", "significant", "top_b", "top_a").union(part("mrr", "higher", "mrr_b", "mrr_a")))


@query("st11_safety_floor", S.with_outcomes(FLAG_FIRST + " SELECT round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) FILTER (critical), 6) AS a, round(avg(CASE WHEN r2 <= 3 THEN 1.0 ELSE 0 END) FILTER (critical), 6) AS b, avg(CASE WHEN r2 <= 3 THEN 1.0 ELSE 0 END) FILTER (critical) >= avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) FILTER (critical) - 0.005 AS non_inferior FROM h"))
def safety_floor(t):
    x = lambda r: F.avg(F.when(F.col("critical"), (F.col(r) <= 3).cast("double")))
    return both(t).agg(F.round(x("rank"), 6).alias("a"), F.round(x("r2"), 6).alias("b"), (x("r2") >= x("rank") - 0.005).alias("non_inferior"))


@query("st12_seed_agreement", "SELECT claim, count(*) FILTER (holds) AS seeds, count(*) = count(*) FILTER (holds) AS agree FROM (SELECT l_linenumber % 5 AS seed, l_returnflag AS claim, avg(l_discount) > 0.05 AS holds FROM lineitem GROUP BY ALL) GROUP BY claim")
def seed_agreement(t):
    s = t.lineitem.groupBy((F.col("l_linenumber") % 5).alias("seed"), F.col("l_returnflag").alias("claim")).agg((F.avg("l_discount") > 0.05).alias("holds"))
    return s.groupBy("claim").agg(F.count_if("holds").alias("seeds"), (F.count(F.lit(1)) == F.count_if("holds")).alias("agree"))


@query("st13_reconciliation", "SELECT count(*) AS metrics, count(*) FILTER (abs(a - b) > 1e-9) AS differing FROM (SELECT l_returnflag AS m, sum(l_quantity) AS a FROM lineitem GROUP BY 1) x FULL JOIN (SELECT l_returnflag AS m, sum(l_quantity) AS b FROM lineitem GROUP BY 1) y USING (m)")
def reconciliation(t):
    a = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("a"))
    b = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("b")).groupBy("l_returnflag").agg(F.sum("b").alias("b"))
    return a.join(b, "l_returnflag", "full").agg(N.alias("metrics"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("differing"))


def _scored(t):
    return S.outcomes(t).select("p", M.hit().alias("y"))


@query("fu07_temperature_fit", S.with_outcomes(""", g AS (SELECT exp(ln(0.05::DOUBLE) + (ln(20.0::DOUBLE) - ln(0.05::DOUBLE)) * i / 40) AS temperature FROM range(41) r(i)), q AS (SELECT greatest(least(p, 1 - 1e-9::DOUBLE), 1e-9::DOUBLE) AS q, condition_id = truth AS y FROM o),
    l AS (SELECT temperature, avg(ln(1 + exp(CASE WHEN y THEN -ln(q / (1 - q)) ELSE ln(q / (1 - q)) END / temperature))) AS loss FROM q CROSS JOIN g GROUP BY temperature)
    SELECT round(temperature, 6) AS temperature, round(loss, 6) AS loss FROM l ORDER BY l.loss, l.temperature LIMIT 1"""))
def temperature(t):
    return T.fit_temperature(_scored(t), "p", "y").select(*[F.round(c, 6).alias(c) for c in ("temperature", "loss")])


@query("fu08_platt_fit")
def platt(t):
    a, b = T.fit_platt(_scored(t), "p", "y")
    return t.rows([(a, b)], "a double, b double")


@query("fu09_isotonic_fit")
def isotonic(t):
    return T.fit_isotonic(_scored(t), "p", "y")


@query("ml08_multinomial_lr")
def multinomial(t):
    """Max-abs scaling and softmax regression by Spark's own learner; coefficients by class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import MaxAbsScaler, VectorAssembler

    kinds = t.events.select("event_type").distinct().orderBy("event_type")
    ids = {r[0]: float(i) for i, r in enumerate(kinds.collect())}  # the classes, a handful
    label = F.element_at(F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    rows = t.events.select(label.alias("label"), "value", F.hour("ts").cast("double").alias("hour"))
    v = VectorAssembler(inputCols=["value", "hour"], outputCol="raw").transform(rows)
    scaled = MaxAbsScaler(inputCol="raw", outputCol="features").fit(v).transform(v)
    m = LogisticRegression(family="multinomial", maxIter=20).fit(scaled)
    out = [(k, float(m.interceptVector[int(i)]), [float(x) for x in m.coefficientMatrix.toArray()[int(i)]]) for k, i in ids.items()]
    return t.rows(out, "class string, intercept double, coefficients array<double>")


@query("ml10_tree_ensemble")
def trees(t):
    """A random forest stands in for multi-class boosted trees, which Spark lacks; importances by feature."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("double").alias("label"), "l_quantity", "l_discount", "l_tax")
    v = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(rows)
    m = RandomForestClassifier(numTrees=10, maxDepth=4, seed=42).fit(v)
    names = ["l_quantity", "l_discount", "l_tax"]
    return t.rows([(n, float(x)) for n, x in zip(names, m.featureImportances.toArray(), strict=True)], "feature string, importance double")


@query("ml10_boosted_trees")
def boosted(t):
    """Trees that tell the language of a document by its length and shares of letters, stopped on a fifth of them; every node, and the watched loss after its round."""
    size = F.greatest(F.length("text"), F.lit(1))
    shares = {f"share_{x}": F.round((F.length("text") - F.length(F.replace(F.col("text"), F.lit(x)))) / size, 3) for x in ("e", "h", "o", "u")}
    rows = t.documents.select("lang", "n_chars", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("watched"), *[v.alias(k) for k, v in shares.items()])
    m = B.fit(rows, ["n_chars", *shares], "lang", F.col("watched"), rounds=5, depth=3, rate=0.3, bins=32)
    losses = t.rows(list(enumerate(m.losses[1:])), "round int, watched_loss double")
    return m.table(t.spark).join(losses, "round")


#: Columns, tokens, classes, width, hidden width, blocks and heads of the forward pass.
COLUMNS, TOKENS, CLASSES, WIDTH, HIDDEN, BLOCKS, HEADS = 64, 16, 5, 16, 24, 2, 4


@query("ml11_transformer_forward")
def transformer(t):
    """Class logits of every vector: its columns as sixteen tokens, two blocks of four heads; the weights are a table drawn by hash."""
    needed = X.shapes(COLUMNS, TOKENS, CLASSES, WIDTH, HIDDEN, BLOCKS)
    weights = X.gathered(X.drawn(t.spark, needed), needed)
    model = X.Transformer(weights, [c * TOKENS // COLUMNS for c in range(COLUMNS)], HEADS, BLOCKS)
    return X.class_logits(t.embeddings, "vec_id", "embedding", model)


@query("ml13_complexity", "SELECT p_size AS width, count(*) AS n, p_size * p_size * 4 + p_size * 4 AS parameters FROM part GROUP BY p_size")
def complexity(t):
    w = F.col("p_size")
    return t.part.groupBy(w.alias("width")).agg(N.alias("n")).withColumn("parameters", F.col("width") * F.col("width") * 4 + F.col("width") * 4)


@query("ml14_occlusion_reasons", f"""WITH {S.PRI}, {S.CASES}, {S.TOK}, {S.EDGES}, {S.STRONGEST}, few AS (SELECT case_id, truth FROM cases WHERE seg = 'BUILDING'),
    x AS (SELECT t.case_id, t.raw AS concept_id, p.condition_id, ln(greatest(least(coalesce(s.weight, 0.01), 0.9), 0.01)) AS part FROM tok t JOIN few USING (case_id) CROSS JOIN pri p LEFT JOIN strongest s ON s.condition_id = p.condition_id AND s.concept_id = t.raw),
    y AS (SELECT *, sum(part) OVER (PARTITION BY case_id, condition_id) AS whole FROM x),
    z AS (SELECT *, exp(whole - max(whole) OVER v) AS a, exp(whole - part - max(whole - part) OVER v) AS b FROM y WINDOW v AS (PARTITION BY case_id, concept_id)),
    e AS (SELECT case_id, concept_id, condition_id, ln(a) - ln(sum(a) OVER v - a) - (ln(b) - ln(sum(b) OVER v - b)) AS effect FROM z WINDOW v AS (PARTITION BY case_id, concept_id))
    SELECT case_id, concept_id, round(effect, 6) AS effect FROM e JOIN few USING (case_id) WHERE condition_id = truth""")  # fmt: skip
def occlusion(t):
    """The effect of each finding on the case's own condition, of one segment's cases."""
    present = S.evidence(t).where("seg = 'BUILDING'").select("case_id", "truth", F.explode("raws").alias("concept_id"))
    effects = S.G.occlusion(present, S.G.strongest_edges(S.edges(t)), S.conditions(t), "truth")
    return effects.select("case_id", "concept_id", F.round("effect", 6).alias("effect"))


@query("ml15_constant_ranker", S.with_outcomes("SELECT case_id, condition_id, ord AS rank FROM ml"))
def constant(t):
    grid = S.cases(t).select("case_id").crossJoin(F.broadcast(S.conditions(t))).withColumn("p", F.lit(0.2))
    return R.rank_scores(grid, "p").select("case_id", "condition_id", "rank")


@query("ml17_empty_row_probe", f"WITH {S.CASES} SELECT truth AS answer FROM cases GROUP BY truth ORDER BY count(*) DESC, truth LIMIT 1")
def empty_probe(t):
    return S.cases(t).groupBy("truth").agg(N.alias("n")).orderBy(F.desc("n"), "truth").limit(1).select(F.col("truth").alias("answer"))


@query("st18_alpha_source", "SELECT c_mktsegment AS arm, CASE WHEN count(*) FILTER (c_acctbal < 0) * 100 >= count(*) * 9 THEN round(count(*) FILTER (c_acctbal < 0) / count(*), 6) ELSE 0.5 END AS alpha, CASE WHEN count(*) FILTER (c_acctbal < 0) * 100 >= count(*) * 9 THEN 'tuned' ELSE 'default' END AS source FROM customer GROUP BY c_mktsegment")
def alpha_source(t):
    """Each segment is an arm; its weight is tuned where enough of its customers owe, else the default."""
    arms = t.customer.select(F.col("c_mktsegment").alias("arm")).distinct()
    low = F.count_if(F.col("c_acctbal") < 0)
    tuned = t.customer.groupBy(F.col("c_mktsegment").alias("arm")).agg(low.alias("low"), N.alias("n")).where("low * 100 >= n * 9").select("arm", F.round(F.col("low") / F.col("n"), 6).alias("alpha"))
    return P.alpha_source(arms, tuned)


@query("st09_kappa_interval", f"""WITH g AS (SELECT d.source AS q, l.quality + l.toxic AS i, CASE WHEN l.doc_id % 7 = 0 THEN 1 ELSE l.quality + l.toxic END AS j FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT q, i, j, count(*) AS n FROM g GROUP BY ALL), d AS (SELECT b, i, j, sum(n) AS n FROM (SELECT b, i, j, n * w AS n FROM ({drawn_sql("SELECT * FROM c", "q")}) UNION ALL SELECT -1, i, j, n FROM c) GROUP BY ALL),
    l AS (SELECT b, i, sum(n) AS ni FROM d GROUP BY ALL), r AS (SELECT b, j, sum(n) AS nj FROM d GROUP BY ALL),
    e AS (SELECT b, i, j, ni, nj, coalesce(n, 0) AS n, abs(i - j) / 2 AS gap FROM l JOIN r USING (b) LEFT JOIN d USING (b, i, j)),
    k AS (SELECT b, 1 - sum(gap * n) * sum(n) / nullif(sum(gap * ni * nj), 0) AS k FROM e GROUP BY b)
    SELECT round(max(k) FILTER (b < 0), 6) AS value, round(quantile_cont(k, 0.025) FILTER (b >= 0), 6) AS low, round(quantile_cont(k, 0.975) FILTER (b >= 0), 6) AS high FROM k""")  # fmt: skip
def kappa_interval(t):
    a = F.col("quality") + F.col("toxic")
    g = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", a.alias("a"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(a).alias("b"))
    k = T.kappa_interval(g, "source", "a", "b", 3, "linear")
    return k.select(*[F.round(c, 6).alias(c) for c in ("value", "low", "high")])
