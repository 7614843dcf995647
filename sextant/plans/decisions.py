"""Queries of gates, rules and fallbacks (PRJ07, FU11, FU14, KG02, RT12, RT22, LM09, LM11, ML19)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import decisions as D
from sextant.operators import fusion as P
from sextant.operators import statistics as T
from sextant.operators import text as X
from sextant.plans import fusion as FU
from sextant.plans import retrieval as RT
from sextant.plans import standin as S
from sextant.plans.registry import N, query
from sextant.plans.statistics import interval_sql


@query("prj07_split_gate", "SELECT split, gate, count(*) AS n FROM (SELECT split, CASE WHEN split NOT IN ('train', 'validate', 'test') THEN 'unknown' WHEN split = 'test' AND o_orderkey % 2 = 0 THEN 'closed' ELSE 'read' END AS gate FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' ELSE 'other' END AS split FROM orders)) GROUP BY ALL")
def split_gate(t):
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "test").otherwise("other")
    rows = t.orders.select("o_orderkey", split.alias("split"))
    return rows.groupBy("split", D.split_gate(F.col("split"), F.col("o_orderkey") % 2 == 1).alias("gate")).agg(N.alias("n"))


@query("fu11_calibrator_gate", """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'ml' ELSE 'fused' END AS kind, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'trees' END AS backend, CASE WHEN p_size % 3 = 0 THEN 'models/other' ELSE 'models/' || CASE WHEN p_size % 2 = 0 THEN './' ELSE '' END || 'a' END AS dir, p_size % 11 AS tenth FROM part)
    SELECT p_partkey, CASE WHEN kind <> 'fused' THEN 'kind' WHEN backend IS NULL THEN 'backend' WHEN dir = 'models/other' THEN 'model_dir' WHEN tenth <> 5 THEN 'alpha' END AS mismatch FROM c""")  # fmt: skip
def calibrator_gate(t):
    size = F.col("p_size")
    folder = F.when(size % 3 == 0, "models/other").when(size % 2 == 0, "models/./a").otherwise("models\\a")
    about = t.part.select("p_partkey", F.when(size % 5 == 0, "ml").otherwise("fused").alias("kind"), F.when(size % 7 != 0, "trees").alias("backend"), folder.alias("model_dir"), ((size % 11) / 10.0).alias("alpha"))
    want = about.withColumns({"want_kind": F.lit("fused"), "want_backend": F.lit("trees"), "want_model_dir": F.lit("models/a/"), "want_alpha": F.lit(0.5)})
    return want.select("p_partkey", D.calibrator_mismatch().alias("mismatch"))


@query("fu14_shown_probability", S.with_all(f""", fit AS (SELECT * FROM (VALUES ('1-URGENT', 0.1, 1.2), ('2-HIGH', -0.2, 0.9), ('3-MEDIUM', 0.0, 1.0)) v(condition_id, a, b)),
    z AS (SELECT ml.*, a IS NOT NULL AS f, 1 / (1 + exp(-(a + b * ln(greatest(p, 1e-9))))) AS c FROM ml LEFT JOIN fit USING (condition_id)),
    y AS (SELECT *, CASE WHEN f THEN c * sum(CASE WHEN f THEN p END) OVER w / sum(c) OVER w ELSE p END AS calibrated, max(p) OVER w - min(p) OVER w < 1e-12 AS mute FROM z WINDOW w AS (PARTITION BY case_id)),
    g AS (SELECT DISTINCT case_id FROM tok)
    SELECT y.case_id, condition_id, round(CASE WHEN NOT mute AND g.case_id IS NOT NULL AND f THEN calibrated END, 6) AS shown FROM y LEFT JOIN g USING (case_id)"""))  # fmt: skip
def shown(t):
    """Calibrated probabilities; none where the model is mute, the case has no evidence or the condition no fit."""
    fitted = t.rows(FU.FITTED, "condition_id string, a double, b double")
    scored = P.calibrate(S.ml_scores(t), fitted).withColumn("in_model", F.lit(True)).withColumn("mute", P.abstains())
    graph = S.tokens(t).select("case_id").distinct().withColumn("graph_ok", F.lit(True))
    rows = scored.join(graph, "case_id", "left")
    value = D.shown_probability(F.col("calibrated"), F.col("mute"), F.coalesce("graph_ok", F.lit(False)), F.col("condition_id").isin(*[k for k, _, _ in FU.FITTED]))
    return rows.select("case_id", "condition_id", F.round(value, 6).alias("shown"))


FACTS = [("1-URGENT", "E_2", "typical", "Handbook 1"), ("1-URGENT", "E_2", "common", "Handbook 2"), ("2-HIGH", "E_1_@_V_1", "common", "Handbook 1"), ("9-NONE", "E_2", "common", "Handbook 1"), ("3-MEDIUM", "E_2", "often", "Handbook 3"), ("5-LOW", "E_1_@_V_3", "rare", " ")]
STRENGTHS = {"typical": 0.9, "common": 0.65, "rare": 0.12}
_FACTS = ", ".join(repr(x) for x in FACTS)


@query("kg02_facts_to_edges", f"""WITH f AS (SELECT * FROM (VALUES {_FACTS}) v(condition_id, concept_id, strength, reference)), r AS (SELECT DISTINCT o_orderpriority AS condition_id, true AS known FROM orders),
    w AS (SELECT f.*, known, CASE strength WHEN 'typical' THEN 0.9::DOUBLE WHEN 'common' THEN 0.65 WHEN 'rare' THEN 0.12 END AS weight FROM f LEFT JOIN r USING (condition_id)),
    j AS (SELECT *, CASE WHEN known IS NULL THEN 'unknown condition' WHEN weight IS NULL THEN 'unknown strength' WHEN trim(reference) = '' THEN 'no reference' END AS problem FROM w)
    SELECT condition_id, concept_id, max(weight) AS weight, array_to_string(list_sort(list(DISTINCT reference)), '; ') AS sources, NULL AS problem FROM j WHERE problem IS NULL GROUP BY ALL
    UNION ALL SELECT condition_id, concept_id, NULL, NULL, problem FROM j WHERE problem IS NOT NULL""")  # fmt: skip
def facts_to_edges(t):
    facts = t.rows(FACTS, "condition_id string, concept_id string, strength string, reference string")
    good, bad = D.facts_to_edges(facts, t.orders.select(F.col("o_orderpriority").alias("condition_id")).distinct(), STRENGTHS)
    good = good.select("condition_id", "concept_id", "weight", F.array_join("sources", "; ").alias("sources"), F.lit(None).cast("string").alias("problem"))
    return good.union(bad.select("condition_id", "concept_id", F.lit(None).cast("double"), F.lit(None).cast("string"), "problem"))


@query("rt12_retrieve", f"""WITH {RT.TWO}, a AS (SELECT f.*, d.source, d.text, row_number() OVER (PARTITION BY query, d.source ORDER BY round(score, 9) DESC, item) AS k FROM f JOIN documents d ON d.doc_id = item),
    b AS (SELECT query, item, source, score, text FROM a WHERE k = 1), se AS (SELECT query, item, generate_subscripts(string_split(text, '. '), 1) AS pos, unnest(string_split(text, '. ')) AS sentence FROM b),
    h AS (SELECT u.query, item, pos, count(*) AS n FROM (SELECT query, item, pos, unnest(list_distinct({RT.words_sql('sentence')})) AS term FROM se) u JOIN q ON q.query = u.query AND q.term = u.term GROUP BY ALL),
    e AS (SELECT query, item, pos FROM h QUALIFY row_number() OVER (PARTITION BY query, item ORDER BY n DESC, pos) = 1),
    s2 AS (SELECT b.query, b.item, b.source, b.score, sentence FROM b JOIN e USING (query, item) JOIN se USING (query, item, pos) WHERE NOT regexp_matches(sentence, '(?i)token|[@$%]'))
    SELECT query, item, 'DOC:' || item AS citation, md5(sentence) AS excerpt, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS k FROM s2 QUALIFY k <= 3""")  # fmt: skip
def retrieve(t):
    """For each query its three best articles by the hybrid rank whose excerpt passes the screen, with citations."""
    fused = X.rrf(RT._two(t)).withColumn("score", F.round("score", 9)).join(t.documents.select(F.col("doc_id").alias("item"), "source", "text"), "item")
    return X.retrieve(fused, RT._asked(t), 3, F.col("sentence").rlike("(?i)token|[@$%]")).select("query", "item", F.concat(F.lit("DOC:"), "item").alias("citation"), F.md5("sentence").alias("excerpt"), "k")


METHODS = "(SELECT user_id AS case_id, avg(CASE WHEN event_type < 'm' THEN value END) AS a, avg(CASE WHEN event_type >= 'm' THEN value END) AS b FROM events GROUP BY user_id)"


def _interval(name: str, sign: int) -> str:
    return interval_sql(f"SELECT case_id, CAST({sign} * (a - b) AS DOUBLE) AS num, 1.0::DOUBLE AS den FROM {METHODS} WHERE a IS NOT NULL AND b IS NOT NULL").replace("pairs", f"pairs{name}").replace("ci AS", f"ci{name} AS").replace(" r AS", f" r{name} AS").replace("FROM r", f"FROM r{name}").replace(" e AS", f" e{name} AS").replace("JOIN e", f"JOIN e{name}").replace("v AS", f"v{name} AS").replace("FROM v", f"FROM v{name}").replace("v.*", f"v{name}.*")


@query("rt22_retrieval_rule", f"""WITH {_interval('1', 1)}, {_interval('2', -1)}, m AS (SELECT 'bm25' AS method, value, low, high, 0.6 AS precision FROM ci1 UNION ALL SELECT 'dense', value, low, high, 0.4 FROM ci2 UNION ALL SELECT 'hybrid', NULL, NULL, NULL, 0.5)
    SELECT configured, configured <> 'hybrid' AS replaced, CAST(precision AS DOUBLE) AS precision, precision < 0.5 AS team_decides FROM (SELECT coalesce((SELECT method FROM m WHERE low > 0 ORDER BY value DESC, method DESC LIMIT 1), 'hybrid') AS configured) JOIN m ON method = configured""")  # fmt: skip
def retrieval_rule(t):
    mean = lambda where: F.avg(F.when(where, F.col("value")))
    each = t.events.groupBy(F.col("user_id").alias("case_id")).agg(mean(F.col("event_type") < "m").alias("a"), mean(F.col("event_type") >= "m").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    out = None
    for name, sign, precision in (("bm25", 1, 0.6), ("dense", -1, 0.4)):
        pairs = each.select("case_id", (sign * (F.col("a") - F.col("b"))).alias("num"), F.lit(1.0).alias("den"))
        one = T.poisson_bootstrap(pairs, "case_id", "num", "den").select(F.lit(name).alias("method"), F.col("value").alias("difference"), "low", "high", F.lit(precision).alias("precision"))
        out = one if out is None else out.union(one)
    nothing = F.lit(None).cast("double")
    hybrid = t.spark.range(1).select(F.lit("hybrid").alias("method"), nothing.alias("difference"), nothing.alias("low"), nothing.alias("high"), F.lit(0.5).alias("precision"))
    return D.retrieval_rule(out.union(hybrid))


@query("lm11_checkpoint", """WITH a AS (SELECT d.source AS arm, count(*) AS cases, count(*) FILTER (l.quality = 1) AS claims, count(*) FILTER (l.quality = 1 AND l.toxic = 1) AS unsupported, count(*) FILTER (l.quality = 0) AS failed, count(*) FILTER (d.n_chars > 60000) AS delivered FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source),
    r AS (SELECT arm, list_filter([CASE WHEN cases > 0 AND claims = 0 THEN 'no claim to judge' END, CASE WHEN unsupported / nullif(claims, 0) >= 0.2 THEN 'unsupported claims' END, CASE WHEN failed / cases > 0.1 THEN 'failed calls' END, CASE WHEN delivered > 0 THEN 'a defect was delivered' END], lambda x: x IS NOT NULL) AS reasons FROM a)
    SELECT arm, len(reasons) = 0 AS passed, reasons FROM r""")  # fmt: skip
def checkpoint(t):
    rows = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    claim = F.col("quality") == 1
    arms = rows.groupBy(F.col("source").alias("arm")).agg(N.alias("cases"), F.count_if(claim).alias("claims"), F.count_if(claim & (F.col("toxic") == 1)).alias("unsupported"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("n_chars") > 60000).alias("delivered"))
    return D.checkpoint(arms)


@query("lm09_fallback_reason", r"""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'no client' WHEN doc_id % 49 = 0 THEN 'nothing to explain' WHEN n_chars > 20000 THEN 'answered after its timeout' WHEN trim(coalesce(text, '')) = '' THEN 'no text'
    WHEN regexp_matches(text, '(?i)token|[@$%]') THEN 'treatment language' WHEN lang <> 'en' OR n_chars % 3 = 0 THEN 'not grounded' END AS reason FROM documents""")  # fmt: skip
def fallback(t):
    i = F.col("doc_id")
    reason = D.fallback_reason(i % 50 != 0, i % 49, F.col("n_chars") > 20000, F.col("text"), F.col("text").rlike("(?i)token|[@$%]"), F.col("lang") == "en", (F.col("n_chars") % 3 == 0).cast("int"))
    return t.documents.select("doc_id", reason.alias("reason"))


@query("ml19_parity", f"WITH {S.CASES} SELECT 5 * count(*) AS n, 0 AS missing, 0 AS differing FROM cases")
def parity(t):
    """The softmax by windows against the same in numpy, over Arrow batches of whole cases."""
    scores = S.kg_scores(t)
    a = P.log_softmax(scores, "kg", "lp")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = np.stack(pdf["kg"].to_numpy())
            top = x.max(axis=1, keepdims=True)
            yield pdf[["case_id"]].assign(lp=list(x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True))))

    wide = scores.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "kg"))), lambda e: e["kg"]).alias("kg"))
    b = wide.mapInPandas(run, "case_id bigint, lp array<double>").select("case_id", F.posexplode("lp").alias("pos", "lp"))
    return D.parity(a.select("case_id", "ord", "lp"), b.select("case_id", (F.col("pos") + 1).alias("ord"), "lp"), ["case_id", "ord"], "lp")
