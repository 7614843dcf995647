"""Queries of composites: reports, presentation and orchestration built from the other operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import graph as G
from sextant.operators import metrics as M
from sextant.operators import ranking as R
from sextant.operators import text as X
from sextant.operators import tokens as K
from sextant.plans import standin as S
from sextant.plans.registry import N, query
from sextant.plans.graph import GAIN_SQL, gains
from sextant.plans.retrieval import SENT, words_sql
from sextant.plans.tokens import CROSSWALK_SQL, FINDINGS, IMPLIES, JUDGED, crosswalk, expansion, findings, judged


@query("ag44_flag_layer_report", S.with_outcomes("SELECT truth, round(avg(CASE WHEN flagged AND condition_id = truth THEN 1.0 ELSE 0 END) FILTER (condition_id = truth), 6) AS sensitivity, round(count(*) FILTER (flagged AND NOT critical AND condition_id <> truth) / count(DISTINCT case_id), 6) AS burden FROM o GROUP BY truth"))
def flag_layer(t):
    own = M.hit()
    sens = F.round(F.avg(F.when(own, (F.col("flagged")).cast("double"))), 6).alias("sensitivity")
    burden = F.round(F.count_if(F.col("flagged") & ~F.col("critical") & ~own) / F.count_distinct("case_id"), 6).alias("burden")
    return S.outcomes(t).groupBy("truth").agg(sens, burden)


@query("ag51_error_headline", S.with_outcomes("SELECT round(avg(CASE WHEN rank > 1 THEN 1.0 ELSE 0 END), 6) AS top1_error, round(avg(CASE WHEN rank > 3 THEN 1.0 ELSE 0 END), 6) AS top3_error, round(avg(CASE WHEN rank > 3 THEN 1.0 ELSE 0 END) FILTER (critical), 6) AS critical_error FROM o WHERE condition_id = truth"))
def error_headline(t):
    crit = F.col("critical").cast("int")
    return M.of_truth(S.outcomes(t)).agg(M.share(F.col("rank") > 1).alias("top1_error"), M.share(F.col("rank") > 3).alias("top3_error"), M.share((F.col("rank") > 3) & F.col("critical"), crit).alias("critical_error"))


@query("ag52_calibration_report", S.with_outcomes("SELECT condition_id, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(CASE WHEN condition_id = truth THEN 1.0 ELSE 0 END), 6) AS accuracy FROM o GROUP BY ALL"))
def calibration_report(t):
    return M.reliability(S.outcomes(t).withColumn("y", M.hit()), "p", "y", by=("condition_id",))


@query("jn05_canonical_ids", f"WITH {S.TOK} SELECT raw, coalesce(k.canonical, raw) AS id FROM (SELECT DISTINCT raw FROM tok) LEFT JOIN (VALUES ('E_2', 'D:status'), ('E_1_@_V_1', 'D:flag')) k(r, canonical) ON k.r = raw")
def canonical(t):
    k = t.rows([("E_2", "D:status"), ("E_1_@_V_1", "D:flag")], "raw string, canonical string")
    return S.tokens(t).select("raw").distinct().join(k, "raw", "left").select("raw", F.coalesce("canonical", "raw").alias("id"))


@query("jn08_triple_selection", "SELECT n_nationkey, r_name, 'head' AS side FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'C' UNION ALL SELECT s_nationkey, s_name, 'tail' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def triples(t):
    head = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name < 'C'").select("n_nationkey", "r_name", F.lit("head").alias("side"))
    tail = t.supplier.where("s_acctbal > 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", F.col("s_name").alias("r_name"), F.lit("tail").alias("side"))
    return head.union(tail)


@query("jn11_citation_attribution", "SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def attribution(t):
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "c_name")


PAT = "p AS (SELECT p_brand AS concept, p_size % 3 AS code, list(DISTINCT p_type) AS vals FROM part WHERE p_size % 10 < 2 GROUP BY ALL)"


@query("jn19_implication_pairs", f"WITH {PAT} SELECT a.code, a.concept AS a, b.concept AS b FROM p a JOIN p b ON a.code = b.code AND a.concept <> b.concept WHERE list_has_all(b.vals, a.vals)")
def implications(t):
    """A brand is a concept of a code, its types the answers that its pattern takes."""
    p = t.part.where("p_size % 10 < 2").groupBy(F.col("p_brand").alias("concept"), (F.col("p_size") % 3).alias("code")).agg(F.collect_set("p_type").alias("vals"))
    return K.implied_concepts(p)


@query("jn22_recorded_answers", f"""WITH {FINDINGS}, imp AS (SELECT * FROM (VALUES {', '.join(map(repr, IMPLIES))}) v(concept_id, assertion, i, ia)),
    d AS (SELECT case_id, i AS concept_id, min(f.concept_id) AS origin FROM findings f JOIN imp USING (concept_id, assertion) GROUP BY ALL HAVING count(DISTINCT ia) = 1)
    SELECT d.case_id, d.concept_id AS question, f.concept_id || ' is ' || f.assertion AS answer FROM d JOIN findings f ON f.case_id = d.case_id AND f.concept_id = d.origin WHERE NOT EXISTS (SELECT 1 FROM findings x WHERE x.case_id = d.case_id AND x.concept_id = d.concept_id)""")
def recorded(t):
    """The questions that the expansion answered, by the findings that they came from."""
    return K.recorded_answers(findings(t), expansion(t))


@query("prj09_drop_empty_properties", "SELECT c_custkey, list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN NULL ELSE 'bal' END, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'seg' END], lambda x: x IS NOT NULL)) AS kept FROM customer")
def drop_empty(t):
    m = F.create_map(F.lit("bal"), F.when(F.col("c_acctbal") >= 0, F.lit("x")), F.lit("seg"), F.when(F.col("c_mktsegment") != "BUILDING", F.lit("x")))
    return t.customer.select("c_custkey", F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: v.isNotNull()))).alias("kept"))


@query("prj19_case_from_row", f"""WITH {FINDINGS} SELECT case_id, concept_id, CASE WHEN concept_id IN ('E_3', 'E_4') THEN 'risk' ELSE 'finding' END AS list_name, assertion FROM findings WHERE assertion = 'present'
    UNION ALL SELECT case_id, concept_id, 'implied', 'present' FROM ({CROSSWALK_SQL})""")
def case_from_row(t):
    """What a row states, risk factors apart, and the concepts that its tokens imply; what it doesn't state has no row."""
    own = findings(t).where("assertion = 'present'").select("case_id", "concept_id", F.when(F.col("concept_id").isin("E_3", "E_4"), "risk").otherwise("finding").alias("list_name"), "assertion")
    return own.union(crosswalk(t).select("case_id", "concept_id", F.lit("implied"), F.lit("present")))


@query("prj20_case_from_form", f"""WITH {JUDGED}, b AS (SELECT case_id, code, bool_or(positive) AS yes, bool_or(NOT positive) AS no FROM judged GROUP BY ALL)
    SELECT case_id, code AS concept_id, 'both present and denied' AS problem FROM b WHERE yes AND no UNION ALL SELECT case_id, code, 'unknown concept' FROM b WHERE code NOT IN ('E_1', 'E_2', 'E_3')""")
def case_from_form(t):
    """Positive tokens as what a form states, the others as what it denies: concepts in both lists, and unknown ones."""
    rows = judged(t).select("case_id", F.col("code").alias("concept_id"), "positive")
    known = t.rows([("E_1",), ("E_2",), ("E_3",)], "concept_id string")
    return K.stated_problems(rows, known)


@query("kg24_golden_cases", S.with_outcomes("SELECT e.seg, count(*) AS cases, count(*) FILTER (o.rank <= 3) AS met, count(*) FILTER (o.flagged) AS flags FROM o JOIN (VALUES ('BUILDING', '1-URGENT'), ('MACHINERY', '2-HIGH')) e(seg, want) ON e.seg = o.seg AND e.want = o.condition_id WHERE o.truth = e.want GROUP BY e.seg"))
def golden(t):
    want = t.rows([("BUILDING", "1-URGENT"), ("MACHINERY", "2-HIGH")], "seg string, condition_id string")
    rows = M.of_truth(S.outcomes(t)).join(want, ["seg", "condition_id"])
    return rows.groupBy("seg").agg(N.alias("cases"), F.count_if(F.col("rank") <= 3).alias("met"), F.count_if("flagged").alias("flags"))


@query("kg23_presented_candidates", S.with_all(", g AS (SELECT case_id, condition_id, rank() OVER (PARTITION BY case_id ORDER BY kg DESC) AS graph_rank FROM kg) SELECT case_id, condition_id, rank() OVER (PARTITION BY case_id ORDER BY p DESC) AS model_rank, graph_rank FROM o JOIN g USING (case_id, condition_id)"))
def presented(t):
    a = R.competition_rank(S.ml_scores(t), "p").withColumnRenamed("rank", "model_rank")
    b = R.competition_rank(S.kg_scores(t), "kg").withColumnRenamed("rank", "graph_rank")
    return a.join(b, ["case_id", "condition_id"]).select("case_id", "condition_id", "model_rank", "graph_rank")


@query("lm07_safety_check", S.with_outcomes("SELECT case_id, condition_id, row_number() OVER (PARTITION BY case_id ORDER BY flagged DESC, rank) AS shown, CASE WHEN flagged THEN 'Attention: ' || condition_id END AS notice FROM o WHERE NOT (condition_id = '5-LOW' AND NOT flagged)"))
def safety(t):
    o = S.outcomes(t).where("NOT (condition_id = '5-LOW' AND NOT flagged)")
    shown = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("flagged"), "rank"))
    return o.select("case_id", "condition_id", shown.alias("shown"), F.when(F.col("flagged"), F.concat(F.lit("Attention: "), "condition_id")).alias("notice"))


@query("ml18_token_mask", f"WITH {S.TOK}, m AS (SELECT *, raw LIKE 'E_1%' AS first, row_number() OVER (PARTITION BY case_id, raw LIKE 'E_1%' ORDER BY sha256('m:' || case_id || ':' || raw)) AS k FROM tok) SELECT case_id, raw FROM m WHERE first OR k <= 2")
def token_mask(t):
    first = F.col("raw").startswith("E_1")
    order = F.sha2(F.concat_ws(":", F.lit("m"), F.col("case_id").cast("string"), "raw"), 256)
    m = S.tokens(t).withColumn("first", first).withColumn("k", F.row_number().over(Window.partitionBy("case_id", "first").orderBy(order)))
    return m.where("first OR k <= 2").select("case_id", "raw")


@query("wn12_next_questions", S.with_graph(f", {GAIN_SQL} SELECT case_id, concept_id, row_number() OVER (PARTITION BY case_id ORDER BY gain DESC, concept_id) AS k FROM gains QUALIFY k <= 2"))
def next_questions(t):
    """The two open questions of most gain."""
    k = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gain"), "concept_id"))
    return gains(t).select("case_id", "concept_id", k.alias("k")).where("k <= 2")


@query("wn13_contribution_sort", S.with_graph(", x AS (SELECT condition_id, concept_id, ln(greatest(least(weight, 0.9), 0.01)) AS part FROM strongest) SELECT condition_id, concept_id, row_number() OVER (PARTITION BY condition_id ORDER BY abs(part) DESC, concept_id) AS k FROM x"))
def contribution_sort(t):
    e = G.strongest_edges(S.edges(t)).withColumn("part", F.log(F.greatest(F.least("weight", F.lit(0.9)), F.lit(0.01))))
    return e.select("condition_id", "concept_id", F.row_number().over(Window.partitionBy("condition_id").orderBy(F.abs("part").desc(), "concept_id")).alias("k"))


@query("rt04_excerpt", rf"""WITH q AS (SELECT DISTINCT unnest({words_sql('text')}) AS term FROM benchmark), d AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence FROM d), w AS (SELECT doc_id, pos, unnest(list_distinct({words_sql('sentence')})) AS term FROM s),
    h AS (SELECT doc_id, pos, count(*) AS n FROM w JOIN q USING (term) GROUP BY ALL), b AS (SELECT doc_id, pos FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1)
    SELECT doc_id, pos, sentence FROM s JOIN b USING (doc_id, pos)""")  # fmt: skip
def excerpt(t):
    """Each text's sentence with the most benchmark words; the first of equals."""
    words = t.benchmark.select(F.explode(X.words(F.col("text"))).alias("term")).distinct()
    s = t.documents.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    hits = s.select("doc_id", "pos", F.explode(F.array_distinct(X.words(F.col("sentence")))).alias("term")).join(words, "term").groupBy("doc_id", "pos").agg(N.alias("n"))
    best = hits.groupBy("doc_id").agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("pos"))
    return s.join(best, ["doc_id", "pos"]).select("doc_id", "pos", "sentence")


@query("rt18_article_passages", rf"""WITH {SENT}, d AS (SELECT *, regexp_matches(sentence, '[0-9@%$]') AS dirty FROM s), g AS (SELECT *, sum(CASE WHEN dirty THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM d),
    r AS (SELECT doc || '-' || CAST(run AS BIGINT) AS doc, string_agg(sentence, ' ' ORDER BY pos) AS text FROM g WHERE NOT dirty GROUP BY g.doc, run HAVING length(string_agg(sentence, ' ' ORDER BY pos)) >= 150),
    w AS (SELECT doc, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM r), c AS (SELECT doc, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 100) / 80) AS BIGINT)))) AS chunk FROM w WHERE len(w) > 0)
    SELECT doc, chunk, array_to_string(w[chunk * 80 + 1 : chunk * 80 + 100], ' ') AS text FROM c""")  # fmt: skip
def passages(t):
    """Clean runs of sentences, then overlapping windows of each."""
    s = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", r"\. ")).alias("pos", "sentence"))
    runs = X.clean_runs(s, F.col("sentence").rlike("[0-9@%$]"), 150)
    return X.windows(runs.select(F.concat_ws("-", F.col("doc").cast("string"), F.col("run").cast("string")).alias("doc"), "text"), 100, 20)


_DRAWN = "(('0x' || substr(md5(doc_id || ':' || i), 1, 8))::BIGINT)"


@query("orc01_synthetic_corpus", f"SELECT doc_id AS id, (SELECT string_agg('w' || CAST({_DRAWN} % 500 AS VARCHAR), ' ' ORDER BY i) FROM range(1, 1 + least(n_chars, 40)) r(i)) AS text, [round({_DRAWN} / 4294967296.0::DOUBLE, 6) FOR i IN [101, 102, 103, 104]] AS vector FROM documents")
def corpus(t):
    """For every document a passage of as many drawn words, forty at most, and a drawn vector; the same on any partitioning."""
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")
    word = F.transform(F.sequence(F.lit(1), F.least("n_chars", F.lit(40)).cast("int")), lambda i: F.concat(F.lit("w"), (drawn(i) % 500).cast("string")))
    vector = F.transform(F.array(*[F.lit(i) for i in range(101, 105)]), lambda i: F.round(drawn(i) / 4294967296.0, 6))
    return t.documents.select(F.col("doc_id").alias("id"), F.array_join(word, " ").alias("text"), vector.alias("vector"))


@query("st16_paired_deep_counts", S.with_outcomes(", f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY flagged DESC, p DESC, ord) AS r2 FROM o) SELECT critical, count(*) FILTER (rank <= 3 AND r2 > 3) AS only_a, count(*) FILTER (rank > 3 AND r2 <= 3) AS only_b FROM f WHERE condition_id = truth GROUP BY critical"))
def paired_deep(t):
    h = M.of_truth(R.rank_scores(S.outcomes(t), "p", first=F.col("flagged"), name="r2"))
    return h.groupBy("critical").agg(F.count_if((F.col("rank") <= 3) & (F.col("r2") > 3)).alias("only_a"), F.count_if((F.col("rank") > 3) & (F.col("r2") <= 3)).alias("only_b"))
