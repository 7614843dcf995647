"""Queries of the evidence graph (KG, JN05-10, AG07-14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import closure as C
from sextant.operators import graph as G
from sextant.operators import questions as Q
from sextant.operators import ranking as R
from sextant.operators import tokens as K
from sextant.plans import standin as S
from sextant.plans.registry import N, query
from sextant.sources import files as I



def with_edges(body: str) -> str:
    return f"WITH {S.PRI}, {S.CASES}, {S.TOK}, {S.EDGES} {body}"


@query("kg01_graph_build", with_edges("SELECT concept_id AS id, CASE WHEN concept_id LIKE 'E_3%' OR concept_id LIKE 'E_4%' THEN 'antecedent' ELSE 'symptom' END AS type, count(DISTINCT condition_id) AS conditions FROM edges GROUP BY concept_id"))
def graph_build(t):
    antecedent = F.col("concept_id").startswith("E_3") | F.col("concept_id").startswith("E_4")
    return S.edges(t).groupBy(F.col("concept_id").alias("id"), F.when(antecedent, "antecedent").otherwise("symptom").alias("type")).agg(F.count_distinct("condition_id").alias("conditions"))


@query("kg03_jn06_graph_merge", """WITH n AS (SELECT 'N' || n_nationkey AS id, 'nation' AS type, 1 AS src FROM nation UNION ALL SELECT 'N' || s_nationkey, 'supplier', 2 FROM supplier UNION ALL SELECT 'R' || r_regionkey, 'region', 1 FROM region)
    SELECT id, min_by(type, src) AS type, count(DISTINCT type) > 1 AS anomaly FROM n GROUP BY id""")  # fmt: skip
def merge(t):
    node = lambda df, p, k, kind, src: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("type"), F.lit(src).alias("src_ord"))
    nodes = node(t.nation, "N", "n_nationkey", "nation", 1).union(node(t.supplier, "N", "s_nationkey", "supplier", 2)).union(node(t.region, "R", "r_regionkey", "region", 1))
    return G.merge_nodes(nodes)


@query("jn06_duplicate_edges", "SELECT l_partkey AS condition_id, l_suppkey AS concept_id, l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(t):
    return G.duplicate_edges(t.lineitem.select(F.col("l_partkey").alias("condition_id"), F.col("l_suppkey").alias("concept_id"), F.col("l_returnflag").alias("source")))


@query("jn07_source_filter", with_edges("SELECT count(*) AS n FROM edges WHERE source IN ('closed')"))
def source_filter(t):
    return S.edges(t).where(F.col("source").isin("closed")).agg(N.alias("n"))


@query("jn09_finding_paths", with_edges("SELECT t.case_id, e.condition_id, t.raw AS concept_id, min(e.source) AS source FROM tok t JOIN edges e ON e.concept_id = t.raw GROUP BY ALL"))
def paths(t):
    e = S.edges(t).groupBy("condition_id", F.col("concept_id").alias("raw")).agg(F.min("source").alias("source"))
    return S.tokens(t).join(e, "raw").select("case_id", "condition_id", F.col("raw").alias("concept_id"), "source")


@query("jn10_assessment", with_edges(""", x AS (SELECT DISTINCT condition_id, concept_id FROM edges)
    SELECT c.case_id, x.condition_id, count(*) FILTER (t.raw IS NOT NULL) AS supporting, count(*) FILTER (t.raw IS NULL) AS missing FROM cases c CROSS JOIN x LEFT JOIN tok t ON t.case_id = c.case_id AND t.raw = x.concept_id GROUP BY ALL"""))  # fmt: skip
def assessment(t):
    x = S.edges(t).select("condition_id", "concept_id").distinct()
    expected = x.groupBy("condition_id").agg(N.alias("expected"))
    met = S.tokens(t).join(x, F.col("raw") == F.col("concept_id")).groupBy("case_id", "condition_id").agg(N.alias("supporting"))
    grid = S.cases(t).select("case_id").crossJoin(F.broadcast(expected)).join(met, ["case_id", "condition_id"], "left").withColumn("supporting", F.coalesce("supporting", F.lit(0)))
    return grid.select("case_id", "condition_id", "supporting", (F.col("expected") - F.col("supporting")).alias("missing"))


@query("ag07_strongest_edge", with_edges("SELECT condition_id, concept_id, max(weight) AS weight FROM edges GROUP BY ALL"))
def strongest(t):
    return G.strongest_edges(S.edges(t))


@query("ag08_edge_fold", with_edges("SELECT condition_id, max(weight) AS weight, list_sort(list(DISTINCT source)) AS sources, count(DISTINCT concept_id) AS concepts FROM edges GROUP BY condition_id"))
def fold(t):
    return S.edges(t).groupBy("condition_id").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("concept_id").alias("concepts"))


@query("ag09_coverage_counts", with_edges("SELECT condition_id, count(*) AS facts, count(*) FILTER (weight <= 0.03) AS weak, count(*) FILTER (concept_id LIKE 'E_1%') AS mapped FROM edges GROUP BY condition_id"))
def coverage(t):
    return S.edges(t).groupBy("condition_id").agg(N.alias("facts"), F.count_if(F.col("weight") <= 0.03).alias("weak"), F.count_if(F.col("concept_id").startswith("E_1")).alias("mapped"))


@query("ag10_kg04_noisy_or", with_edges("SELECT condition_id, split_part(concept_id, '_@_', 1) AS question, round(1 - product(1 - weight), 6) AS p FROM edges GROUP BY ALL"))
def noisy_or(t):
    rows = S.edges(t).withColumn("question", F.substring_index("concept_id", "_@_", 1))
    return G.noisy_or(rows, ["condition_id", "question"]).withColumn("p", F.round("p", 6))


@query("ag11_kg05_imputation", with_edges(""", q AS (SELECT condition_id, split_part(concept_id, '_@_', 1) AS question, avg(weight) AS m, 1 - product(1 - weight) AS cap FROM edges GROUP BY ALL)
    SELECT condition_id, question, round(least(m, cap), 6) AS imputed FROM q"""))  # fmt: skip
def imputation(t):
    rows = S.edges(t).groupBy("condition_id", F.substring_index("concept_id", "_@_", 1).alias("question"))
    return rows.agg(F.round(F.least(F.avg("weight"), 1 - F.product(1 - F.col("weight"))), 6).alias("imputed"))


@query("ag12_kg07_nb_score", S.with_graph("SELECT case_id, ord, condition_id, round(kg, 6) AS kg FROM kg"))
def nb_score(t):
    return S.kg_scores(t).withColumn("kg", F.round("kg", 6))


@query("kg08_contributions", with_edges(f""", {S.STRONGEST} SELECT t.case_id, c.truth AS condition_id, t.raw AS concept_id, CASE WHEN s.weight IS NULL THEN 'none' WHEN s.weight >= 0.65 THEN 'strong' ELSE 'weak' END AS kind,
    round(ln(greatest(least(coalesce(s.weight, 0.01), 0.9), 0.01)), 6) AS part FROM tok t JOIN cases c USING (case_id) LEFT JOIN strongest s ON s.concept_id = t.raw AND s.condition_id = c.truth"""))  # fmt: skip
def contributions(t):
    present = S.tokens(t).join(S.cases(t).select("case_id", F.col("truth").alias("condition_id")), "case_id").withColumnRenamed("raw", "concept_id")
    return G.contributions(present, G.strongest_edges(S.edges(t))).withColumn("part", F.round("part", 6))


@query("ag13_hypothesis_scores", S.with_graph(""", h AS (SELECT DISTINCT raw AS hypothesis FROM tok)
    SELECT h.hypothesis, s.condition_id, round(ln(greatest(least(s.weight, 0.9), 0.01)) - ln(1 - least(s.weight, 0.9)), 6) AS difference FROM h JOIN strongest s ON s.concept_id = h.hypothesis"""))  # fmt: skip
def hypotheses(t):
    p = F.least("weight", F.lit(G.CAP))
    h = S.tokens(t).select("raw").distinct()
    return h.join(G.strongest_edges(S.edges(t)), F.col("raw") == F.col("concept_id")).select(F.col("raw").alias("hypothesis"), "condition_id", F.round(F.log(F.greatest(p, F.lit(G.LEAK))) - F.log(1 - p), 6).alias("difference"))


@query("ag14_graph_card", with_edges(""", d AS (SELECT concept_id, count(DISTINCT condition_id) AS degree FROM edges GROUP BY ALL) SELECT degree, count(*) AS nodes, (SELECT count(*) FROM edges) AS edges FROM d GROUP BY degree"""))
def card(t):
    e = S.edges(t)
    d = e.groupBy("concept_id").agg(F.count_distinct("condition_id").alias("degree")).groupBy("degree").agg(N.alias("nodes"))
    return d.crossJoin(e.agg(N.alias("edges")))


FINDINGS = "f AS (SELECT user_id AS case_id, event_type AS concept_id, CASE WHEN value > 50 THEN 'present' ELSE 'absent' END AS assertion FROM events)"


def _findings(t):
    return t.events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("concept_id"), F.when(F.col("value") > 50, "present").otherwise("absent").alias("assertion"))


@query("kg06_usable_findings", f"WITH {FINDINGS} SELECT case_id, concept_id, min(assertion) AS assertion FROM f GROUP BY ALL HAVING count(DISTINCT assertion) = 1")
def usable(t):
    return G.usable(_findings(t))


@query("kg09_overlap_score", f"WITH {FINDINGS} SELECT case_id, round(greatest(0.0, (count(DISTINCT CASE WHEN assertion = 'present' THEN concept_id END) - 0.5 * count(DISTINCT CASE WHEN assertion = 'absent' THEN concept_id END)) / 5.0), 6) AS score FROM f GROUP BY case_id")
def overlap_score(t):
    n = lambda a: F.count_distinct(F.when(F.col("assertion") == a, F.col("concept_id")))
    return _findings(t).groupBy("case_id").agg(F.round(F.greatest(F.lit(0.0), (n("present") - 0.5 * n("absent")) / 5.0), 6).alias("score"))


@query("kg10_expected_order", with_edges("SELECT condition_id, concept_id, row_number() OVER (PARTITION BY condition_id ORDER BY concept_id LIKE 'E_3%' OR concept_id LIKE 'E_4%', concept_id) AS k FROM (SELECT DISTINCT condition_id, concept_id FROM edges)"))
def expected_order(t):
    late = F.col("concept_id").startswith("E_3") | F.col("concept_id").startswith("E_4")
    return S.edges(t).select("condition_id", "concept_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("condition_id").orderBy(late, "concept_id")))


#: Questions of these codes aren't asked of cases of this kind.
NEVER = ("F", "E_4")
GAIN_SQL = f"""post AS (SELECT case_id, condition_id, exp(kg - max(kg) OVER (PARTITION BY case_id)) AS u FROM kg), pp AS (SELECT case_id, condition_id, u / sum(u) OVER (PARTITION BY case_id) AS p FROM post),
    of AS (SELECT truth AS condition_id, count(*) AS total FROM cases GROUP BY ALL), sh AS (SELECT truth AS condition_id, raw AS concept_id, count(*) / any_value(total) AS weight FROM cases JOIN tok USING (case_id) JOIN of ON of.condition_id = truth GROUP BY ALL),
    cw AS (SELECT c.concept_id, split_part(c.concept_id, '_@_', 1) AS code, p.ord, p.condition_id, greatest(least(coalesce(s.weight, 0.01), 0.9), 0.01)::DOUBLE AS w FROM (SELECT DISTINCT concept_id FROM sh) c CROSS JOIN pri p LEFT JOIN sh s USING (concept_id, condition_id)),
    th AS (SELECT *, 1 / (1 + exp(ln(1 - w) - ln(w))) AS theta FROM cw), splits AS (SELECT concept_id, code FROM th GROUP BY ALL HAVING max(theta) > min(theta)),
    settled AS (SELECT case_id, raw AS concept_id FROM tok UNION SELECT t.case_id, s.concept_id FROM tok t JOIN splits s ON s.code = split_part(t.raw, '_@_', 1) WHERE t.case_id % 2 = 0),
    asked AS (SELECT c.case_id, s.concept_id FROM cases c CROSS JOIN splits s ANTI JOIN settled x ON x.case_id = c.case_id AND x.concept_id = s.concept_id WHERE NOT (c.sex = '{NEVER[0]}' AND s.code = '{NEVER[1]}')),
    q AS (SELECT case_id, concept_id, sum(p * theta) AS q FROM asked JOIN th USING (concept_id) JOIN pp USING (case_id, condition_id) GROUP BY ALL),
    parts AS (SELECT case_id, concept_id, ord, condition_id, theta, q, p * greatest(theta * log2(theta / q) + (1 - theta) * log2((1 - theta) / (1 - q)), 0) AS c FROM q JOIN th USING (concept_id) JOIN pp USING (case_id, condition_id)),
    gains AS (SELECT case_id, concept_id, any_value(q) AS q, round(sum(c), 9) + 0.0 AS gain, sum(c) AS total FROM parts GROUP BY ALL HAVING round(sum(c), 9) > 0)"""


def gains(t, best: bool = False):
    """What every case's open questions gain: over all codes, without what it has answered.

    A condition answers by the share of its own cases that have the concept.
    Every other case counts an answer of a code as settling the code's other questions."""
    own = S.evidence(t).select(F.col("truth").alias("condition_id"), "raws")
    total = own.groupBy("condition_id").agg(N.alias("total"))
    shares = own.select("condition_id", F.explode("raws").alias("concept_id")).groupBy("condition_id", "concept_id").agg(N.alias("n")).join(total, "condition_id")
    questions = Q.answers(shares.select("condition_id", "concept_id", (F.col("n") / F.col("total")).alias("weight")), S.conditions(t)).withColumn("code", F.substring_index("concept_id", "_@_", 1))
    never = F.when(F.col("code") == NEVER[1], F.array(F.lit(NEVER[0]))).otherwise(F.array().cast("array<string>"))
    by_code = questions.groupBy("code").agg(F.collect_list("concept_id").alias("siblings"))
    own = S.tokens(t).withColumn("code", F.substring_index("raw", "_@_", 1)).join(by_code, "code", "left")
    known = F.when(F.col("case_id") % 2 == 0, F.concat(F.array("raw"), F.coalesce("siblings", F.array().cast("array<string>")))).otherwise(F.array("raw"))
    settled = own.select("case_id", known.alias("k")).groupBy("case_id").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("settled"))
    cases = S.cases(t).select("case_id", F.col("sex").alias("kind")).join(Q.posteriors(S.kg_scores(t)), "case_id").join(settled, "case_id", "left")
    return Q.open_gains(cases, questions.withColumn("never", never), best)


@query("kg11_question_gain", S.with_graph(f", {GAIN_SQL} SELECT case_id, concept_id, round(q, 6) AS q, gain FROM gains"))
def question_gain(t):
    return gains(t).select("case_id", "concept_id", F.round("q", 6).alias("q"), "gain")


@query("kg13_separates", S.with_graph(f""", {GAIN_SQL}, best AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY gain DESC, concept_id) = 1),
    n AS (SELECT b.case_id, b.concept_id, p.condition_id, theta > p.q AS yes, row_number() OVER (PARTITION BY b.case_id, theta > p.q ORDER BY round(c, 9) DESC, ord) AS k FROM best b JOIN parts p USING (case_id, concept_id) WHERE c >= 0.01 * total AND theta <> p.q)
    SELECT b.case_id, b.concept_id, coalesce(string_agg(condition_id, ';' ORDER BY k) FILTER (yes AND k <= 3), '') AS if_present, coalesce(string_agg(condition_id, ';' ORDER BY k) FILTER (NOT yes AND k <= 3), '') AS if_denied FROM best b LEFT JOIN n USING (case_id, concept_id) GROUP BY ALL"""))  # fmt: skip
def separates(t):
    """The conditions that carry the best question's gain, by the answer that favours them."""
    rows = Q.named(gains(t, best=True), S.PRIORITIES)
    return rows.select("case_id", "concept_id", *[F.array_join(c, ";").alias(c) for c in ("if_present", "if_denied")])


@query("kg04_closure_fixpoint", """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 UNION ALL SELECT min(p_partkey), min(p_partkey) + 2 FROM part),
    c AS (SELECT a, b FROM e WHERE a IS NOT NULL UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b) SELECT a, b FROM c""")
def closure_fixpoint(t):
    """All ancestors of the parts in a tree by halved keys, with an edge back from its root: a cycle."""
    key = F.col("p_partkey")
    up = t.part.where(key > 1).select(key.alias("a"), F.floor(key / 2).alias("b"))
    back = t.part.agg(F.min(key).alias("a")).select("a", (F.col("a") + 2).alias("b"))
    return C.closure(up.union(back)).select("a", "b")


@query("kg12_entropy_bits", S.with_outcomes("SELECT case_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS bits FROM o GROUP BY case_id"))
def entropy(t):
    return S.ml_scores(t).groupBy("case_id").agg(F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)), 6).alias("bits"))


RULE_SQL = "list_has_all(c, ['E_1_@_V_1', 'E_2']) AND len(list_intersect(c, ['E_3_@_4', 'E_3_@_3', 'E_4_@_V_9'])) >= 2"


@query("kg14_red_flag_rules", f"WITH {S.TOK}, g AS (SELECT case_id, list(raw) AS c FROM tok GROUP BY case_id) SELECT case_id, {RULE_SQL} AS flagged, list_has_any(c, ['E_1_@_V_3']) AND list_has_any(c, ['E_4_@_V_0', 'E_4_@_V_10']) AS grouped FROM g")
def rules(t):
    g = S.tokens(t).groupBy("case_id").agg(F.collect_set("raw").alias("c"))
    lits = lambda *x: F.array(*map(F.lit, x))
    all_of = F.size(F.array_except(lits("E_1_@_V_1", "E_2"), "c")) == 0
    any_of = F.size(F.array_intersect("c", lits("E_3_@_4", "E_3_@_3", "E_4_@_V_9"))) >= 2
    groups = F.array(lits("E_1_@_V_3"), lits("E_4_@_V_0", "E_4_@_V_10"))
    return g.select("case_id", (all_of & any_of).alias("flagged"), (F.size(F.filter(groups, lambda x: F.arrays_overlap(x, F.col("c")))) >= 2).alias("grouped"))


@query("kg20_crosswalk_validation", with_edges(f""", {S.SPECS}, k AS (SELECT concept_id, split_part(concept_id, '_@_', 1) AS code, split_part(concept_id, '_@_', 2) AS val, count(DISTINCT condition_id) AS conditions, count(DISTINCT source) AS sources FROM edges GROUP BY concept_id)
    SELECT concept_id, 'unknown code' AS problem FROM k WHERE code NOT IN (SELECT code FROM specs) UNION ALL SELECT concept_id, 'default value' FROM k JOIN specs USING (code) WHERE val = default_value
    UNION ALL SELECT concept_id, 'one source' FROM k WHERE sources = 1 UNION ALL SELECT concept_id, 'some conditions only' FROM k WHERE conditions < 5"""))  # fmt: skip
def validation(t):
    return G.crosswalk_problems(S.edges(t), S.specs(t), len(S.PRIORITIES))


WIDE = {"m": "round(CASE WHEN o.ord < 5 THEN p ELSE 0 END, 6)", "g": "round(kg, 6)", "f": "CAST(flagged AS INT)", "d": "CAST(in_d AS INT)"}


@query("kg22_wide_matrices", S.with_all(" SELECT o.case_id, " + ", ".join(f"max(CASE WHEN o.ord = {i} THEN {x} END) AS {c}{i}" for c, x in WIDE.items() for i in range(1, 6)) + " FROM o JOIN kg ON kg.case_id = o.case_id AND kg.ord = o.ord GROUP BY o.case_id"))
def wide(t):
    """The model's matrix, padded where it can't score, the graph's, the flags' and the differential's."""
    rows = S.outcomes(t).join(S.kg_scores(t).select("case_id", "ord", "kg"), ["case_id", "ord"])
    rows = rows.select("case_id", "ord", F.round(F.when(F.col("ord") < 5, F.col("p")).otherwise(0.0), 6).alias("m"), F.round("kg", 6).alias("g"), F.col("flagged").cast("int").alias("f"), F.col("in_d").cast("int").alias("d"))
    out = rows.groupBy("case_id").pivot("ord", [1, 2, 3, 4, 5]).agg(*[F.max(c).alias(c) for c in WIDE])
    return out.withColumnsRenamed({f"{i}_{c}": f"{c}{i}" for i in range(1, 6) for c in WIDE})


@query("st15_store_differential", with_edges(f""", e2 AS (SELECT condition_id, concept_id, source, CASE WHEN source = 'closed' THEN weight ELSE weight / 2 END AS weight FROM edges WHERE NOT (source = 'open' AND concept_id = 'E_2')),
    f AS (SELECT t.case_id, e.condition_id, sum(ln(greatest(least(e.w, 0.9), 0.01)) - ln(0.01)) AS score FROM tok t JOIN (SELECT condition_id, concept_id, max(weight) AS w FROM edges GROUP BY ALL) e ON e.concept_id = t.raw GROUP BY ALL),
    g AS (SELECT t.case_id, e.condition_id, sum(ln(greatest(least(e.w, 0.9), 0.01)) - ln(0.01)) AS score FROM tok t JOIN (SELECT condition_id, concept_id, max(weight) AS w FROM e2 GROUP BY ALL) e ON e.concept_id = t.raw GROUP BY ALL)
    SELECT 'scores' AS part, count(*) AS compared, count(*) FILTER (f.score IS NULL OR g.score IS NULL OR abs(f.score - g.score) > 1e-9) AS differing, round(max(abs(f.score - g.score)), 6) AS most FROM f FULL JOIN g USING (case_id, condition_id)
    UNION ALL SELECT 'paths', count(*), count(*) FILTER (a.weight IS NULL OR b.weight IS NULL OR abs(a.weight - b.weight) > 1e-9), round(max(abs(a.weight - b.weight)), 6) FROM edges a FULL JOIN e2 b USING (condition_id, concept_id, source)"""))  # fmt: skip
def differential(t):
    """The graph against a second store of it that lost an edge and halved others, as a load that went wrong."""
    e = S.edges(t)
    other = e.where("NOT (source = 'open' AND concept_id = 'E_2')").withColumn("weight", F.when(F.col("source") == "closed", F.col("weight")).otherwise(F.col("weight") / 2))
    present = S.tokens(t).withColumnRenamed("raw", "concept_id")
    scores = [G.path_scores(present, G.strongest_edges(x)) for x in (e, other)]
    return G.differential(*scores, ["case_id", "condition_id"], "score", "scores").union(G.differential(e, other, ["condition_id", "concept_id", "source"], "weight", "paths"))


@query("st17_graph_fingerprint", with_edges("SELECT sha256(string_agg(r, chr(10) ORDER BY r)) AS fingerprint FROM (SELECT condition_id || '|' || concept_id || '|' || source AS r FROM edges)"))
def fingerprint(t):
    return S.edges(t).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "condition_id", "concept_id", "source"))), "\n"), 256).alias("fingerprint"))


def _digest_sql(part: str, row: str, table: str) -> str:
    d = f"md5({row})"
    return f"SELECT '{part}' AS part, count(*) AS n, coalesce(bit_xor(('0x' || substr({d}, 1, 15))::BIGINT), 0) AS mixed, CAST(coalesce(sum(('0x' || substr({d}, 16, 7))::BIGINT), 0) AS BIGINT) AS total FROM {table}"


@query("st17_content_digests", with_edges(" UNION ALL ".join([_digest_sql("graph", "condition_id || '|' || concept_id || '|' || source", "edges"), _digest_sql("tokens", "case_id || '|' || raw", "tok"), _digest_sql("mask", "case_id || '|' || raw", "(SELECT * FROM tok WHERE ('0x' || substr(md5('mask:' || case_id || ':' || split_part(raw, '_@_', 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5)"), _digest_sql("sample", "case_id::VARCHAR", "(SELECT case_id FROM cases ORDER BY sha256('s:' || case_id), case_id LIMIT 500)")])))
def digests(t):
    """Digests of the graph, of the evidence and its masked copy, and of a sample: equal in any order of the rows."""
    tokens = t.once("tokens", lambda: S.tokens(t))
    mask = K.masked(tokens, 0.5).where("raw IS NOT NULL").select("case_id", "raw")
    sample = R.hash_order(S.cases(t).select("case_id"), "s", "case_id", 500).select("case_id")
    parts = [("graph", S.edges(t).select("condition_id", "concept_id", "source")), ("tokens", tokens.select("case_id", "raw")), ("mask", mask), ("sample", sample)]
    out = None
    for name, rows in parts:
        one = I.content_digest(rows, name)
        out = one if out is None else out.union(one)
    return out
