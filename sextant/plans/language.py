"""Queries of generated text, its checks and screens (LM, PRJ12-13, AG38-39)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import text as X
from sextant.plans import standin as S
from sextant.plans.registry import N, query
from sextant.plans.retrieval import words_sql



@query("prj12_treatment_predicate", "SELECT doc_id, regexp_matches(text, '(?i)licensed under|released under|token = ') AS found FROM documents")
def predicate(t):
    return t.documents.select("doc_id", F.col("text").rlike("(?i)licensed under|released under|token = ").alias("found"))


@query("prj13_label_masked_predicate", "SELECT doc_id, regexp_matches(replace(replace(text, 'General Public License', ' '), 'MIT License', ' '), '(?i)license') AS found FROM documents")
def masked(t):
    labels = F.array_sort(F.array(F.lit("MIT License"), F.lit("General Public License")), lambda a, b: F.length(b) - F.length(a))
    rest = F.aggregate(labels, F.col("text"), lambda x, label: F.replace(x, label, F.lit(" ")))
    return t.documents.select("doc_id", rest.rlike("(?i)license").alias("found"))


@query("lm01_sample", "SELECT conv_id, sha256('lm:' || conv_id) AS digest FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY digest, conv_id LIMIT 50")
def sample(t):
    from sextant.operators import ranking as R

    return R.hash_order(t.conversations.select("conv_id").distinct(), "lm", "conv_id", 50)


@query("lm02_case_prompt", f"WITH {S.CASES}, {S.TOK} SELECT c.case_id, 'Segment: ' || seg || chr(10) || 'Findings: ' || coalesce(string_agg(raw, ', ' ORDER BY raw), 'none') AS prompt FROM cases c LEFT JOIN tok USING (case_id) GROUP BY c.case_id, seg")
def prompt(t):
    found = S.tokens(t).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("raw")), ", ").alias("f"))
    return S.cases(t).join(found, "case_id", "left").select("case_id", F.concat(F.lit("Segment: "), "seg", F.lit("\nFindings: "), F.coalesce("f", F.lit("none"))).alias("prompt"))


ANSWERS = "a AS (SELECT o_custkey AS case_id, 'RANKING:' || chr(10) || string_agg(k || CASE WHEN k % 2 = 0 THEN ') ' ELSE '. ' END || CASE WHEN k % 3 = 0 THEN '**' || o_orderpriority || '**' ELSE o_orderpriority END, chr(10) ORDER BY k) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY o_custkey)"


def answers(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col("k").cast("string")
    line = F.concat(k, F.when(F.col("k") % 2 == 0, ") ").otherwise(". "), F.when(F.col("k") % 3 == 0, F.concat(F.lit("**"), "o_orderpriority", F.lit("**"))).otherwise(F.col("o_orderpriority")))
    rows = t.orders.withColumn("k", F.row_number().over(w)).withColumn("line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    return rows.groupBy(F.col("o_custkey").alias("case_id")).agg(F.concat(F.lit("RANKING:\n"), F.array_join(lines, "\n")).alias("text"))


@query("lm03_answer_parser", rf"""WITH {S.PRI}, {ANSWERS}, l AS (SELECT case_id, unnest(string_split(text, chr(10))) AS line FROM a),
    n AS (SELECT case_id, CAST(regexp_extract(line, '^\s*([0-9]+)[.):]', 1) AS INT) AS k, regexp_replace(regexp_replace(line, '^\s*[0-9]+[.):]\s*', ''), '[*]', '', 'g') AS label FROM l WHERE regexp_matches(line, '^\s*[0-9]+[.):]')),
    f AS (SELECT case_id, label, min(k) AS k FROM n JOIN pri ON condition_id = label GROUP BY ALL)
    SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY k) AS rank FROM f""")  # fmt: skip
def parser(t):
    item = r"^\s*([0-9]+)[.):]\s*(.*)$"
    lines = answers(t).select("case_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*[0-9]+[.):]"))
    n = lines.select("case_id", F.regexp_extract("line", item, 1).cast("int").alias("k"), F.regexp_replace(F.regexp_extract("line", item, 2), r"[*]", "").alias("label"))
    known = S.conditions(t).select(F.col("condition_id").alias("label"))
    first = n.join(known, "label").groupBy("case_id", "label").agg(F.min("k").alias("k"))
    return first.select("case_id", "label", F.row_number().over(Window.partitionBy("case_id").orderBy("k")).alias("rank"))


CLAIMS = f"""c AS (SELECT conv_id, turn, role, list_distinct({words_sql('text')}) AS w FROM conversations),
    cl AS (SELECT conv_id, turn, unnest(w) AS word FROM c WHERE role = 'assistant'), sr AS (SELECT DISTINCT conv_id, turn AS source, unnest(w) AS word FROM c WHERE role <> 'assistant'),
    cn AS (SELECT conv_id, turn, count(DISTINCT word) AS n FROM cl GROUP BY ALL),
    mt AS (SELECT cl.conv_id, cl.turn, source, count(DISTINCT cl.word) AS met FROM cl JOIN sr ON sr.conv_id = cl.conv_id AND sr.word = cl.word AND sr.source < cl.turn GROUP BY ALL),
    tr AS (SELECT cn.conv_id, cn.turn, cn.n, coalesce(max(met), 0) AS best FROM cn LEFT JOIN mt ON mt.conv_id = cn.conv_id AND mt.turn = cn.turn GROUP BY ALL)"""  # fmt: skip


def traced(t):
    """Each assistant turn's distinct words, and the most of them that one earlier turn holds: relational division."""
    w = t.conversations.select("conv_id", "turn", "role", F.explode(F.array_distinct(X.words(F.col("text")))).alias("word")).distinct()
    claims = w.where("role = 'assistant'").select("conv_id", "turn", "word").distinct()
    sources = w.where("role <> 'assistant'").select("conv_id", F.col("turn").alias("source"), "word").distinct()
    met = claims.join(sources, ["conv_id", "word"]).where("source < turn").groupBy("conv_id", "turn", "source").agg(N.alias("met")).groupBy("conv_id", "turn").agg(F.max("met").alias("best"))
    return claims.groupBy("conv_id", "turn").agg(N.alias("n")).join(met, ["conv_id", "turn"], "left").select("conv_id", "turn", "n", F.coalesce("best", F.lit(0)).alias("best"))


@query("lm04_sentence_tracing", f"WITH {CLAIMS} SELECT conv_id, turn, n, best, best = n AS traced FROM tr")
def tracing(t):
    return traced(t).withColumn("traced", F.col("best") == F.col("n"))


@query("lm06_ag38_claim_stats", f"WITH {CLAIMS} SELECT count(*) AS claims, count(*) FILTER (best < n) AS unsupported, round(avg(CASE WHEN best < n THEN 1.0 ELSE 0 END), 6) AS rate FROM tr")
def claim_stats(t):
    return traced(t).agg(N.alias("claims"), F.count_if(F.col("best") < F.col("n")).alias("unsupported"), F.round(F.avg((F.col("best") < F.col("n")).cast("double")), 6).alias("rate"))


@query("lm05_explanation_check", "SELECT o_custkey, list_sort(list_intersect(c, ['1-URGENT', '2-HIGH', '9-OTHER'])) AS kept, list_sort(list_filter(['1-URGENT', '2-HIGH', '9-OTHER'], lambda x: NOT list_contains(c, x))) AS invented FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS c FROM orders GROUP BY o_custkey)")
def explanation_check(t):
    cited = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("9-OTHER"))
    g = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("c"))
    return g.select("o_custkey", F.array_sort(F.array_intersect(cited, "c")).alias("kept"), F.array_sort(F.array_except(cited, "c")).alias("invented"))


@query("lm08_template_explanation", S.with_outcomes("SELECT case_id, 'Top: ' || max(CASE WHEN rank = 1 THEN condition_id END) || '; flags: ' || coalesce(string_agg(CASE WHEN flagged THEN condition_id END, ', ' ORDER BY ord), 'none') AS text FROM o GROUP BY case_id"))
def template(t):
    flags = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("flagged"), F.struct("ord", "condition_id")))), lambda x: x["condition_id"]), ", ")
    g = S.outcomes(t).groupBy("case_id").agg(F.max(F.when(F.col("rank") == 1, F.col("condition_id"))).alias("top"), flags.alias("flags"))
    return g.select("case_id", F.concat(F.lit("Top: "), "top", F.lit("; flags: "), F.when(F.col("flags") == "", "none").otherwise(F.col("flags"))).alias("text"))


@query("lm10_rating_sheet", "SELECT doc_id, substr(sha256('sheet:' || doc_id), 1, 12) AS hidden, '' AS grade FROM labels")
def sheet(t):
    return t.labels.select("doc_id", F.substring(F.sha2(F.concat(F.lit("sheet:"), F.col("doc_id").cast("string")), 256), 1, 12).alias("hidden"), F.lit("").alias("grade"))


@query("lm13_work_grid_resume", "SELECT arm, doc_id FROM labels CROSS JOIN (VALUES ('a'), ('b')) v(arm) WHERE NOT (arm = 'a' AND quality = 1)")
def work_grid(t):
    arms = t.rows([("a",), ("b",)], "arm string")
    done = t.labels.where("quality = 1").select(F.lit("a").alias("arm"), "doc_id")
    return t.labels.select("doc_id").crossJoin(F.broadcast(arms)).join(done, ["arm", "doc_id"], "left_anti").select("arm", "doc_id")


@query("lm14_reference_case", S.with_outcomes("SELECT case_id, count(*) AS candidates, max(seg) || '/' || max(sex) AS demographics FROM o GROUP BY case_id"))
def reference_case(t):
    return S.outcomes(t).groupBy("case_id").agg(N.alias("candidates"), F.concat(F.max("seg"), F.lit("/"), F.max("sex")).alias("demographics"))


@query("ag39_answer_blocks", f"WITH {ANSWERS} SELECT count(*) AS answers, count(*) FILTER (contains(text, '**')) AS bold, round(avg(length(text)), 6) AS mean_length FROM a")
def blocks(t):
    return answers(t).agg(N.alias("answers"), F.count_if(F.contains("text", F.lit("**"))).alias("bold"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query("ag54_label_coverage", "SELECT round(avg(CASE WHEN list_has_any(string_split(lower(p_type), ' '), ['small', 'promo']) THEN 1.0 ELSE 0 END), 6) AS generous, round(avg(CASE WHEN lower(p_type) = 'small' THEN 1.0 ELSE 0 END), 6) AS strict FROM part")
def coverage(t):
    w = F.split(F.lower("p_type"), " ")
    return t.part.agg(F.round(F.avg(F.arrays_overlap(w, F.array(F.lit("small"), F.lit("promo"))).cast("double")), 6).alias("generous"), F.round(F.avg((F.lower("p_type") == "small").cast("double")), 6).alias("strict"))
