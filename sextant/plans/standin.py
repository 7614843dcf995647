"""Cases, evidence, scores and outcomes laid over the star-schema tables, and the same as SQL.

An order is a case, its priority the true condition, its line items the
evidence. The SQL pieces build the same tables for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators import graph as G
from sextant.operators import ranking as R

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def conditions(t) -> DataFrame:
    rows = [(i + 1, p, i < 2) for i, p in enumerate(PRIORITIES)]
    return t.rows(rows, "ord int, condition_id string, critical boolean")


PRI = "pri AS (SELECT * FROM (VALUES (1, '1-URGENT', true), (2, '2-HIGH', true), (3, '3-MEDIUM', false), (4, '4-NOT SPECIFIED', false), (5, '5-LOW', false)) v(ord, condition_id, critical))"


CASE = ["case_id", "custkey", "truth", "sex", "seg", "bal"]


def cases(t) -> DataFrame:
    if "evidence" in t.made:
        return t.made["evidence"].select(CASE)
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("truth"), F.col("o_orderstatus").alias("sex"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))


CASES = "cases AS (SELECT o_orderkey AS case_id, o_custkey AS custkey, o_orderpriority AS truth, o_orderstatus AS sex, c_mktsegment AS seg, c_acctbal AS bal FROM orders JOIN customer ON o_custkey = c_custkey)"


def line_tokens() -> list:
    """The raw evidence tokens of a line item, null where it has none of a kind."""
    return [
        F.concat(F.lit("E_1_@_V_"), F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3")),
        F.when(F.col("l_linestatus") == "O", F.lit("E_2")),
        F.concat(F.lit("E_3_@_"), F.floor(F.col("l_quantity") / 10).cast("int").cast("string")),
        F.concat(F.lit("E_4_@_V_"), F.round(F.col("l_discount") * 100).cast("int").cast("string")),
    ]


def token_sets(t) -> DataFrame:
    """(case_id, raws): the distinct raw evidence tokens of each case that has line items.

    One row of a case is shuffled from each task, not one of each token. Each
    kind of token has a set of its own, so that a line item stays one row."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.concat(*map(F.collect_set, line_tokens())).alias("raws"))


def evidence(t) -> DataFrame:
    """One row of each case with its tokens: what edges and scores both read, made once in a query."""
    return t.once("evidence", lambda: cases(t).join(token_sets(t), "case_id", "left"))


def tokens(t) -> DataFrame:
    """(case_id, raw) of each distinct token of a case; cases without line items have none."""
    sets = t.made["evidence"] if "evidence" in t.made else token_sets(t)
    return sets.select("case_id", F.explode("raws").alias("raw"))


TOK = """tok AS (SELECT DISTINCT case_id, raw FROM (SELECT l_orderkey AS case_id, unnest([
    'E_1_@_V_' || CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END,
    CASE WHEN l_linestatus = 'O' THEN 'E_2' END,
    'E_3_@_' || CAST(floor(l_quantity / 10) AS INT),
    'E_4_@_V_' || CAST(round(l_discount * 100) AS INT)]) AS raw FROM lineitem) WHERE raw IS NOT NULL)"""


def specs(t) -> DataFrame:
    rows = [("E_1", "M", "V_2", False), ("E_2", "B", None, False), ("E_3", "C", "0", True), ("E_4", "M", "V_0", True)]
    return t.rows(rows, "code string, data_type string, default_value string, is_antecedent boolean")


SPECS = "specs AS (SELECT * FROM (VALUES ('E_1', 'M', 'V_2', false), ('E_2', 'B', NULL, false), ('E_3', 'C', '0', true), ('E_4', 'M', 'V_0', true)) v(code, data_type, default_value, is_antecedent))"

BANDS = [(0.8, 0.9), (0.5, 0.65), (0.2, 0.35), (0.05, 0.12), (0.0, 0.03)]
_BAND_SQL = "CASE " + " ".join(f"WHEN share >= {a} THEN {w}" for a, w in BANDS) + " END"


def edges(t) -> DataFrame:
    """Condition to token edges, one for each source (order status F, or other) that has the pair."""
    c = evidence(t).select(F.col("truth").alias("condition_id"), F.when(F.col("sex") == "F", "closed").otherwise("open").alias("source"), "raws")
    total = c.groupBy("condition_id", "source").agg(F.count(F.lit(1)).alias("total"))
    pair = c.select("condition_id", "source", F.explode("raws").alias("concept_id")).groupBy("condition_id", "source", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    share = pair.join(total, ["condition_id", "source"]).withColumn("share", F.col("n") / F.col("total"))
    return t.once("edges", lambda: share.select("condition_id", "concept_id", "source", G.band(F.col("share"), BANDS).alias("weight")))


EDGES = f"""edges AS (SELECT condition_id, concept_id, source, {_BAND_SQL} AS weight FROM (
    SELECT p.condition_id, p.concept_id, p.source, p.n / q.total AS share
    FROM (SELECT truth AS condition_id, CASE WHEN sex = 'F' THEN 'closed' ELSE 'open' END AS source, raw AS concept_id, count(*) AS n FROM cases JOIN tok USING (case_id) GROUP BY ALL) p
    JOIN (SELECT truth AS condition_id, CASE WHEN sex = 'F' THEN 'closed' ELSE 'open' END AS source, count(*) AS total FROM cases GROUP BY ALL) q USING (condition_id, source)))"""

STRONGEST = "strongest AS (SELECT condition_id, concept_id, max(weight) AS weight FROM edges GROUP BY ALL)"


def kg_scores(t) -> DataFrame:
    """(case_id, ord, condition_id, kg): naive-Bayes log-likelihood of every case's tokens."""
    e = edges(t)
    return G.naive_bayes(cases(t).select("case_id"), tokens(t).withColumnRenamed("raw", "concept_id"), G.strongest_edges(e), conditions(t))


KG = """kg AS (SELECT c.case_id, p.ord, p.condition_id, round(coalesce(sum(CASE WHEN t.raw IS NOT NULL THEN ln(greatest(least(coalesce(s.weight, 0.01), 0.9), 0.01)) END), 0), 9) AS kg
    FROM cases c CROSS JOIN pri p LEFT JOIN tok t USING (case_id) LEFT JOIN strongest s ON s.condition_id = p.condition_id AND s.concept_id = t.raw GROUP BY ALL)"""


def ml_scores(t) -> DataFrame:
    """(case_id, ord, condition_id, critical, p): shares of priorities among the customer's orders."""
    c = cases(t)
    n = c.groupBy("custkey", F.col("truth").alias("condition_id")).agg(F.count(F.lit(1)).alias("n"))
    groups = c.select("custkey").distinct().crossJoin(F.broadcast(conditions(t))).join(n, ["custkey", "condition_id"], "left")
    groups = groups.withColumn("n", F.coalesce("n", F.lit(0)))
    share = groups.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("custkey"))).drop("n")
    return c.select("case_id", "custkey").join(share, "custkey").select("case_id", "ord", "condition_id", "critical", "p")


ML = """freq AS (SELECT custkey, truth AS condition_id, count(*) AS n FROM cases GROUP BY ALL),
    ml AS (SELECT case_id, ord, condition_id, critical, n / sum(n) OVER (PARTITION BY case_id) AS p FROM (
    SELECT c.case_id, p.ord, p.condition_id, p.critical, coalesce(f.n, 0) AS n FROM cases c CROSS JOIN pri p
    LEFT JOIN freq f ON f.custkey = c.custkey AND f.condition_id = p.condition_id))"""


def outcomes(t) -> DataFrame:
    """One row for each case and condition: rank by model score, truth, flag, membership of the differential."""
    c = cases(t)
    ranked = R.rank_scores(ml_scores(t), "p").join(c.select("case_id", "custkey", "truth", "sex", "seg", "bal"), "case_id")
    flagged = ((F.col("ord") == 1) & (F.col("seg") == "BUILDING")) | ((F.col("ord") == 2) & (F.col("sex") == "F"))
    among = c.select("custkey", F.col("truth").alias("condition_id"), F.lit(True).alias("in_d")).distinct()
    return ranked.withColumn("flagged", flagged).join(among, ["custkey", "condition_id"], "left").withColumn("in_d", F.coalesce("in_d", F.lit(False)))


OUT = """among AS (SELECT DISTINCT custkey, truth AS condition_id FROM cases),
    o AS (SELECT m.case_id, m.ord, m.condition_id, m.critical, m.p, c.truth, c.sex, c.seg, c.bal, c.custkey,
    row_number() OVER (PARTITION BY m.case_id ORDER BY m.p DESC, m.ord) AS rank,
    (m.ord = 1 AND c.seg = 'BUILDING') OR (m.ord = 2 AND c.sex = 'F') AS flagged, a.custkey IS NOT NULL AS in_d
    FROM ml m JOIN cases c USING (case_id) LEFT JOIN among a ON a.custkey = c.custkey AND a.condition_id = m.condition_id)"""


def with_outcomes(body: str) -> str:
    return f"WITH {PRI}, {CASES}, {ML}, {OUT} {body}"


def with_graph(body: str) -> str:
    return f"WITH {PRI}, {CASES}, {TOK}, {EDGES}, {STRONGEST}, {KG} {body}"


def with_all(body: str) -> str:
    return f"WITH {PRI}, {CASES}, {TOK}, {EDGES}, {STRONGEST}, {KG}, {ML}, {OUT} {body}"
