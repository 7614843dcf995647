"""Queries of histories (JN16-17, WN08, WN15, KG17-21, AG45)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.operators import history as H
from sextant.plans.registry import N, query

DAY = "2024-01-15"
ENTRIES = """e AS (SELECT user_id AS patient, event_type AS kind, props->>'k' AS code, CAST(ts AS DATE) AS start, value, event_id,
    lead(CAST(ts AS DATE)) OVER (PARTITION BY user_id, props->>'k' ORDER BY ts, event_id) AS stop FROM events)"""
MAP = "m AS (SELECT CAST(i AS VARCHAR) AS code, 'concept-' || (i % 7) AS concept_id, CASE WHEN i % 3 = 0 THEN 'absent' ELSE 'present' END AS assertion FROM range(0, 60) r(i))"
ACTIVE = f"{ENTRIES}, {MAP}, a AS (SELECT * FROM e WHERE start <= DATE '{DAY}' AND (stop IS NULL OR DATE '{DAY}' < stop))"


def entries(t):
    code = F.get_json_object("props", "$.k")
    e = t.events.select(F.col("user_id").alias("patient"), F.col("event_type").alias("kind"), code.alias("code"), F.to_date("ts").alias("start"), "ts", "value", "event_id")
    return e.withColumn("stop", F.lead("start").over(Window.partitionBy("patient", "code").orderBy("ts", "event_id"))).drop("ts")


def mapping(t):
    i = F.col("id")
    return t.spark.range(60).select(i.cast("string").alias("code"), F.concat(F.lit("concept-"), (i % 7).cast("string")).alias("concept_id"), F.when(i % 3 == 0, "absent").otherwise("present").alias("assertion"))


def active(t):
    return H.active(entries(t), F.lit(DAY).cast("date"))


@query("jn16_active_on_day", f"WITH {ACTIVE} SELECT event_id, patient, code FROM a")
def active_on_day(t):
    return active(t).select("event_id", "patient", "code")


@query("jn16_as_of_join", """SELECT o.event_id, o.user_id, (SELECT max_by(e.value, e.ts) FROM events e WHERE e.user_id = o.user_id AND e.event_type = 'purchase' AND e.ts <= o.ts) AS value FROM events o WHERE o.event_type = 'click'""")
def as_of(t):
    e = t.events
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("when"), "value")
    return H.as_of(left, right, "user_id", "ts", "when", "value").select("event_id", "user_id", "value")


@query("wn08_latest_observation", f"SELECT patient, code, value FROM (SELECT *, row_number() OVER (PARTITION BY patient, code ORDER BY start DESC, event_id DESC) AS k FROM (SELECT user_id AS patient, props->>'k' AS code, CAST(ts AS DATE) AS start, value, event_id FROM events) WHERE start <= DATE '{DAY}') WHERE k = 1")
def latest(t):
    return H.latest(entries(t), ["patient", "code"], F.lit(DAY).cast("date"), "event_id").select("patient", "code", "value")


ANSWERED = "ma AS (SELECT CAST(i AS VARCHAR) AS code, v.answer, 'finding-' || (i % 5) AS concept_id, v.assertion FROM range(0, 60) r(i), (VALUES ('high', 'present'), ('low', 'absent')) v(answer, assertion) WHERE i % 4 = 1)"


@query("jn17_code_mapping", f"WITH {ACTIVE}, {ANSWERED}, aa AS (SELECT *, CASE WHEN value > 80 THEN 'high' WHEN value < 20 THEN 'low' ELSE 'normal' END AS answer FROM a) SELECT event_id, concept_id, assertion FROM a JOIN m USING (code) UNION ALL SELECT event_id, concept_id, assertion FROM aa JOIN ma USING (code, answer)")
def code_mapping(t):
    """What a code tells, and what a code tells together with its answer."""
    answer = F.when(F.col("value") > 80, "high").when(F.col("value") < 20, "low").otherwise("normal")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("answer"), F.lit(b).alias("assertion")) for a, b in (("high", "present"), ("low", "absent"))])).alias("v")
    i = F.col("id")
    answers = t.spark.range(60).where(i % 4 == 1).select(i.cast("string").alias("code"), F.concat(F.lit("finding-"), (i % 5).cast("string")).alias("concept_id"), each).select("code", "concept_id", "v.*")
    return H.indicated(active(t).withColumn("answer", answer), mapping(t), answers).select("event_id", "concept_id", "assertion")


@query("kg17_patient_graph", f"WITH {ACTIVE} SELECT 'HAS' AS relation, count(*) AS n FROM a UNION ALL SELECT 'INDICATES', count(*) FROM a JOIN m USING (code)")
def patient_graph(t):
    a = active(t)
    has = a.agg(N.alias("n")).select(F.lit("HAS").alias("relation"), "n")
    return has.union(H.indicated(a, mapping(t)).agg(N.alias("n")).select(F.lit("INDICATES"), "n"))


@query("kg18_patient_findings", f"WITH {ACTIVE} SELECT patient, concept_id, max(assertion) AS assertion, array_to_string(list_sort(list(DISTINCT code)), '+') AS codes, min(start) AS since FROM a JOIN m USING (code) GROUP BY ALL")
def findings(t):
    return H.fold_findings(H.indicated(active(t), mapping(t)))


@query("kg19_unmapped_codes", f"WITH {ACTIVE} SELECT code, count(DISTINCT patient) AS patients, CASE WHEN code LIKE '9%' THEN 'administrative' ELSE 'no mapping' END AS reason FROM a WHERE code NOT IN (SELECT code FROM m) GROUP BY code")
def unmapped(t):
    rows = active(t).join(mapping(t), "code", "left_anti")
    reasons = t.rows([("9", "administrative")], "lead string, reason string")
    return rows.groupBy("code").agg(F.count_distinct("patient").alias("patients")).join(reasons, F.substring("code", 1, 1) == F.col("lead"), "left").select("code", "patients", F.coalesce("reason", F.lit("no mapping")).alias("reason"))


@query("ag45_concept_census", f"WITH {ACTIVE} SELECT concept_id, count(DISTINCT patient) FILTER (assertion = 'present') AS present, count(DISTINCT patient) FILTER (assertion = 'absent') AS absent FROM a JOIN m USING (code) GROUP BY concept_id")
def census(t):
    n = lambda x: F.count_distinct(F.when(F.col("assertion") == x, F.col("patient"))).alias(x)
    return H.indicated(active(t), mapping(t)).groupBy("concept_id").agg(n("present"), n("absent"))


@query("kg21_age_alive", "SELECT o_orderkey, year(DATE '2024-06-15') - year(o_orderdate) - CASE WHEN strftime(DATE '2024-06-15', '%m%d') < strftime(o_orderdate, '%m%d') THEN 1 ELSE 0 END AS age, o_orderstatus <> 'F' AS alive FROM orders")
def age(t):
    return t.orders.select("o_orderkey", H.age_on(F.to_date("o_orderdate"), F.lit("2024-06-15").cast("date")).cast("long").alias("age"), (F.col("o_orderstatus") != "F").alias("alive"))


@query("wn15_card_lists", "SELECT user_id, list_slice(list(event_type ORDER BY event_type = 'purchase' DESC, ts, event_id), 1, 3) AS shown, count(*) AS total FROM events GROUP BY user_id")
def cards(t):
    order = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "event_type"))))
    w = Window.partitionBy("user_id").orderBy((F.col("event_type") == "purchase").desc(), "ts", "event_id")
    rows = t.events.withColumn("k", F.row_number().over(w))
    return rows.groupBy("user_id").agg(F.transform(order, lambda x: x["event_type"]).alias("shown"), N.alias("total"))
