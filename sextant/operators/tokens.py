"""Coded evidence: parsing, positivity, pattern matching and case expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the coding: a token, and the answer that means "not applicable".
TOKEN = r"^(E_\d+)(?:_@_(V_\d+|\d+))?$"
NOT_APPLICABLE = "V_11"


def parse(tokens: DataFrame, raw: str = "raw") -> DataFrame:
    """code, kind (binary, value, ordinal, na), value and ordinal of each token; a malformed token raises."""
    code, answer = F.regexp_extract(raw, TOKEN, 1), F.regexp_extract(raw, TOKEN, 2)
    kind = F.when(code == "", F.raise_error(F.concat(F.lit("malformed token: "), F.col(raw))).cast("string")).when(answer == "", "binary").when(answer == NOT_APPLICABLE, "na").when(answer.startswith("V_"), "value").otherwise("ordinal")
    out = tokens.withColumns({"code": code, "kind": kind})
    return out.withColumns({"value": F.when(F.col("kind").isin("value", "na"), answer), "ordinal": F.when(F.col("kind") == "ordinal", F.try_element_at(F.array(answer.try_cast("int")), F.lit(1)))})


def positive(tokens: DataFrame, specs: DataFrame) -> DataFrame:
    """Parsed tokens with `positive`: binary yes, not applicable no, else any answer but the default.

    A code without a specification raises."""
    joined = tokens.join(specs, "code", "left")
    known = F.when(F.col("data_type").isNull(), F.raise_error(F.concat(F.lit("unknown code: "), F.col("code"))).cast("boolean"))
    answer = F.coalesce("value", F.col("ordinal").cast("string"))
    yes = known.when(F.col("kind") == "binary", True).when(F.col("kind") == "na", False).otherwise(~answer.eqNullSafe(F.col("default_value")))
    return joined.withColumn("positive", yes)


def code_number(code: Column) -> Column:
    return F.substring_index(code, "_", -1).cast("int")


def positive_codes(judged: DataFrame) -> DataFrame:
    """Each case's distinct positive codes in the order of their numbers."""
    codes = F.array_sort(F.collect_set(F.struct(code_number(F.col("code")).alias("n"), F.col("code").alias("c"))))
    return judged.where("positive").groupBy("case_id").agg(F.transform(codes, lambda x: x["c"]).alias("codes"))


def crosswalk_matches(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """(case_id, concept_id) where a pattern holds: any token of the question, one of its answers, or an ordinal from a minimum on.

    The join is on the code, so it is a hash join with a cheap filter after."""
    holds = (F.col("vals").isNull() & F.col("min_ordinal").isNull()) | F.coalesce(F.array_contains("vals", F.col("value")), F.lit(False)) | F.coalesce(F.col("ordinal") >= F.col("min_ordinal"), F.lit(False))
    return tokens.join(patterns, "code").where(holds).select("case_id", "concept_id").distinct()


def side_cover(tokens: DataFrame, patterns: DataFrame, least: int = 2) -> DataFrame:
    """Concepts whose patterns have sides: how many different sides a case covers, from `least` on."""
    hits = tokens.join(patterns.where("side IS NOT NULL"), "code").where(F.array_contains("vals", F.col("value")))
    return hits.groupBy("case_id", "concept_id").agg(F.count_distinct("side").alias("sides")).where(F.col("sides") >= least)


def expand(findings: DataFrame, implies: DataFrame) -> DataFrame:
    """Findings with what they imply: (case_id, concept_id, assertion, origin).

    implies is (concept_id, assertion, implied_id, implied_assertion), closed to
    any depth beforehand. A concept implied both ways is dropped, one that the
    case already has is not added, and of several origins the least stays."""
    derived = findings.join(implies, ["concept_id", "assertion"]).select("case_id", F.col("implied_id").alias("concept_id"), F.col("implied_assertion").alias("assertion"), F.col("concept_id").alias("origin"))
    agreed = derived.groupBy("case_id", "concept_id").agg(F.min("assertion").alias("assertion"), F.min("origin").alias("origin"), F.count_distinct("assertion").alias("n")).where("n = 1").drop("n")
    fresh = agreed.join(findings.select("case_id", "concept_id"), ["case_id", "concept_id"], "left_anti")
    return findings.select("case_id", "concept_id", "assertion", F.lit(None).cast("string").alias("origin")).unionByName(fresh)


def implied_concepts(patterns: DataFrame) -> DataFrame:
    """(code, a, b) where every answer that concept a takes of a code is one that b takes: a implies b.

    patterns is (concept, code, vals); concepts meet on a shared answer, those without answers imply nothing."""
    each = patterns.select("code", F.col("concept").alias("a"), F.size(F.array_distinct("vals")).alias("n"), F.explode(F.array_distinct("vals")).alias("val"))
    other = patterns.select("code", F.col("concept").alias("b"), F.explode(F.array_distinct("vals")).alias("val"))
    both = each.join(other, ["code", "val"]).where("a <> b").groupBy("code", "a", "b").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("shared"))
    return both.where("shared = n").select("code", "a", "b")


def masked(tokens: DataFrame, share: float, seed: str = "mask") -> DataFrame:
    """(case_id, raw, asked): the tokens that a masked copy of each case keeps, and the codes that it was asked.

    A code is asked, with all its tokens, or hidden, by a hash of case and code:
    about so many are asked whatever their answers, so that what isn't asked is
    told apart from what is absent. Cases without an asked code have one row
    without a token."""
    code = F.substring_index("raw", "_@_", 1)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("case_id").cast("string"), code)), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    kept = tokens.withColumns({"code": code, "kept": drawn < share}).groupBy("case_id").agg(F.collect_set(F.when(F.col("kept"), F.col("raw"))).alias("raws"), F.sort_array(F.collect_set(F.when(F.col("kept"), F.col("code")))).alias("asked"))
    return kept.select("case_id", F.explode_outer("raws").alias("raw"), "asked")


def recorded_answers(findings: DataFrame, expanded: DataFrame) -> DataFrame:
    """(case_id, question, answer) of every question that an expansion derived: the finding that it came from, and how that was stated."""
    own = findings.select("case_id", F.col("concept_id").alias("origin"), F.concat("concept_id", F.lit(" is "), "assertion").alias("answer"))
    return expanded.where("origin IS NOT NULL").select("case_id", F.col("concept_id").alias("question"), "origin").join(own, ["case_id", "origin"]).select("case_id", "question", "answer")


def form_problems(present: DataFrame, denied: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, concept_id, problem) of a form's two lists: concepts in both, and concepts that known(concept_id) hasn't."""
    side = lambda rows, positive: rows.select("case_id", "concept_id", F.lit(positive).alias("positive"))
    return stated_problems(side(present, True).union(side(denied, False)), known)


def stated_problems(stated: DataFrame, known: DataFrame) -> DataFrame:
    """The same of one table stated(case_id, concept_id, positive), which is read and grouped once."""
    both = F.col("yes") & F.col("no") & F.col("case_id").isNotNull() & F.col("concept_id").isNotNull()
    each = stated.where("positive IS NOT NULL").groupBy("case_id", "concept_id").agg(F.bool_or("positive").alias("yes"), F.bool_or(~F.col("positive")).alias("no"))
    each = each.join(known.select("concept_id", F.lit(True).alias("_known")).distinct(), "concept_id", "left")
    found = F.array_compact(F.array(F.when(both, F.lit("both present and denied")), F.when(F.col("_known").isNull(), F.lit("unknown concept"))))
    return each.select("case_id", "concept_id", F.explode(found).alias("problem"))
