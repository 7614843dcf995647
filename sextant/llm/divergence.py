"""Divergence of sources within a language by joint count histograms (operator 11).

Two sources are compared over all kept terms of their language, but the value of
a term depends on its two counts only. So each pair's distinct combinations of
counts are tallied, cells with a zero in one or both sources included, and the
value of a combination is worked out once and multiplied by its tally. Cells
with a zero are implied: they follow from each source's own histogram and the
number of kept terms, so no absent term is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import text_or_empty, written

#: What no term holds: ASCII other than letters. Fixed value.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a probability of one counts, and what is added to each count.
UNIT, ADDED = 1_000_000_000, 2


def scaled(count: Column, total: Column, types: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * types)), exact beyond 64 bits."""
    over = (F.lit(UNIT).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (total + ADDED * types).cast("decimal(38,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers up to UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents with it.

    A document's terms are sorted, so that the first of equal ones counts the
    document; terms are counted within each task before they are shuffled."""
    terms = F.sort_array(F.split(F.translate(text_or_empty(text), UPPER, LOWER), BETWEEN))
    rows = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), terms.alias("_t"))
    before = F.concat(F.array(F.lit("")), F.col("_t"))
    each = rows.select("lang", "source", F.explode(F.arrays_zip(F.col("_t").alias("term"), before.alias("before"))).alias("_z"))
    each = each.select("lang", "source", F.col("_z.term").alias("term"), F.col("_z.before").alias("before")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def kept_terms(docs: DataFrame, least: int, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, whole): terms in at least so many documents of their language; whole is the count there."""
    counts = term_counts(docs, lang, source, text)
    every = Window.partitionBy("lang", "term")
    return counts.withColumns({"whole": F.sum("n").over(every), "_d": F.sum("docs").over(every)}).where(F.col("_d") >= least).drop("_d", "docs")


def audit(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of a language.

    Part `pair` has each other source and the sum of the gaps of all kept terms;
    part `term` the top terms that the source has and uses more than its
    language. Equal values rank by item in the order of UTF-8. Null text, lang
    and source count as empty; a group without terms still has its pairs; where
    a language keeps no term they are 0. An empty table gives no rows. Other
    columns of docs are not read."""
    kept = written(kept_terms(docs, least, lang, source, text), "kept-terms")
    types = kept.groupBy("lang").agg(F.count_distinct("term").alias("types"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source")).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(types, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("types", F.lit(0)).alias("types")), "groups")
    out = _pairs(kept, groups).union(_terms(kept, groups, top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _tallies(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m), a before b: in m kept terms a counts x and b counts y; zeros included."""
    one = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x"))
    other = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    both = one.join(other, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")

    def cells(*rows: tuple[Column, Column, Column]) -> Column:
        return F.inline(F.array(*[F.struct(x.alias("x"), y.alias("y"), m.alias("m")) for x, y, m in rows]))

    x, y, m = F.col("x"), F.col("y"), F.col("m")
    # a term of both takes one from the cells that each one's own histogram gave it
    shared = both.select("lang", "a", "b", cells((x, y, m), (x, zero, -m), (zero, y, -m), (zero, zero, m)))
    own = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    others = groups.select("lang", F.col("source").alias("_o"))
    alone = own.join(others, "lang").where("source <> _o")
    first = F.col("source") < F.col("_o")
    alone = alone.select("lang", F.least("source", "_o").alias("a"), F.greatest("source", "_o").alias("b"), cells((F.when(first, F.col("n")).otherwise(zero), F.when(first, zero).otherwise(F.col("n")), m), (zero, zero, -m)))
    none = groups.select("lang", F.col("source").alias("a"), "types").join(others.withColumnRenamed("_o", "b"), "lang").where("a < b")
    none = none.select("lang", "a", "b", zero.alias("x"), zero.alias("y"), F.col("types").alias("m"))
    return shared.union(alone).union(none).groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    of_a = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), "types")
    of_b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("tb"))
    cells = _tallies(kept, groups).join(of_a, ["lang", "a"]).join(of_b, ["lang", "b"])
    value = F.when(F.col("m") > 0, F.col("m") * gap(scaled(F.col("x"), F.col("ta"), F.col("types")), scaled(F.col("y"), F.col("tb"), F.col("types")))).otherwise(0)
    sums = cells.groupBy("lang", "a", "b").agg(F.sum(value).alias("value"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    both = sums.select("lang", F.inline(sides), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    rows = kept.join(groups, ["lang", "source"]).join(whole, "lang")
    rows = rows.select("lang", "source", F.col("term").alias("item"), scaled(F.col("n"), F.col("total"), F.col("types")).alias("p"), scaled(F.col("whole"), F.col("all"), F.col("types")).alias("q"))
    rows = rows.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
