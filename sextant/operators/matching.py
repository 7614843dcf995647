"""Pairs of labels by the ratio of their matching blocks, without comparing all pairs; pairs of sets."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.shared import kept

#: Sets that a block of set_pairs() holds, and bits of a word of a set.
BLOCK, BITS = 1000, 63


def ratio(a: str, b: str) -> float:
    """Twice the signs in matching blocks, the longest first and then left and right of it, over all signs."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _counted(items: Column) -> Column:
    """Each item with the number of its equals before it, so that bags become sets."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("\0"), F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == x)).cast("string")))


def similar_labels(labels: DataFrame, least: float = 0.72, label: str = "label") -> DataFrame:
    """(a, b, ratio) of the distinct labels a < b whose ratio reaches least.

    Blocks that match hold M signs of la + lb, and the ratio is 2 M / (la + lb).
    So the shorter has at least least / (2 - least) of the longer's length, and the
    labels share at least that part of the signs of either: one of the rarest
    la - ceil(that) + 1 signs of a (equal signs numbered) is among those of b.
    Labels meet on these only. The blocks are at most la + lb - 2 M + 1, which
    bounds the pairs of neighbouring signs that both have from below. What
    passes is compared. Null labels match nothing; an empty one has no signs."""
    part = least / (2 - least)
    words = labels.select(F.col(label).alias("label")).where("label IS NOT NULL AND label <> ''").distinct()
    signs = F.filter(F.split("label", ""), lambda x: x != "")
    rows = words.select("label", signs.alias("s")).select("label", F.size("s").alias("n"), _counted(F.col("s")).alias("signs"), _counted(F.when(F.size("s") > 1, F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.concat(F.element_at("s", i), F.element_at("s", i + 1)))).otherwise(F.array().cast("array<string>"))).alias("pairs"))
    each = rows.select("label", F.explode("signs").alias("sign"))
    often = each.groupBy("sign").agg(F.count(F.lit(1)).alias("df"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("df", "sign"))), lambda x: x["sign"])
    ordered = each.join(often, "sign").groupBy("label").agg(order.alias("o"))
    head = ordered.join(rows.select("label", "n"), "label")
    head = head.select("label", "n", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(part * F.col("n") - 1e-9) + 1).cast("int"))).alias("sign"))
    a, b = (head.select(F.col("label").alias(c), F.col("n").alias(f"n{c}"), "sign") for c in "ab")
    met = a.join(b, "sign").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= part * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    ra, rb = (rows.select(F.col("label").alias(c), F.col("n").alias(f"n{c}"), F.col("signs").alias(f"s{c}"), F.col("pairs").alias(f"p{c}")) for c in "ab")
    both, total = met.join(ra, "a").join(rb, "b"), F.col("na") + F.col("nb")
    able = both.where((F.size(F.array_intersect("sa", "sb")) >= least / 2 * total - 1e-9) & (F.size(F.array_intersect("pa", "pb")) >= (1.5 * least - 1) * total - 1 - 1e-9)).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([ratio(*p) for p in zip(*(c.to_pylist() for c in x.columns), strict=True)], pa.float64())], ["a", "b", "ratio"])

    return able.mapInArrow(run, "a string, b string, ratio double").where(F.col("ratio") >= least)


def set_pairs(sets: DataFrame, id_col: str = "k", set_col: str = "v") -> DataFrame:
    """(a, b, a_in_b, b_in_a, jaccard) of all pairs a < b of sets, which are arrays without repeats.

    A set becomes words of bits over the values' places, so that a pair is a
    count of bits. Pairs are all of them, so callers give distinct sets; they are
    compared block by block, each pair of blocks in a task of its own."""
    values = sets.select(F.explode(set_col).alias("value")).distinct()
    place = values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("i"))  # a vocabulary
    total, words = (sets.count(), 1 + values.count() // BITS)
    each = sets.select(F.col(id_col).alias("k"), F.explode(set_col).alias("value")).join(place, "value")
    word = each.groupBy("k", F.floor(F.col("i") / BITS).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(i % {BITS}))")).alias("bits"), F.count(F.lit(1)).alias("n"))
    made = word.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.sum("n").alias("n"))
    of = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("m", w.cast("bigint")), F.lit(0).cast("bigint")))
    rows = kept(sets.select(F.col(id_col).alias("k")).join(made, "k", "left").select("k", of.alias("v"), F.coalesce("n", F.lit(0)).alias("n")), "set-bits")
    blocks = 1 + total // BLOCK
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    all_of = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = rows.select(F.col("k").alias("a"), F.col("v").alias("va"), F.col("n").alias("na"), own.alias("i"), all_of.alias("j"))
    b = rows.select(F.col("k").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"), all_of.alias("i"), own.alias("j"))
    both = a.join(b, ["i", "j"]).where("a < b")
    common = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda x, y: x + y)
    both = both.select("a", "b", "na", "nb", common.alias("c"))
    return both.select("a", "b", (F.col("c") == F.col("na")).alias("a_in_b"), (F.col("c") == F.col("nb")).alias("b_in_a"), F.try_divide(F.col("c"), F.col("na") + F.col("nb") - F.col("c")).alias("jaccard"))
