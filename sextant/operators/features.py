"""Sparse rows over a fitted vocabulary, in chunks of a fixed number of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.shared import kept

#: Rows of a chunk, rows that a task groups at most, and places of a word of a row that only tells which are there.
CHUNK, PART, WORD = 20_000, 250_000, 32


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """rows with their place from 0 in the order of distinct columns.

    Rows are sorted by ranges and a part's places begin after the rows of the
    parts before it, so only one count a part is brought together."""
    at = kept(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    at = at.withColumns({"_part": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_start"))
    return at.join(starts, "_part").select(*rows.columns, (F.col("_start") + F.col("_m")).alias(number))


def vocabulary(entries: DataFrame, token: str = "token") -> DataFrame:
    """(token, idx): the distinct tokens in their order, numbered from 0; nulls have no place."""
    return numbered(entries.select(F.col(token).alias("token")).where("token IS NOT NULL").distinct(), ["token"], "idx")


def sparse_rows(ids: DataFrame, entries: DataFrame, vocab: DataFrame, id_col: str = "id", binary: bool = False) -> DataFrame:
    """(id, indices, values, unknown) of every id: the places and values that aren't zero, places ascending.

    entries is (id, token, value); equal tokens of an id add up, a null value
    counts as 1. Tokens outside the vocabulary are counted in unknown. An id
    without entries has empty arrays; the ids are distinct. With binary, entries
    is (id, token), and a token that is there counts 1, however often."""
    own, ids = entries.withColumn("id", F.col(id_col)).where("token IS NOT NULL"), ids.select(F.col(id_col).alias("id"))
    if binary:
        # words are small, so that parts by their bytes would hold too many ids
        parts = max(ids.sparkSession.sparkContext.defaultParallelism, math.ceil(ids.count() / PART))
        rows = _places(own, vocab, parts).withColumn("values", F.transform("indices", lambda _: F.lit(1.0)))
        ids = ids.repartition(parts, "id")
    else:
        known = own.select("id", "token", F.coalesce(F.col("value").cast("double"), F.lit(1.0)).alias("value"))
        known = known.groupBy("id", "token").agg(F.sum("value").alias("value")).join(vocab, "token", "left")
        cell = F.when(F.col("idx").isNotNull() & (F.col("value") != 0), F.struct("idx", "value"))
        rows = known.groupBy("id").agg(F.sort_array(F.collect_list(cell)).alias("c"), F.count_if(F.col("idx").isNull()).alias("unknown"))
        rows = rows.select("id", F.col("c.idx").alias("indices"), F.col("c.value").alias("values"), "unknown")
    out = ids.join(rows, "id", "left")
    pick = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return out.select(F.col("id").alias(id_col), pick("indices", "array<bigint>"), pick("values", "array<double>"), F.coalesce("unknown", F.lit(0)).alias("unknown"))


def _places(entries: DataFrame, vocab: DataFrame, parts: int) -> DataFrame:
    """(id, indices, unknown): the distinct places of each id's tokens, ascending, in so many parts.

    Places are bits of a word, so a task that groups them holds a number for
    each of an id's words, and not a row for each of its tokens."""
    found = entries.select("id", "token").join(vocab, "token", "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("idx"), F.lit(WORD)).cast("int"))
    word, other = F.expr(f"idx div {WORD}"), F.when(F.col("idx").isNull(), F.col("token"))
    words = found.groupBy("id", word.alias("_word"), other.alias("_other")).agg(F.bit_or(bit).alias("_bits"))
    cell = F.when(F.col("_word").isNotNull(), F.struct("_word", "_bits"))
    rows = words.repartition(parts, "id").groupBy("id").agg(F.sort_array(F.collect_list(cell)).alias("c"), F.count("_other").alias("unknown"))
    bits = F.array(*map(F.lit, range(WORD)))
    each = F.transform("c", lambda w: F.transform(F.filter(bits, lambda i: F.getbit(w["_bits"], i) == 1), lambda i: w["_word"] * WORD + i))
    return rows.select("id", F.flatten(each).alias("indices"), "unknown")


def csr_chunks(rows: DataFrame, id_col: str = "id", size: int = CHUNK) -> DataFrame:
    """(chunk, ids, starts, indices, values): compressed rows, so many a chunk, in the order of the ids.

    starts has one entry more than ids: row i has the places from starts[i] to starts[i + 1]."""
    at = numbered(rows.select(id_col, "indices", "values"), [id_col], "_row")
    at = at.withColumn("chunk", F.floor(F.col("_row") / size))
    ends = F.sum(F.size("indices")).over(Window.partitionBy("chunk").orderBy("_row"))
    cell = F.struct("_row", F.col(id_col).alias("id"), ends.alias("end"), "indices", "values")
    each = at.select("chunk", cell.alias("c")).groupBy("chunk").agg(F.sort_array(F.collect_list("c")).alias("r"))
    return each.select("chunk", F.col("r.id").alias("ids"), F.concat(F.array(F.lit(0).cast("bigint")), F.col("r.end")).alias("starts"), F.flatten("r.indices").alias("indices"), F.flatten("r.values").alias("values"))


def dense(size: int) -> Column:
    """The row as an array of so many numbers, for small vocabularies."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get("values", F.array_position("indices", i.cast("bigint")).cast("int") - 1), F.lit(0.0)))


def linear_softmax(ids: DataFrame, entries: DataFrame, coefficients: DataFrame, intercepts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, class, logit, p) of a linear model whose coefficients are rows (class, token, coefficient).

    entries is (id, token, value); a token without a coefficient adds nothing,
    an id without entries has the intercepts (class, intercept) alone."""
    each = entries.join(coefficients, "token").groupBy(id_col, "class").agg(F.sum(F.col("value") * F.col("coefficient")).alias("_s"))
    rows = ids.select(id_col).crossJoin(F.broadcast(intercepts.select("class", "intercept"))).join(each, [id_col, "class"], "left")  # classes are a registry
    rows = rows.withColumn("logit", F.col("intercept") + F.coalesce("_s", F.lit(0.0)))
    own = Window.partitionBy(id_col)
    return rows.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(own))).select(id_col, "class", "logit", (F.col("_e") / F.sum("_e").over(own)).alias("p"))
