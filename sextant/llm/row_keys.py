"""A key of its own for every row of a table, though ids repeat or are null."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import written


def unused(docs: DataFrame, name: str) -> str:
    """A name that starts like name and that no column has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _placed(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with each row's file and its place there; a table that isn't read from files is written first."""
    try:
        place = docs.metadataColumn("_metadata")
        out = docs.select("*", place["file_path"].alias(file), place["row_index"].alias(row))
        out.schema  # noqa: B018  resolves the columns
        return out
    except AnalysisException:
        return _placed(written(docs, "rows"), file, row)


def _room(docs: DataFrame, own: Column, low: int, high: int, most: int) -> int:
    """A number from which on so many are no ids: above all ids, below them, or else in a gap."""
    if high + 1 + most < 1 << 63:
        return high + 1
    if low - 1 - most >= -1 << 63:
        return low - 1 - most
    starts = [k << 56 for k in range(-127, 127)]
    taken = docs.agg(*[F.count_if(own.between(a, a + most)) for a in starts]).first()
    return next(a for a, n in zip(starts, taken, strict=True) if not n)


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a column of distinct whole numbers, and the column's name.

    The key is the id where only one row has it. Rows whose id is null or
    repeats, wholly equal rows too, get numbers that no id has: above all ids
    where there is room. Those rows are known by their
    file and place in it, so nothing of the other columns is shuffled unless
    they are too many to be sent. The id must be of a whole-number type."""
    spark = docs.sparkSession
    file, row, key = (unused(docs, n) for n in ("_file", "_place", "_key"))
    rows = _placed(docs, file, row)
    own = F.col(id_col).cast("long")
    often = rows.select(own.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select(F.col("id").alias("often"))
    odd = rows.select(own.alias("id"), F.col(file).alias("file"), F.col(row).alias("row")).join(often, F.col("id").eqNullSafe(F.col("often")), "left_semi")
    odd = written(odd.select("file", "row", F.monotonically_increasing_id().alias("number")), "odd-rows")
    ends = docs.agg(F.min(own), F.max(own)).first()
    most = odd.agg(F.max("number")).first()[0] or 0
    low, high = ends[0] or 0, ends[1] or 0
    fresh = F.lit(_room(docs, own, low, high, most)) + F.col("number")
    odd = odd.select(F.col("file").alias(f"{file}_"), F.col("row").alias(f"{row}_"), fresh.alias(key))
    both = rows.join(odd, (F.col(file) == F.col(f"{file}_")) & (F.col(row) == F.col(f"{row}_")), "left")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(key), own).alias(key)), key
