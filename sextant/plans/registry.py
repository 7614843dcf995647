"""The registered queries of the library's own operators, by their inventory name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sextant.sources.shared import kept

MODULES = ["ranking", "metrics", "tokens", "graph", "fusion", "retrieval", "history", "language", "statistics", "sources", "composites", "decisions"]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


class Count:
    """The count of rows; a column is made only once a session is there."""

    def alias(self, name: str) -> Column:
        return F.count(F.lit(1)).alias(name)


N = Count()


class Tables:
    """The tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, {}

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small table of literals; unlike rows of an RDD, the planner knows its size."""
        kinds = StructType.fromDDL(schema)
        arrow = to_arrow_schema(kinds)
        return self.spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow), kinds)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of a query read, made and written at the first call."""
        if name not in self.made:
            self.made[name] = kept(make(), name)
        return self.made[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under name, with DuckDB SQL for the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        _queries[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _oracles[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"sextant.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
