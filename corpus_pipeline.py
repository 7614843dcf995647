"""A training corpus from raw documents: toxicity, exact and near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read as the next stage's docs. All but the last keep the columns
of documents and drop rows only.

Rows are decided one by one: each stage knows a row by a key of its own, the
doc_id where only one row has it, so rows that share an id, or have none, are
told apart. Of rows with equal texts exactly one stays, wholly equal rows
included: that with the smallest doc_id, where rows whose id repeats or is null
come after all others. Null and empty texts are texts like others. Empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import decontaminate, packing
from sextant.llm.common import discard, small_batches, written
from sextant.llm.exact_dedup import DigestIndex, dedup_batch
from sextant.llm.labelled import fold
from sextant.llm.quality import score_texts
from sextant.llm.queries import tokenizer_path
from sextant.llm.row_keys import with_row_key
from sextant.llm.shingle_join import similar_groups
from sextant.llm.simhash import TEXTS, near_duplicates
from sextant.llm.toxicity import fit_toxicity


def _without(keyed: DataFrame, key: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of keyed whose key isn't among dropped(key), with these columns."""
    return keyed.join(written(dropped.select(key), "dropped"), key, "left_anti").select([F.col(f"`{c}`") for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, fold(5) != 0)
    keyed, key = with_row_key(docs)
    with small_batches(spark, TEXTS):
        return _without(keyed, key, score_texts(keyed, model, key).where("score >= 0.5"), docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one."""
    keyed, key = with_row_key(docs)
    index = DigestIndex.fresh(spark)
    out = _without(keyed, key, dedup_batch(keyed, index, key).where("NOT kept"), docs.columns)
    index.drop()
    return out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one: by SimHash as in op6, then by the shingles themselves.

    Rows whose fingerprints (four words, 64 bits) are linked at 4 bits or fewer are
    one group. SimHash loses pairs of the similarity that is meant (README), so
    the rows left go through an exact join (five words, Jaccard similarity 0.8)."""
    keyed, key = with_row_key(docs)
    prints = near_duplicates(keyed, words=4, radius=4, id_col=key)
    left = written(_without(keyed, key, prints.where(F.col(key) != F.col("component_id")), keyed.columns), "simhash-left")
    groups = similar_groups(left, words=5, similarity=0.8, id_col=key)
    return _without(left, key, groups.where(F.col(key) != F.col("component_id")), docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where each lies in which sequence."""
    pieces = packing.token_pieces(docs, tokenizer_path()).drop("ids")
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The trained scores and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)  # a stage's table goes once the next one is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "piece", "start", "length", F.col("ids_crc32"), "sequence_id", "offset")
