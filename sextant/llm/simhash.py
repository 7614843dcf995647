"""SimHash near-duplicates by pigeonhole blocks (operator 6).

Fingerprints of radius r are split into m > r blocks. Two fingerprints at most
r bits apart agree in at least m - r whole blocks, so they share the key made
of some m - r blocks. Each choice of blocks is a table; equal keys in a table
are candidates and the Hamming distance decides.

Equal fingerprints are one node. Buckets of up to SMALL nodes are compared in
the JVM. A larger bucket is cut into chunks; each pair of chunks is one task's
bounded work, which returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import release, ship, small_batches, text_or_empty, text_slices, written
from sextant.llm.components import connected_components

SEED = 42
SMALL = 24
CHUNK = 4096
#: Rows of an Arrow batch that hold a text.
TEXTS = 1000


def fingerprint(text: bytes, words: int) -> int:
    """64-bit SimHash of word shingles of UTF-8 text; A-Z lower-cased; no words: 0."""
    parts = text.lower().split()
    n = len(parts) - words + 1
    if not parts:
        return 0
    joined = b" ".join(parts)
    if n < 1:
        n, spans = 1, [(0, len(joined))]
    else:
        ends = list(accumulate(len(p) + 1 for p in parts))
        starts = [0, *ends[: n - 1]]
        spans = list(zip(starts, (e - 1 for e in ends[words - 1 :]), strict=True))
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans[at : at + 65536]), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long. Null texts count as empty."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints = [fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fp"])
        release()

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(radius: int, blocks: int, bits: int = 64) -> list[int]:
    """The masks, as signed longs, of each choice of blocks - radius of the blocks."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(nodes: int, radius: int) -> int:
    """Blocks so that a key has about as many bits as the count of nodes; a matter of cost, never of results."""
    for extra in (1, 2, 3, 4):
        if 64 * extra / (radius + extra) >= np.log2(max(nodes, 2)) + 1 or extra == 4:
            return radius + extra


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the links among values at most radius bits apart."""
    values = np.unique(values)
    label = np.arange(len(values))
    for at in range(0, len(values), 512):
        near = np.bitwise_count(values[at : at + 512, None] ^ values[None, :]) <= radius
        for row in near:
            met = label[row]
            least = met.min()
            if met.max() != least:
                label[np.isin(label, np.unique(met))] = least
    child = np.flatnonzero(label != np.arange(len(values)))
    return values[child], values[label[child]]


def links(nodes: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) among distinct fingerprints nodes(fp), enough to connect all
    that are linked through pairs at most radius bits apart."""
    spark = nodes.sparkSession
    ship(spark)
    masks = block_masks(radius, blocks or blocks_for(nodes.count(), radius))
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("e")).select("fp", "e.t", "e.k")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"))
    shared = written(sizes.where("n > 1"), "buckets")
    met = written(keyed.join(shared, ["t", "k"]), "bucket-rows")

    def close(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= radius

    few = met.where(F.col("n") <= SMALL).groupBy("t", "k").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    few = few.select(F.explode(F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b > a) & close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("e")).select("e.*")

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(pdf["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    many = met.where(F.col("n") > SMALL).withColumn("g", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("c")).alias("i"), F.greatest(x, F.col("c")).alias("j")))
    many = many.select("t", "k", "fp", F.explode(cells).alias("x")).select("t", "k", "fp", "x.i", "x.j")
    many = many.groupBy("t", "k", "i", "j").applyInPandas(grown, "a bigint, b bigint")
    return few.union(many).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of docs.

    Rows link when their fingerprints differ in at most radius bits;
    component_id is the smallest id that a row reaches, itself included. Null
    and empty texts have fingerprint zero and link like any other; fewer words
    than a shingle has make one shingle. Rows with null ids take part, and the
    component_id is null only where no row of the component has an id. Repeated
    rows give repeated results. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession, TEXTS):
        prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "fingerprint-nodes")
    joined = connected_components(written(links(nodes.select("fp"), radius), "links"))
    rooted = written(nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "component-ids")
    names = written(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(names, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
