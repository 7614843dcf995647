"""Near-duplicates at a given Jaccard similarity of word shingle sets, all of them (a prefix join).

Two sets of similarity t or more share one of the first n - ceil(t n) + 1
shingles of each, in any order that holds for all sets. The order puts shingles
that are frequent in a sample last, which is a matter of cost, never of results.
Candidates pass bounds that no pair at the similarity fails (sizes, what is left
after the shared shingle, counts of shingles by hash range), and the similarity
of the whole sets decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import discard, release, ship, small_batches, text_or_empty, text_slices, written
from sextant.llm.components import connected_components
from sextant.llm.decontaminate import gram_hashes
from sextant.llm.simhash import CHUNK
from sextant.llm.vectext import joined, span_hashes, white_words

#: Documents that the order of shingles is drawn from, and in how many of them a shingle is frequent.
SAMPLE, FREQUENT = 10_000, 4
#: Hash ranges whose shingles are counted.
BINS = 256
#: Rows of a bucket that are compared pair by pair in the JVM.
SMALL = 8
#: Rows of an Arrow batch that hold a text, or two.
TEXTS, PAIRS = 1000, 256


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts without words have the set {0}."""
    _, cp, at = joined([t.lower() for t in texts])
    start, end = white_words(cp)
    h, at = span_hashes(cp, start, end), np.searchsorted(start, at)
    return [np.unique(gram_hashes(h[a:b], min(words, b - a))) if b > a else np.zeros(1, np.uint64) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def prefix(grams: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set by (frequency, hash), enough to meet every set of the similarity."""
    keep = len(grams) - math.ceil(similarity * len(grams) - 1e-9) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        grams = grams[np.argsort(np.where(frequent[at] == grams, counts[at], 0), kind="stable")]
    return grams[:keep]


def bin_counts(grams: np.ndarray) -> np.ndarray:
    """Shingles by hash range; all 255, which bounds nothing, where a count is no byte."""
    n = np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return (n if n.max() < 255 else np.full(BINS, 255)).astype(np.uint8)


def may_reach(n: int | np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles with these counts by range can have the similarity."""
    bound = np.minimum(x, y).sum(axis=-1, dtype=np.int64)
    bound = np.where((x.max(axis=-1) == 255) | (y.max(axis=-1) == 255), np.minimum(n, m), bound)
    return bound >= similarity / (1 + similarity) * (n + m) - 1e-6


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of the rows that have a near-duplicate.

    component_id is the smallest id that a row reaches over pairs whose sets of
    shingles have at least the Jaccard similarity. Null and empty texts are
    alike; texts of fewer words than a shingle are one shingle. Rows with a null
    id take no part. An empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    kind, share = docs.schema[id_col].dataType.simpleString(), similarity / (1 + similarity)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            for s in shingle_sets(b.column(0).to_pylist(), words):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["g"])

    part = max(1, rows.count() // SAMPLE)
    seen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(part)) == 0).select("text").mapInArrow(sampled, "g bigint")
    often = seen.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).toPandas()  # at most the sample's shingles / FREQUENT
    frequent, counts = often["g"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(frequent)
    known = spark.sparkContext.broadcast((frequent[order], counts[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            sets = shingle_sets(b.column(1).to_pylist(), words)
            heads = [prefix(s, similarity, *known.value).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, heads)], dtype=np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))
            digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), digest, pa.array([len(s) for s in sets], pa.int32()), pa.array([bin_counts(s).tobytes() for s in sets]), keys], ["id", "digest", "size", "bins", "keys"])
        release()

    with small_batches(spark, TEXTS):
        prints = written(rows.mapInArrow(run, f"id {kind}, digest binary, size int, bins binary, keys array<bigint>"), "shingle-sets")
    nodes = written(prints.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "shingle-copies")
    same = written(prints.select("id", "digest").join(nodes, "digest").where("id <> node").select("id", "digest", "node"), "shingle-same")
    single = written(prints.join(same, ["id", "digest"], "left_anti").select(F.col("id").alias("node"), "size", "bins", "keys"), "shingle-nodes")
    discard(prints)

    keyed = single.select("node", "size", F.posexplode("keys").alias("pos", "k"))
    # counts alone go through the first shuffle; the two rows to meet are drawn from the large buckets later
    shared = written(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shingle-buckets")
    met = written(keyed.join(shared, "k"), "shingle-rows")

    def close(a: Column, b: Column) -> Column:
        left = F.least(a["size"] - a["pos"], b["size"] - b["pos"])
        return (a["node"] != b["node"]) & (left >= F.lit(share) * (a["size"] + b["size"]) - 1e-6)

    few = met.where(F.col("n") <= SMALL).groupBy("k").agg(F.collect_list(F.struct("node", "size", "pos")).alias("m"))
    few = few.select(F.explode(F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b["node"] > a["node"]) & close(a, b)), lambda b: F.struct(a["node"].alias("a"), b["node"].alias("b")))))).alias("e")).select("e.*")
    large = met.where(F.col("n") > SMALL)
    # a large bucket's rows first meet one row each by least id and by hash: what these link needs no look at pairs
    heads = written(large.groupBy("k").agg(F.min("node").alias("p"), F.max_by(F.struct("node", "size", "pos"), F.xxhash64("node")).alias("q")), "shingle-heads")
    own = {c: F.col(c) for c in ("node", "size", "pos")}
    star = F.when(close(own, {c: F.col(f"q.{c}") for c in own}), F.struct(F.least("node", "q.node").alias("a"), F.greatest("node", "q.node").alias("b")))
    least = F.when(F.col("node") != F.col("p"), F.struct(F.col("p").alias("a"), F.col("node").alias("b")))
    starred = large.join(heads, "k").select(F.explode(F.array(star, least)).alias("e")).where("e IS NOT NULL").select("e.*")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64)
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (3, 5))
            yield b.select([0, 1]).filter(pa.array(may_reach(n, m, x, y, similarity)))
        release()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                left, right = (shingle_sets(b.column(i).to_pylist(), words) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array([jaccard(x, y) >= similarity for x, y in zip(left, right, strict=True)], pa.bool_()))
        release()

    def verified(candidates: DataFrame, label: str) -> DataFrame:
        """The candidates (a, b) whose whole sets have the similarity."""
        pairs = written(candidates.distinct(), f"{label}-candidates")
        fa, fb = (single.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("bins").alias(f"x{c}")) for c in "ab")
        able = pairs.join(fa, "a").join(fb, "b").select("a", "b", "na", "xa", "nb", "xb").mapInArrow(bounded, f"a {kind}, b {kind}")
        able = written(able, f"{label}-bounded")
        ends = able.select(F.col("a").alias("id")).union(able.select("b")).distinct()
        texts = written(rows.join(ends, "id", "left_semi"), f"{label}-texts")
        ta, tb = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        with small_batches(spark, PAIRS):
            out = written(able.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(exact, f"a {kind}, b {kind}").distinct(), f"{label}-links")
        for t in (pairs, able, texts):
            discard(t)
        return out

    first = verified(few.union(starred), "shingle-first")
    labels = written(connected_components(first), "shingle-labels")

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a bucket's two chunks that aren't linked yet and may have the similarity."""
        node, size, pos, label, cell = (pdf[c].to_numpy() for c in ("node", "size", "pos", "label", "c"))
        bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, BINS)
        i, j, a, b = pdf["i"].iloc[0], pdf["j"].iloc[0], [], []
        others = np.flatnonzero(cell == j)
        for r in np.flatnonzero(cell == i):
            o = others[(label[others] != label[r]) & (np.minimum(size[others] - pos[others], size[r] - pos[r]) >= share * (size[others] + size[r]) - 1e-6)]
            if i == j:
                o = o[o > r]
            o = o[may_reach(size[r], size[o], bins[r][None, :], bins[o], similarity)] if len(o) else o
            a += np.minimum(node[r], node[o]).tolist()
            b += np.maximum(node[r], node[o]).tolist()
        return pd.DataFrame({"a": pd.Series(a, dtype=node.dtype), "b": pd.Series(b, dtype=node.dtype)})

    rest = large.join(labels.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rest.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("k")
    rest = rest.join(mixed, "k").join(single.select("node", "bins"), "node")
    rest = rest.withColumn("g", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("c")).alias("i"), F.greatest(x, F.col("c")).alias("j")))
    rest = rest.select("k", "node", "size", "pos", "label", "bins", "c", F.explode(cells).alias("x")).select("k", "node", "size", "pos", "label", "bins", "c", "x.i", "x.j")
    second = verified(rest.groupBy("k", "i", "j").applyInPandas(apart, f"a {kind}, b {kind}"), "shingle-second")
    roots = written(connected_components(first.union(second)), "shingle-roots")
    for t in (shared, met, heads, labels, single):
        discard(t)
    joined_ = roots.select(F.col("node").alias("id"), F.col("root").alias("component_id"))
    copies = same.select("id", "node").join(joined_.withColumnRenamed("id", "node"), "node", "left")
    copies = copies.select("id", F.coalesce("component_id", "node").alias("component_id"))
    first_copies = nodes.select(F.col("node").alias("id")).join(joined_, "id", "left_anti").select("id", F.col("id").alias("component_id"))
    return joined_.union(copies).union(first_copies).withColumnRenamed("id", id_col)
