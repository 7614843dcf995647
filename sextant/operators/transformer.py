"""The forward pass of a feature-token transformer over batches of rows, its weights in a table.

Columns are grouped into tokens: a token is its bias plus its columns' values
times their vectors, and a last token stands for the whole row. Each block is
attention of several heads and a gated layer, both with residuals, normalised
before (the first attention isn't); the last block asks for the whole-row token
only, and a linear head reads that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to variances. Fixed value.
EPSILON = 1e-5
#: Rows that one pass holds at once; no result depends on it.
CHUNK = 1024


def shapes(columns: int, tokens: int, classes: int, width: int, hidden: int, blocks: int) -> dict[str, tuple[int, ...]]:
    """Name and shape of every weight."""
    out = {"tokenizer.weight": (columns, width), "tokenizer.bias": (tokens, width), "cls": (width,)}
    for i in range(blocks):
        for w in ("W_q", "W_k", "W_v", "W_out"):
            out |= {f"blocks.{i}.attention.{w}.weight": (width, width), f"blocks.{i}.attention.{w}.bias": (width,)}
        if i:
            out |= {f"blocks.{i}.attention_norm.weight": (width,), f"blocks.{i}.attention_norm.bias": (width,)}
        out |= {f"blocks.{i}.ffn_norm.weight": (width,), f"blocks.{i}.ffn_norm.bias": (width,)}
        out |= {f"blocks.{i}.ffn.linear_first.weight": (2 * hidden, width), f"blocks.{i}.ffn.linear_first.bias": (2 * hidden,)}
        out |= {f"blocks.{i}.ffn.linear_second.weight": (width, hidden), f"blocks.{i}.ffn.linear_second.bias": (width,)}
    return out | {"head.norm.weight": (width,), "head.norm.bias": (width,), "head.linear.weight": (classes, width), "head.linear.bias": (classes,)}


def drawn(spark, needed: dict[str, tuple[int, ...]], seed: int = 42) -> DataFrame:
    """(name, place, value): a weight table drawn by hash, each within its fan-in's bound; norms are 1 and 0."""
    rows = [(n, int(np.prod(s)), float(1 / np.sqrt(s[-1]))) for n, s in needed.items()]
    each = spark.createDataFrame(rows, "name string, size int, bound double").select("name", "bound", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("place"))
    u = F.pmod(F.xxhash64(F.lit(seed), "name", "place"), F.lit(1 << 32)) / float(1 << 31) - 1
    value = F.when(F.col("name").endswith("norm.weight"), 1.0).when(F.col("name").endswith("norm.bias"), 0.0).otherwise(u * F.col("bound"))
    return each.select("name", "place", value.alias("value"))


def gathered(weights: DataFrame, needed: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The weight table as arrays; its size is the model's, whatever the data. Raises on a missing or extra weight."""
    found: dict[str, dict[int, float]] = {}
    for r in weights.collect():
        found.setdefault(r["name"], {})[r["place"]] = r["value"]
    wrong = [n for n, s in needed.items() if set(found.get(n, {})) != set(range(int(np.prod(s))))]
    if wrong or set(found) - set(needed):
        raise ValueError(f"weights don't fit: {sorted({*wrong, *(set(found) - set(needed))})}")
    return {n: np.array([found[n][i] for i in range(int(np.prod(s)))]).reshape(s) for n, s in needed.items()}


class Transformer:
    def __init__(self, weights: dict[str, np.ndarray], token_of: list[int], heads: int, blocks: int):
        """token_of has the token of each column."""
        self.w, self.token_of, self.heads, self.blocks = weights, np.array(token_of), heads, blocks

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def _normed(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + EPSILON) * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def _attend(self, asking: np.ndarray, asked: np.ndarray, name: str) -> np.ndarray:
        def split(x: np.ndarray) -> np.ndarray:
            return x.reshape(*x.shape[:2], self.heads, -1)

        q, k, v = split(self._linear(asking, f"{name}.W_q")), split(self._linear(asked, f"{name}.W_k")), split(self._linear(asked, f"{name}.W_v"))
        match = np.einsum("rihd,rjhd->rhij", q, k) / np.sqrt(q.shape[-1])
        share = np.exp(match - match.max(-1, keepdims=True))
        share /= share.sum(-1, keepdims=True)
        return self._linear(np.einsum("rhij,rjhd->rihd", share, v).reshape(asking.shape), f"{name}.W_out")

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """The class logits of rows of columns."""
        tokens = len(self.w["tokenizer.bias"])
        x = np.concatenate((np.repeat(self.w["tokenizer.bias"][None], len(rows), axis=0), np.repeat(self.w["cls"][None, None], len(rows), axis=0)), axis=1)
        for t in range(tokens):
            own = np.flatnonzero(self.token_of == t)
            x[:, t] += rows[:, own] @ self.w["tokenizer.weight"][own]
        for i in range(self.blocks):
            name, last = f"blocks.{i}", i == self.blocks - 1
            asked = self._normed(x, f"{name}.attention_norm") if i else x
            asking = asked[:, -1:] if last else asked
            x = (x[:, -1:] if last else x) + self._attend(asking, asked, f"{name}.attention")
            value, gate = np.split(self._linear(self._normed(x, f"{name}.ffn_norm"), f"{name}.ffn.linear_first"), 2, axis=-1)
            x = x + self._linear(value * np.maximum(gate, 0), f"{name}.ffn.linear_second")
        return self._linear(np.maximum(self._normed(x[:, -1], "head.norm"), 0), "head.linear")


def class_logits(rows: DataFrame, id_col: str, vector: str, model: Transformer) -> DataFrame:
    """(id, logits) of each row's vector, an array of as many numbers as the model has columns.

    A null vector, or one of another length or with a null in it, gets null logits."""
    kind, columns = rows.schema[id_col].dataType.simpleString(), len(model.token_of)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                given = b.column(1).to_pylist()
                good = [i for i, v in enumerate(given) if v is not None and len(v) == columns and None not in v]
                out = [None] * len(given)
                if good:
                    for i, z in zip(good, sent.value.logits(np.array([given[i] for i in good], float)).tolist(), strict=True):
                        out[i] = z
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "logits"])

    return rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>")).mapInArrow(run, f"id {kind}, logits array<double>").withColumnRenamed("id", id_col)
