"""Quality classifier on supervised subword embeddings (operator 2).

Each word, each pair of neighbouring words and each character n-gram of a word,
its borders included, has a learned vector in a hashed table; a document is
their mean, and a softmax over two classes reads it. A pair's hash is that of
the difference of its words' hashes, so all repeated words share one vector. Stochastic gradient descent in numpy fits both. As the
mean and the output are linear, scoring needs one number for each table row:
its part in the difference of the two logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import chunks, release, ship, text_or_empty, text_slices
from sextant.llm.labelled import sample
from sextant.llm.vectext import joined, mixed, span_hashes, white_words

BITS, SIZES, DIMS = 18, (3, 4, 5), 8
#: Labelled documents of each class that fitting reads at most.
PER_CLASS = 1500
#: Steps of SGD, as many at every size of the sample.
STEPS = 1000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words and n-grams of all texts, text after text, and where each text's begin."""
    _, cp, at = joined(["", *texts])
    at, cp = at[1:], np.concatenate((cp, np.full(max(SIZES), 32, np.uint32)))
    start, end = white_words(cp)
    solid = np.zeros(len(cp) + 1, np.int64)
    inside = np.zeros(len(cp), bool)
    edges = np.zeros(len(cp) + 1, np.int8)
    edges[start] = 1
    edges[end] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    np.cumsum(inside, out=solid[1:])
    plain = np.where(inside, cp, np.uint32(32)).astype(np.uint64)
    word = span_hashes(cp, start, end)
    rows, places = [word >> np.uint64(64 - BITS)], [start]
    pair = np.flatnonzero(np.searchsorted(at, start[:-1], side="right") == np.searchsorted(at, start[1:], side="right"))
    rows.append(mixed(word[pair] - word[pair + 1] + np.uint64(1)) >> np.uint64(64 - BITS))
    places.append(start[pair])
    for n in SIZES:
        h = plain[: len(plain) - n + 1] + np.uint64(n)
        for j in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + plain[j : len(plain) - n + 1 + j]
        # the signs within must be of one word; the first and the last may be its borders
        whole = np.flatnonzero(solid[n - 1 : len(plain)] - solid[1 : len(plain) - n + 2] == n - 2)
        rows.append(mixed(h[whole]) >> np.uint64(64 - BITS))
        places.append(whole + 1)
    row, place = np.concatenate(rows), np.concatenate(places)
    doc = np.searchsorted(at, place, side="right") - 1
    order = np.argsort(doc, kind="stable")
    return row[order].astype(np.int32), np.searchsorted(doc[order], np.arange(len(texts) + 1))


class QualityModel:
    """Fitted weights: one number for each table row, and a bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], prior: float = 0.5, steps: int = STEPS, rate: float = 2.0, batch: int = 16, seed: int = 7) -> QualityModel:
        """Fit by so many steps of SGD, each on a batch, whatever the sample's size. With fewer than two classes every score is the prior."""
        if len(set(labels)) < 2:
            return cls(np.zeros(1 << BITS, np.float32), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
        rng = np.random.default_rng(seed)
        docs = []
        for a, b in chunks([len(t) for t in texts]):
            row, at = features(texts[a:b])
            for i in range(b - a):
                u, n = np.unique(row[at[i] : at[i + 1]], return_counts=True)
                docs.append((u, (n / max(1, n.sum())).astype(np.float32)))
        y = np.array(labels)
        share = np.bincount(y, minlength=2) / len(y)
        table = rng.normal(0, 0.1, (1 << BITS, DIMS)).astype(np.float32)
        out = np.zeros((DIMS, 2), np.float32)
        bias = np.zeros(2, np.float32)
        step = 0
        while step < steps:
            order = rng.permutation(len(docs))
            for a in range(0, len(order), batch):
                if step == steps:
                    break
                pick = order[a : a + batch]
                pick = pick[[len(docs[i][0]) > 0 for i in pick]]
                lr, step = rate * (1 - step / steps), step + 1
                if not len(pick):
                    continue
                row = np.concatenate([docs[i][0] for i in pick])
                w = np.concatenate([docs[i][1] for i in pick])[:, None]
                size = np.array([len(docs[i][0]) for i in pick])
                mean = np.add.reduceat(table[row] * w, np.cumsum(size) - size)
                logit = mean @ out + bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                p *= (0.5 / share[y[pick]])[:, None] / len(pick)
                back = (p @ out.T).astype(np.float32)
                out -= lr * (mean.T @ p).astype(np.float32)
                bias -= lr * 0.1 * p.sum(0).astype(np.float32)
                order_ = np.argsort(row, kind="stable")
                sorted_ = row[order_]
                first = np.flatnonzero(np.diff(sorted_, prepend=-1))
                table[sorted_[first]] -= lr * len(pick) * np.add.reduceat((np.repeat(back, size, axis=0) * w)[order_], first)
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return cls((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] + np.log(prior / (1 - prior))))

    def score(self, texts: list[str]) -> np.ndarray:
        row, at = features(texts)
        total = np.concatenate(([0.0], np.cumsum(self.weight[row], dtype=np.float64)))
        logit = (total[at[1:]] - total[at[:-1]]) / np.maximum(1, np.diff(at)) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most per_class labelled documents of each class where learn holds."""
    return QualityModel.fit(*sample(docs, labels, label, per_class, learn))


def score_texts(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row by its whole text; null counts as empty, which gets the bias's score.

    Repeated rows repeat. model needs score(list of texts)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(b.column(1).to_pylist()), pa.float64())], ["id", "score"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
