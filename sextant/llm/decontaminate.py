"""Benchmark decontamination by pigeonhole edit matching (operator 7).

Texts and test items are sequences of words: lower-cased runs of letters and
digits. An item of m words may differ in k = floor(m * share) word edits. Cut
into k + 1 pieces, every occurrence within the budget keeps one piece whole, so
exact piece hits find all candidates; Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from sextant.llm.common import discard, release, ship, text_or_empty, text_slices, written
from sextant.llm.row_keys import unused
from sextant.llm.vectext import alnum_words, joined, mixed, span_hashes

#: Word edits an item may have, as a share of its words.
SHARE = 0.2
#: Test items, and characters of them, that are sent to the executors at once; more go in further passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
_BITS = 22


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and where each text's begin (one more entry: the end)."""
    _, cp, at = joined([t.lower() for t in texts])
    start, end = alnum_words(cp)
    return span_hashes(cp, start, end), np.searchsorted(start, at)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
    return mixed(out)


def pieces_of(m: int, k: int) -> list[tuple[int, int]]:
    """(offset, length) of k + 1 pieces of m words, as even as can be."""
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_edits(pattern: list[int], text: list[int]) -> int:
    """Least edit distance of the pattern to any part of the text (Myers 1999)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    pv, mv, score, best = full, 0, m, m
    for w in text:
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


class ItemIndex:
    """Pieces of a block of test items, by their length in words."""

    def __init__(self, texts: list[str], share: float = SHARE):
        words, at = word_hashes(texts)
        self.items = [words[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        self.budget = [int(len(w) * share) for w in self.items]
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for i, (w, k) in enumerate(zip(self.items, self.budget, strict=True)):
            for offset, n in pieces_of(len(w), k) if w else ():
                h = int(gram_hashes(np.array(w[offset : offset + n], np.uint64), n)[0])
                by_length.setdefault(n, []).append((h, i, offset))
        self.tables = []
        for n, rows in sorted(by_length.items()):
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << _BITS, bool)
            seen[h >> np.uint64(64 - _BITS)] = True
            self.tables.append((n, seen, h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))

    def search(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text its (item, edits) within the budget, by item."""
        words, at = word_hashes(texts)
        starts: list[np.ndarray] = []
        items: list[np.ndarray] = []
        for n, seen, h, item, offset in self.tables:
            if len(words) < n:
                continue
            grams = gram_hashes(words, n)
            hit = np.flatnonzero(seen[grams >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(h, grams[hit]), np.searchsorted(h, grams[hit], side="right")
            hit, low, count = hit[high > low], low[high > low], (high - low)[high > low]
            entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            first = np.repeat(hit, count)
            whole = np.searchsorted(at, first, side="right") == np.searchsorted(at, first + n - 1, side="right")
            starts.append(np.stack((first - offset[entry], first))[:, whole])
            items.append(item[entry][whole])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not starts or not sum(map(len, items)):
            return out
        (start, hit), item = np.concatenate(starts, axis=1), np.concatenate(items)
        doc = np.searchsorted(at, hit, side="right") - 1
        order = np.lexsort((start, item, doc))
        best: dict[tuple[int, int], int] = {}
        span: tuple[int, int, int, int] | None = None  # of candidates that overlap: doc, item, first and last word

        def settle() -> None:
            d, i, a, b = span
            edits = least_edits(self.items[i], words[a:b].tolist())
            if edits <= self.budget[i]:
                best[d, i] = min(edits, best.get((d, i), edits))

        for d, i, s in zip(doc[order].tolist(), item[order].tolist(), start[order].tolist(), strict=True):
            a, b = max(int(at[d]), s - self.budget[i]), min(int(at[d + 1]), s + len(self.items[i]) + self.budget[i])
            if span and span[:2] == (d, i) and a <= span[3]:
                span = (d, i, span[2], max(b, span[3]))
            else:
                if span:
                    settle()
                span = (d, i, a, b)
        settle()
        for (d, i), edits in sorted(best.items()):
            out[d].append((i, edits))
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list]:
    """The distinct test items with an id, in blocks of about size rows or BLOCK_CHARS characters; all texts of an id are in one block."""
    items = benchmark.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text")).where("item_id IS NOT NULL").distinct()
    total = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(1, math.ceil(total[0] / size), math.ceil((total[1] or 0) / BLOCK_CHARS))
    for b in range(blocks):
        yield items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()


class _Passes:
    """One pass over a table for each block of test items.

    A block's index lives for its own pass only: what a pass finds is written
    before the next block is sent, and the last pass is left to the caller."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, share: float, block_items: int):
        ship(docs.sparkSession)
        self.spark, self.text, self.kind = docs.sparkSession, text_col, benchmark.schema[item_id].dataType
        self.share, self.blocks = share, item_blocks(benchmark, item_id, item_text, block_items)

    def over(self, docs: DataFrame, step: Callable[[DataFrame, Column], DataFrame], label: str) -> DataFrame:
        """step(table, finds) of each block in turn, each on what the one before left."""
        out, sent, before = docs, None, None
        for rows in self.blocks:
            if sent is not None:
                now = written(out, label)
                sent.destroy()
                if before is not None:
                    discard(before)
                out = before = now
            sent = self.spark.sparkContext.broadcast(ItemIndex([r["text"] for r in rows], self.share))
            out = step(out, _search(sent, [r["item_id"] for r in rows], self.kind)(F.col(self.text).cast("string")))
        return out


def with_matches(docs: DataFrame, benchmark: DataFrame, matches: str = "matches", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs with a column of array<struct<item_id, edits>>: the test items found in each text.

    Every row keeps its columns, in one pass over the texts for each block of
    items and without a shuffle; where matches names a column of docs, in any
    case, it raises. Null and empty texts match nothing, and so do items without
    a word. Rows of an item id with several texts count each; the least edits of
    an id are given. Items with a null id are left out, and so is nothing else:
    repeated rows of docs repeat, texts of any length are searched whole, an
    empty benchmark gives empty arrays. Items of more than one block make every
    pass but the last write the table with what it has found."""
    if unused(docs, matches) != matches:
        raise ValueError(f"docs has a column {matches}")

    def step(rows: DataFrame, found: Column) -> DataFrame:
        if matches not in rows.columns:
            return rows.withColumn(matches, found)
        part = unused(rows, "_part")
        return rows.withColumn(part, found).withColumn(matches, F.array_sort(F.concat(matches, part))).drop(part)

    return _Passes(docs, benchmark, text_col, item_id, item_text, share, block_items).over(docs, step, "matches")


def _search(sent, ids: list, kind: DataType):
    """A function of a text column: the test items found in each text. Only texts go to Python and only finds come back."""
    item = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("edits", pa.int32())]))

    @F.arrow_udf(f"array<struct<item_id:{kind.simpleString()},edits:int>>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = sent.value
        for batch in texts:
            rows = []
            for part in text_slices(iter([pa.RecordBatch.from_arrays([batch], ["text"])])):
                for some in index.search([t or "" for t in part.column(0).to_pylist()]):
                    least: dict = {}
                    for i, edits in some:
                        least[ids[i]] = min(edits, least.get(ids[i], edits))
                    rows.append([{"item_id": k, "edits": v} for k, v in sorted(least.items())])
            yield pa.array(rows, item)
        release()

    return found.asNondeterministic()  # so that no plan evaluates it twice


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, edits): each test item in each text, with its least word edits."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = with_matches(rows, benchmark, "matches", **options)
    return found.select(F.col("id").alias(id_col), F.explode("matches").alias("m")).select(id_col, "m.item_id", "m.edits")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs in which no test item is found, with the columns of docs.

    Rows are decided one by one by their texts alone, whatever their ids. With
    items of several blocks each pass reads only what the one before kept."""
    name = unused(docs, "_found")

    def step(rows: DataFrame, found: Column) -> DataFrame:
        return rows.withColumn(name, found).where(F.size(name) == 0).drop(name)

    return _Passes(docs, benchmark, text_col, item_id, item_text, share, block_items).over(docs, step, "clean")
