"""Fill-in-middle transformation (operator 12).

A text is cut into units, runs of ASCII letters or single other code points, at
two places that a keyed hash of its id draws, and its three parts are put in
another order with sentinels before them. One numpy kernel does whole Arrow
batches: a table gives each byte its class, neighbouring bytes give the mask of
units' first bytes, running counts less each document's own start number the
units, and one binary search for each cut finds its byte in all rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import release, ship, text_or_empty, text_slices
from sextant.llm.vectext import ragged

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes: within a code point, ASCII letter, first byte of any other code point.
INNER, LETTER, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = INNER
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = LETTER
PLAIN, PSM, SPM = 0, 1, 2
#: Percents of documents that are transformed, and of these that put the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry: the end)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _marked(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a sentinel of their own."""
    if len(data) < 3:
        return np.zeros(len(at) - 1, bool)
    inner = np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8))
    hit = np.flatnonzero((data[:-2] == ord("<")) & inner & (data[2:] == ord(">")))
    doc = np.searchsorted(at, hit, side="right") - 1
    found = np.zeros(len(at) - 1, bool)
    found[doc[hit + 3 <= at[doc + 1]]] = True
    return found


def transform(column: pa.Array, draws: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """Units, form, lengths of prefix and middle in code points, and the output of each text.

    draws has four unsigned numbers a row: two cuts, whether and how to transform."""
    data, at = _bytes(column)
    start, end = at[:-1], at[1:]
    kind = _CLASS[data]
    first = kind == OTHER
    letter = kind == LETTER
    first |= letter
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    inside[start[start < len(data)]] = False
    first &= ~inside
    units = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=units[1:])
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind != INNER, out=signs[1:])
    n = units[end] - units[start]
    a, b = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    # the first byte of the unit after the cut, or the text's end where no unit follows
    low = np.minimum(np.searchsorted(units[1:], units[start] + np.minimum(a, b) + 1), end)
    high = np.minimum(np.searchsorted(units[1:], units[start] + np.maximum(a, b) + 1), end)
    plain = (start == end) | _marked(data, at) | (draws[:, 2] % 100 >= RATE)
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM))
    # six pieces a row: sentinel, part, sentinel, part, sentinel, part; a plain text is its last part
    marks = {s: len(data) + 3 * i for i, s in enumerate("PSM")}
    source = np.concatenate((data, np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)))
    spm = form == SPM
    begin = np.empty((len(n), 6), np.int64)
    size = np.empty((len(n), 6), np.int64)
    begin[:, 0], begin[:, 2], begin[:, 4] = np.where(spm, marks["S"], marks["P"]), np.where(spm, marks["P"], marks["S"]), marks["M"]
    size[:, 0::2] = np.where(plain, 0, 3)[:, None]
    begin[:, 1], size[:, 1] = np.where(spm, high, start), np.where(plain, 0, np.where(spm, end - high, low - start))
    begin[:, 3], size[:, 3] = np.where(spm, start, high), np.where(plain, 0, np.where(spm, low - start, end - high))
    begin[:, 5], size[:, 5] = np.where(plain, start, low), np.where(plain, end - start, high - low)
    out = source[ragged(begin.ravel(), size.ravel())]
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(size.sum(axis=1), out=ends[1:])
    output = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(out)])
    return {"n": n, "form": form, "prefix_chars": signs[low] - signs[start], "middle_chars": signs[high] - signs[low], "output": output}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row of docs by its whole text.

    form is plain, psm or spm; the lengths are null for plain. Null texts count
    as empty and are plain, as are texts that hold a sentinel. The draws come
    from SHA-256 of seed:id; a null id counts as an empty one, and repeated rows
    repeat. Other columns of docs are not read."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["plain", "psm", "spm"])
        for b in text_slices(batches, 1):
            t = transform(b.column(1), np.stack([b.column(i).to_numpy() for i in range(2, 6)], axis=1))
            plain = t["form"] == PLAIN
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(t["n"]), names.take(pa.array(t["form"])), pa.array(t["prefix_chars"], mask=plain), pa.array(t["middle_chars"], mask=plain), t["output"].cast(pa.string())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )
        release()

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *draws)
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of.

    Transformed texts hold no sentinel, and no part of one can complete another,
    so each stands exactly once in an output."""
    middle = F.substring_index(output, MIDDLE, -1)

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, -1)

    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
