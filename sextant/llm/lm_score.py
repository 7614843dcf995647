"""Language-model scores by weighted backoff automata (operator 13).

The model is an interpolated n-gram model of all texts to learn from: with c
counts, p(w | h) = (1 - s) c(h w) / c(h) + s p(w | h without its first word),
where h was seen, and the shorter history's p where it wasn't; below all stand
the words' add-one probabilities with one place for unknown words.

Documents are dealt in slices of bounded size, written once. Each slice sends
its distinct n-grams, as sorted 64-bit hashes with its own counts, to buckets of
hash ranges; a bucket adds up all slices' counts and answers each slice in the
order of its own hashes. No n-gram table exists as a whole anywhere. From its
answers a slice builds the part of the automaton that its texts can reach:
n-grams are states, a seen next word is an arc with its log-probability, and a
failure arc leads to the longest shorter history with the log of s. All texts of
a slice are read from left to right side by side, each carrying its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import release, ship, text_or_empty, text_slices, written
from sextant.llm.fill_in_middle import _bytes
from sextant.llm.vectext import mixed, span_hashes

#: Bytes of text of a slice, unless a single text is longer.
SLICE_BYTES = 8_000_000
#: N-grams, counted once a slice, that a bucket gets on average.
BUCKET_GRAMS = 2_000_000
#: The hashes of a text's begin, which is only a history, and of its end, which is a token.
BEGIN, END = np.uint64(1), np.uint64(2)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and how many each text has."""
    data, at = _bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    solid = ~_WHITE[data]
    border = np.zeros(len(data) + 1, bool)  # texts stand side by side without a sign between
    border[at] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | border[1:-1]
    last[:-1] &= ~solid[1:] | border[1:-1]
    start = np.flatnonzero(first)
    h = span_hashes(np.append(_LOWER[data], np.uint8(32)), start, np.flatnonzero(last) + 1)
    return h, np.diff(np.searchsorted(start, at))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by the planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.Codec("zstd").decompress(blob[8:], 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view(np.uint64)


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


class Slice:
    """The texts of a slice as one row of places in its own sorted vocabulary, each text with its begin and end."""

    def __init__(self, vocabulary: np.ndarray, stream: np.ndarray):
        self.vocabulary, self.stream = vocabulary, stream
        self.start = np.flatnonzero(stream == np.searchsorted(vocabulary, BEGIN))
        self.length = np.diff(np.append(self.start, len(stream)))

    @classmethod
    def of(cls, hashes: np.ndarray, words: np.ndarray) -> Slice:
        """From the hashes of all words and how many each text has."""
        whole = np.empty(len(hashes) + 2 * len(words), np.uint64)
        after = np.cumsum(words + 2)
        whole[after - words - 2], whole[after - 1] = BEGIN, END
        inner = np.ones(len(whole), bool)
        inner[after - words - 2] = inner[after - 1] = False
        whole[inner] = hashes
        return cls(*np.unique(whole, return_inverse=True))

    def pack(self) -> bytes:
        a = packed(steps(self.vocabulary))
        return len(a).to_bytes(8, "little") + a + packed(self.stream)

    @classmethod
    def unpack(cls, blob: bytes) -> Slice:
        n = int.from_bytes(blob[:8], "little")
        return cls(np.cumsum(unpacked(blob[8 : 8 + n]), dtype=np.uint64), unpacked(blob[8 + n :]).astype(np.int64))

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each length up to order: the sorted hashes of the slice's n-grams, and which one ends at each place (-1: none)."""
        words = self.vocabulary[self.stream]
        place = np.arange(len(words)) - np.repeat(self.start, self.length)
        out, h = [(self.vocabulary, self.stream)], words
        for k in range(2, order + 1):
            longer = np.zeros_like(h)
            longer[1:] = mixed(h[:-1] * _NEXT + words[1:])
            h, whole, at = longer, place >= k - 1, np.full(len(words), -1)
            u, at[whole] = np.unique(h[whole], return_inverse=True)
            out.append((u, at))
        return out


class Automaton:
    """States are 0, the empty history, and the n-grams shorter than the order, level by level.

    An arc is known by its state and word; a state without an arc for a word
    hands it to its failure state at the price of one weight."""

    def __init__(self, texts: Slice, order: int, counts: list[np.ndarray], tokens: int, types: int, share: float):
        self.words = len(texts.vocabulary)
        grams = texts.grams(order)
        offset = np.concatenate(([0, 1], 1 + np.cumsum([len(u) for u, _ in grams])))  # of each level's states
        p = (counts[0] + 1) / (tokens + types + 1)
        self.price = np.log10(share)
        self.plain = np.log10(p)
        known = counts[0] > 0
        self.first = np.where(known, 1 + np.arange(self.words), 0) if order > 1 else np.zeros(self.words, np.int64)
        self.begin = int(self.first[np.searchsorted(texts.vocabulary, BEGIN)])
        fail, keys, weight, after = [np.zeros(1, np.int64), np.zeros(self.words, np.int64)], [], [], []
        for k in range(2, order + 1):
            u, at = grams[k - 1]
            shorter = grams[k - 2][1]
            where = np.zeros(len(u), np.int64)  # a place where each n-gram ends
            ends = np.flatnonzero(at >= 0)
            where[at[ends]] = ends
            prefix, suffix, seen = shorter[where - 1], shorter[where], counts[k - 1] > 0
            p = np.where(seen, (1 - share) * counts[k - 1] / np.maximum(counts[k - 2][prefix], 1) + share * p[suffix], 0)
            keys.append(((offset[k - 1] + prefix) * self.words + texts.stream[where])[seen])
            weight.append(np.log10(p[seen]))
            after.append((offset[k] + np.arange(len(u)) if k < order else offset[k - 1] + suffix)[seen])
            fail.append(offset[k - 1] + suffix)
        self.fail = np.concatenate(fail)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.weight, self.after = (np.append(np.concatenate(x)[by], 0) if x else np.zeros(1) for x in (weight, after))
        self.after = self.after.astype(np.int64)

    def read(self, texts: Slice) -> np.ndarray:
        """The log-probability of each text: every one is read from its begin to its end, all side by side."""
        longest = np.argsort(-texts.length, kind="stable")
        start, length = texts.start[longest], texts.length[longest]
        total = np.zeros(len(start))
        state = np.full(len(start), self.begin)
        reading = len(length) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")
        for t in range(1, len(reading)):
            m = reading[t]
            word = texts.stream[start[:m] + t]
            gained = np.zeros(m)
            left = np.arange(m)
            s = state[:m].copy()
            while len(left):
                key = s[left] * self.words + word[left]
                arc = np.searchsorted(self.keys, key)
                hit = (self.keys[arc] == key) & (s[left] > 0)
                done, arc = left[hit], arc[hit]
                gained[done] += self.weight[arc]
                state[done] = self.after[arc]
                left = left[~hit]
                lost = s[left] == 0
                done = left[lost]
                gained[done] += self.plain[word[done]]
                state[done] = self.first[word[done]]
                left = left[~lost]
                gained[left] += self.price
                s[left] = self.fail[s[left]]
            total[:m] += gained
        out = np.empty(len(total))
        out[longest] = total
        return out


def _slices(docs: DataFrame, learn: Column, id_col: str, text_col: str, size: int) -> DataFrame:
    """(slice, ids, learn, size, blob) of all rows, whole texts; written, so that a slice stays what it is."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, hashes, words, full = TaskContext.get().partitionId() << 32, [], [], [], 0

        def made() -> pa.RecordBatch:
            texts = Slice.of(np.concatenate(hashes), np.concatenate(words))
            lists = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, x))], pa.int32()), pa.concat_arrays(x)) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([len(texts.stream)]), pa.array([texts.pack()], pa.binary())], ["slice", "ids", "learn", "size", "blob"])

        for b in text_slices(batches, 2):
            h, n = word_hashes(b.column(2))
            held.append((b.column(0), b.column(1)))
            hashes.append(h)
            words.append(n)
            full += b.column(2).nbytes
            if full >= size:
                yield made()
                number, held, hashes, words, full = number + 1, [], [], [], 0
        if held:
            yield made()
        release()

    return written(rows.mapInArrow(run, f"slice long, ids array<{kind}>, learn array<boolean>, size long, blob binary"), "slices")


def _counts(slices: DataFrame, order: int, buckets: int) -> DataFrame:
    """(slice, level, bucket, blob): what the whole corpus counts of a slice's n-grams, in the order of their hashes.

    Rows without a slice have a bucket's tokens and types."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                texts = Slice.unpack(row["blob"])
                learn = np.repeat(np.array(row["learn"], float), texts.length)
                for k, (u, at) in enumerate(texts.grams(order), 1):
                    here = at >= 0
                    n = np.bincount(at[here], weights=learn[here], minlength=len(u))
                    bucket = ((u >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(u))
                    parts = [(int(bucket[i]), packed(steps(u[i:j])), packed(n[i:j])) for i, j in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(parts)), pa.array([k] * len(parts), pa.int32()), *map(pa.array, zip(*parts, strict=True))], ["slice", "level", "bucket", "keys", "counts"])
        release()

    def added(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
        counts = [unpacked(x) for x in table["counts"].to_pylist()]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts))
        ends = np.cumsum([len(x) for x in keys])
        answers = [packed(total[at[e - len(x) : e]]) for e, x in zip(ends, keys, strict=True)]
        level, bucket, none = table["level"][0].as_py(), table["bucket"][0].as_py(), [None] * len(keys)
        word = total[u != BEGIN] if level == 1 else np.zeros(0)
        columns = [[*table["slice"].to_pylist(), None], [level] * (len(keys) + 1), [bucket] * (len(keys) + 1), [*answers, None], [*none, int(word.sum())], [*none, int((word > 0).sum())]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["slice", "level", "bucket", "blob", "tokens", "types"])

    grams = slices.select("slice", "learn", "blob").mapInArrow(sent, "slice long, level int, bucket long, keys binary, counts binary")
    return written(grams.groupBy("level", "bucket").applyInArrow(added, "slice long, level int, bucket long, blob binary, tokens long, types long"), "counts")


def lm_scores(docs: DataFrame, learn: Column, order: int = 2, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs by its whole text.

    The model learns from the rows where learn holds (null: doesn't). Words are
    runs without ASCII white space, A-Z lower-cased; a text's end is a token
    too, so an empty or null text has one. share is the weight of the shorter
    history. Words and n-grams are known by 64-bit hashes. Repeated rows learn
    and are scored repeatedly; an empty table gives no rows; where nothing is
    learned from, all scores are 0, as the unknown word is the only one. Other
    columns of docs are not read."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slices = _slices(docs, learn, id_col, text_col, slice_bytes)
    size = slices.agg(F.sum("size")).first()[0] or 0
    counts = _counts(slices, order, max(1, -(-size // bucket_grams)))
    sums = counts.where("slice IS NULL").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = sums[0] or 0, sums[1] or 0

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["level", "bucket", "blob"]).to_pylist()
        own = next(i for i, r in enumerate(rows) if r["level"] == 0)
        texts = Slice.unpack(rows[own]["blob"])
        found = [np.concatenate([unpacked(r["blob"]) for r in sorted((r for r in rows if r["level"] == k), key=lambda r: r["bucket"])]).astype(float) for k in range(1, order + 1)]
        model = Automaton(texts, order, found, tokens, types, share)
        score = model.read(texts)
        token = np.ones(len(texts.stream), bool)
        token[texts.start] = False
        base = np.add.reduceat(np.where(token, model.plain[texts.stream], 0), texts.start)
        known = np.add.reduceat(token & (found[0][texts.stream] > 0), texts.start, dtype=np.int64)
        ids = table["ids"].combine_chunks()
        ids = ids.slice(own, 1).flatten()
        release()
        return pa.Table.from_arrays([ids, pa.array(texts.length - 1), pa.array(known), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "base_score", "score"])

    texts = slices.select("slice", "ids", F.lit(0).alias("level"), F.lit(0).cast("long").alias("bucket"), "blob")
    answers = counts.where("slice IS NOT NULL").select("slice", F.lit(None).cast(f"array<{kind}>").alias("ids"), "level", "bucket", "blob")
    out = texts.union(answers).groupBy("slice").applyInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
