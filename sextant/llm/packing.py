"""Best-fit packing of tokenised documents into sequences (operator 8).

All that packing needs of the corpus is how many pieces there are of each
length: at most `capacity` numbers, however large the corpus. Those are reduced
by Martello-Toth dominance, the rest goes best fit decreasing, and the plan is a
table of (length, range of ranks) -> (sequence, offset) whose size depends on the
capacity alone. Pieces then look up their place by length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import release, ship, text_or_empty, text_slices, written
from sextant.llm.row_keys import unused
from sextant.llm.word_bpe import encoder

CAPACITY = 4096
#: Ranks of one length are counted in this many parts, so that no task holds a whole length.
PARTS = 256


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, ids_crc32): each document's ids, then end_id, cut into pieces.

    ids are little-endian unsigned 32-bit; only documents longer than capacity
    are cut. Null texts count as empty and give the one id end_id."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in text_slices(batches):
            flat, at = encode(batch.column(1).to_pylist())
            row, piece, start, length, ids, crc = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                own = np.append(flat[a:b].astype("<u4"), np.uint32(end_id))
                for k, s in enumerate(range(0, len(own), capacity)):
                    data = own[s : s + capacity].tobytes()
                    row.append(i), piece.append(k), start.append(s), length.append(len(data) // 4), ids.append(data), crc.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids", "ids_crc32"],
            )
        release()

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint")


def _largest(lengths: list[int], most: int) -> int:
    """The largest of the sorted lengths that is at most `most`, or 0."""
    i = bisect_right(lengths, most)
    return lengths[i - 1] if i else 0


def reduce_by_dominance(count: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fix bins that some optimal packing contains; count keeps what is left.

    For an item of length L with room r = capacity - L, and a the largest item
    that fits r, Martello and Toth's criterion gives, in this order:
    nothing fits: {L}; a = r, or no two items fit: {L, a}; no three items fit,
    and with k the largest that fits r - a no fitting pair has a smaller member
    over k: {L, a, k}. Each set can take the place of any set that holds L.
    Counts of equal items are fixed at once, since every condition stays true
    while items leave."""
    fixed: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(*items: int) -> bool:
        need = {x: items.count(x) for x in items}
        n = min(count.get(x, 0) // c for x, c in need.items())
        if not n:
            return False
        for x, c in need.items():
            count[x] -= n * c
            if not count[x]:
                del count[x]
        fixed.append((tuple(sorted(need.items(), reverse=True)), n))
        return True

    def smallest_sum(size: int, lengths: list[int], without: int) -> int:
        total = left = 0
        for x in lengths[: size + 1]:
            n = min(size - left, count[x] - (x == without))
            total, left = total + n * x, left + n
        return total if left == size else capacity + 1

    changed = True
    while changed:
        changed = False
        for length in sorted(count, reverse=True):
            while count.get(length):
                lengths = sorted(count)
                room = capacity - length
                rest = lengths if count[length] > 1 else [x for x in lengths if x != length]
                a = _largest(rest, room)
                if not a:
                    done = take(length)
                elif a == room or smallest_sum(2, lengths, length) > room:
                    done = take(length, a)
                elif smallest_sum(3, lengths, length) > room:
                    spare = lambda x: count.get(x, 0) - (x == length)
                    second = [x for x in rest if spare(x) - (x == a) > 0]
                    k = _largest(second, room - a)
                    small = max((y for y in rest if 2 * y <= room and (spare(y) > 1 or any(y < z <= room - y for z in rest))), default=0)
                    done = bool(k) and small <= k and take(length, a, k)
                else:
                    done = False
                if not done:
                    break
                changed = True
    return fixed


def best_fit_decreasing(count: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing over counts of lengths, many equal bins at a time."""
    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    full: list[tuple[tuple[tuple[int, int], ...], int]] = []
    bins_at = np.zeros(capacity + 1, np.int64)

    def put(bins: tuple[tuple[int, int], ...], room: int, n: int) -> None:
        if not n:
            return
        if room:
            rooms.setdefault(room, []).append((bins, n))
            bins_at[room] += 1
        else:
            full.append((bins, n))

    for length in sorted(count, reverse=True):
        left = count[length]
        while left:
            fits = np.flatnonzero(bins_at[length:])
            if len(fits):
                room = length + int(fits[0])
                bins, n = rooms[room].pop()
                bins_at[room] -= 1
            else:
                room, bins, n = capacity, (), left
            each = room // length
            whole = min(n, left // each)
            put((*bins, (length, each)), room - each * length, whole)
            left -= whole * each
            if whole < n and left:
                put((*bins, (length, left)), room - left * length, 1)
                whole, left = whole + 1, 0
            if bins:
                put(bins, room, n - whole)
    return full + [x for some in rooms.values() for x in some]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, sequence, copies a sequence, offset), sorted: where the pieces of a length go by rank."""
    left = dict(count)
    groups = reduce_by_dominance(left, capacity) + best_fit_decreasing(left, capacity)
    rank, rows, sequence = dict.fromkeys(count, 0), [], 0
    for bins, n in groups:
        offset = 0
        for length, copies in bins:
            rows.append((length, rank[length], sequence, copies, offset))
            rank[length] += n * copies
            offset += length * copies
        sequence += n
    assert rank == count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset, every sequence gapless from 0 and at most capacity long.

    pieces needs id, piece, start and length (1 to capacity); its other columns
    stay, whatever their names, but a table that has a sequence_id or an offset
    raises. Rows may repeat; each gets a place of its own. No rows give no rows."""
    spark = pieces.sparkSession
    ship(spark)
    if clash := {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError(f"pieces must not have the columns that packing adds: {sorted(clash)}")
    part, inner, first, place_ = (unused(pieces, n) for n in ("_part", "_within", "_before", "_rank"))
    rows = written(pieces.withColumn(part, F.pmod(F.xxhash64("id", "piece", "start"), F.lit(PARTS)).cast("int")), "pieces")
    counts = written(rows.groupBy("length", part).agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = plan(totals, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", part, F.coalesce(before, F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy("length", part).orderBy("id", "piece"))
    ranked = rows.withColumn(inner, within).join(starts, ["length", part]).withColumn(place_, F.col(first) + F.col(inner) - 1).drop(first, inner, part)
    fields = ranked.schema
    sent = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        key = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", place_))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            over = rank - t[at, 1]
            sequence, offset = t[at, 2] + over // t[at, 3], t[at, 4] + over % t[at, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(sequence), pa.array(offset)], [*(f.name for f in fields), "sequence_id", "offset"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(place, f"{names}, sequence_id bigint, offset bigint").drop(place_)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed pieces' ids in order; a sequence has at most capacity ids.

    packed must still have ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
