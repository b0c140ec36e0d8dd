"""Operator 8: packing documents into sequences of a fixed length.

The plan needs only how many pieces have each length: at most `capacity` numbers, however large the corpus. The
reduction and best fit run on those numbers, many equal pieces at a time; Spark then deals the pieces out to the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs_of, stored
from .tokens import encoder

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

Bins = list[tuple[list[tuple[int, int]], int]]  # ([(length, copies), ...], number of such sequences)


class Lengths:
    """Counts by length, with the lengths present in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def largest_to(self, most: int, beside: int = 0) -> int | None:
        """The largest length up to `most`; `beside` is a length of which one copy is taken already."""
        k = bisect.bisect_right(self.order, most) - 1
        while k >= 0 and self.order[k] == beside and self.counts[beside] < 2:
            k -= 1
        return self.order[k] if k >= 0 else None

    def smallest_sum(self, n: int, beside: int) -> float:
        """The sum of the n smallest pieces besides one of length `beside`; infinite if there are fewer."""
        total, left = 0, n
        for x in self.order[: n + 1]:
            here = min(left, self.counts[x] - (x == beside))
            total, left = total + here * x, left - here
        return total if not left else float("inf")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Bins, dict[int, int]]:
    """Martello-Toth reduction: fixes sequences that some best packing has; returns them and the counts left.

    For the largest length j left, with room r beside it:
    * nothing fits into r: {j} dominates every set with j;
    * some k fills r exactly: {j, k} dominates, as whatever else stood beside j fits where k stood;
    * no two pieces fit into r together: {j, k} with the largest k that fits dominates;
    * no three fit, and a + b, the pair that takes most of r, has a at least as long as every single piece and as every
      pair's longer one, and b as every pair's shorter one: {j, a, b} dominates.
    A length for which none holds is passed over, for best fit.
    """
    left, fixed = Lengths(counts), []
    below = capacity + 1
    while left.order:
        j = left.largest_to(below - 1)
        if j is None:
            break
        n, room = left.counts[j], capacity - j
        k = left.largest_to(room, beside=j)
        if k is None:
            times = n if j + j > capacity else 1
            fixed.append(([(j, 1)], times))
            left.take(j, times)
        elif k == room or left.smallest_sum(2, j) > room:
            times = n // 2 if k == j else min(n, left.counts[k])
            fixed.append(([(j, 2)] if k == j else [(j, 1), (k, 1)], times))
            left.take(j, times)
            left.take(k, times)
        elif left.smallest_sum(3, j) > room and (b := dominating_third(left, j, k, room)) is not None:
            # What is dominated stays so while a copy of each is left: the others only become fewer.
            each = Counter((j, k, b))
            times = min(left.counts[x] // n for x, n in each.items())
            fixed.append((list(each.items()), times))
            for x, n in each.items():
                left.take(x, n * times)
        else:
            below = j
    return fixed, left.counts


def dominating_third(left: Lengths, j: int, k: int, room: int) -> int | None:
    """The b of a dominating {j, k, b}, k being the largest that fits; None if there is none."""
    used = {j: 1}
    used[k] = used.get(k, 0) + 1
    free = lambda x: left.counts[x] - used.get(x, 0) > 0
    b = next((x for x in reversed(left.order[: bisect.bisect_right(left.order, room - k)]) if free(x)), None)
    # A pair without k may have a longer second piece: then {j, k, b} doesn't dominate it.
    second = next((x for x in reversed(left.order[: bisect.bisect_right(left.order, room // 2)]) if left.counts[x] - (x == j) > 1), None)
    smaller = left.order[: bisect.bisect_left(left.order, k)]
    for x in reversed(smaller):
        y = left.largest_to(min(x - 1, room - x), beside=j)
        if y is not None and (second is None or y > second):
            second = y
        if second is not None and x <= second:
            break
    return b if b is not None and (second is None or second <= b) else None


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing, equal pieces and equal sequences together."""
    opened: dict[int, list[list]] = {}  # room: [[contents, number], ...]
    rooms: list[int] = []

    def put(room: int, contents: list, number: int) -> None:
        if room not in opened:
            opened[room] = []
            bisect.insort(rooms, room)
        opened[room].append([contents, number])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            k = bisect.bisect_left(rooms, length)
            room, (contents, number) = (rooms[k], opened[rooms[k]].pop()) if k < len(rooms) else (capacity, [[], 1 << 62])
            if k < len(rooms) and not opened[room]:
                del opened[room]
                rooms.pop(k)
            each = min(n, room // length)
            times = min(number, n // each)
            put(room - each * length, [*contents, (length, each)], times)
            if contents and number > times:
                put(room, contents, number - times)
            n -= each * times
    return [(contents, number) for there in opened.values() for contents, number in there]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots in the order of (length, first): length, first piece of that length, pieces a sequence, sequences,
    first sequence_id, offset. Reduction first, best fit for the rest."""
    fixed, rest = reduce_dominated(counts, capacity)
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for contents, number in fixed + best_fit(rest, capacity):
        offset = 0
        for length, each in contents:
            first = used.get(length, 0)
            slots.append((length, first, each, number, sequence, offset))
            used[length] = first + each * number
            offset += length * each
        sequence += number
    assert used == {k: v for k, v in counts.items() if v}
    return np.array(sorted(slots), np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of `capacity` only where longer; null texts are empty.
    `part` and `place` number the pieces of equal length within a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc, end = TaskContext.get().partitionId(), {}, encoder(tokenizer), np.array([end_id], "<u4")
        for rows in runs_of(batches, "text", 8 << 20):
            out = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), enc.encode([t or "" for t in rows.column("text").to_pylist()]), strict=True):
                ids = np.concatenate((ids, end))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    place = seen.get(len(cut), 0)
                    seen[len(cut)] = place + 1
                    out.append((doc_id, piece, start, len(cut), zlib.crc32(cut.astype("<u4").tobytes()), part, place))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of (doc_id, text) with its sequence and place there.

    Null and empty texts are the end id alone. Repeated rows and null ids are documents like others. An empty table
    gives no rows. Pieces of equal length are interchangeable: the n-th of a length takes the plan's n-th slot of it.
    The plan has at most a few slots per length, whatever the number of pieces, so it travels with the task.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # At most `capacity` rows: one per length.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = slots[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            inside = rank - slot[:, 1]
            new = [pa.array(slot[:, 4] + inside // np.maximum(slot[:, 2], 1)), pa.array(slot[:, 5] + inside % np.maximum(slot[:, 2], 1) * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + new, [x.split()[0] for x in PACKED.split(", ")])

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
