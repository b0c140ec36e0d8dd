"""Order MinHash: fingerprints whose likeness follows edit distance, not the set of a text's pieces alone.

A text's k-mers (k bytes) carry the number of their occurrence, so that repeats count. Under each of `orders` orders the
`size` minimal numbered k-mers are selected, put back into the order of the text, and the tuple of their k-mers is
hashed; a text that moves or repeats passages changes tuples although its k-mers stay. The orders are the turns of one
circle: order j takes hash values as they come from the angle j / orders on, so one hash of a k-mer serves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, parts, random_words, runs_of

#: Bytes of a k-mer (8 to 16), k-mers of a tuple, orders: tuples of a fingerprint (a power of two). A tuple is 16 bits.
K, SIZE, ORDERS = 12, 2, 64
DIGITS = 4
#: Selected k-mers are looked for among some this many a turn first; if a turn holds fewer than a tuple, among all.
NEAR = 24
#: Ranges of ids at most; the numbers that part them, and a row for each, reach all tasks.
RANGES = 1 << 16


def numbered(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's k-mers, and which occurrence of its k-mer each is, from 0. A shorter text is its own k-mer;
    an empty one has none."""
    n = len(text) - k + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(text, seed=31)] if text else [], np.uint64), np.zeros(min(len(text), 1), np.int64)
    eight = lambda at: np.ndarray((n,), np.dtype("<u8"), text, at, (1,))
    hashes = mixed(eight(0) * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(eight(k - 8) + np.uint64(31)))
    # Equal k-mers come together if hashes are sorted with their places in the low bits.
    mask = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    order = hashes & ~mask
    order |= np.arange(n, dtype=np.uint64)
    order.sort()
    place = (order & mask).astype(np.int64)
    order &= ~mask
    at = np.arange(n)
    again = np.concatenate(([False], order[1:] == order[:-1]))
    occurrence = np.zeros(n, np.int64)
    if again.any():
        occurrence[place] = at - np.maximum.accumulate(np.where(again, 0, at))
    return hashes, occurrence


def minimal(rank: np.ndarray, orders: int, size: int) -> np.ndarray:
    """Per order the rows of the values that come first from its angle on, `size` of them or all."""
    order = np.argsort(rank, kind="stable")
    angles = np.arange(orders, dtype=np.uint64) * np.uint64(2**64 // orders)
    first = np.searchsorted(rank[order], angles)
    return order[(first[:, None] + np.arange(min(size, len(rank)))) % len(rank)]


def signature(text: bytes, k: int = K, size: int = SIZE, orders: int = ORDERS) -> np.ndarray:
    """The tuples' hashes as unsigned 16-bit numbers, one an order; all zero for an empty text."""
    with np.errstate(over="ignore"):
        hashes, occurrence = numbered(text, k)
        n = len(hashes)
        if not n:
            return np.zeros(orders, np.uint16)
        rank = mixed(hashes + occurrence.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        rows = None
        if n > 2 * NEAR * orders:
            # What lies close behind an angle; it holds the first ones of each turn, if it holds enough of them.
            width = 2**64 // orders
            near = np.flatnonzero((rank & np.uint64(width - 1)) < np.uint64(width * NEAR * orders // n))
            if np.bincount((rank[near] >> np.uint64(width.bit_length() - 1)).astype(np.int64), minlength=orders).min() >= size:
                rows = near
        chosen = minimal(rank, orders, size) if rows is None else rows[minimal(rank[rows], orders, size)]
        chosen.sort(axis=1)
        factor = random_words(33, size)[: chosen.shape[1]]
        return (mixed((mixed(hashes[chosen]) * factor).sum(axis=1, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def shown(signatures: list[np.ndarray]) -> pa.Array:
    """Each signature as lowercase hex, DIGITS to a tuple."""
    return pa.array([s.astype(">u2").tobytes().hex() for s in signatures], pa.string())


def fingerprinted(rows: DataFrame, column: str, k: int = K, size: int = SIZE, orders: int = ORDERS, name: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of a text column; null texts count as empty ones."""
    shape = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, column):
            out = shown([signature((t or "").encode(), k, size, orders) for t in batch.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    return rows.mapInArrow(run, shape)


def likeness(a: Column, b: Column, orders: int = ORDERS) -> Column:
    """The share of tuples that two fingerprints have in common, 0 to 1."""
    tuples = lambda c: F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda i: F.substring(c, i * DIGITS + 1, F.lit(DIGITS)))
    return F.size(F.filter(F.zip_with(tuples(a), tuples(b), lambda x, y: x == y), lambda same: same)).cast("double") / orders


def ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """The rows (doc_id, text) with `range` and `slice`, which follow the order of descending ids, nulls last, and of the
    texts' hashes `h` within an id. Ranges hold like numbers of rows; an id that has more of them than a range is cut
    into slices by the hashes. Parted by numbers that are counted once, so that any later pass parts alike."""
    least = F.lit(-(2**63)).cast("long")
    key = F.coalesce("doc_id", least)
    n, cuts = rows.agg(F.count("*"), F.percentile_approx(key, [k / ranges for k in range(1, ranges)] or [0.5], 10_000)).first()
    cuts = sorted(set(cuts or ()), reverse=True) if ranges > 1 else []
    hot = {r[0]: 1 + r[1] * ranges // n for r in rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > 1 + n // ranges).collect()}
    # Two steps: the group of cuts, then the cut in it.
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[a : a + width] for a in range(0, len(cuts), width)]
    longs = lambda x: F.array(*[F.lit(c).cast("long") for c in x])
    number = F.lit(0)
    if cuts:
        group = F.size(F.filter(longs(g[0] for g in groups), lambda c: c > key))
        inside = F.size(F.filter(F.get(F.array(*map(longs, groups)), group - 1), lambda c: c > key))
        number = F.when(group == 0, 0).otherwise((group - 1) * width + inside)
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("range", number)
    part = F.lit(0)
    if hot:
        many = F.get(F.map_values(F.map_filter(F.create_map(*[x for k, m in hot.items() for x in (F.lit(k).cast("long"), F.lit(m))]), lambda k, _: k == key)), F.lit(0))
        part = F.coalesce(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * many).cast("int"), F.lit(0))
    return rows.withColumn("slice", part)


def first_rows(rows: DataFrame) -> DataFrame:
    """What `ranged` gives, for the row that comes after the last one of each slice of a range: the first of the next one
    that has any, and after the last of all the first of all. Ids and hashes alone are looked at to find them."""
    where = ["range", "slice"]
    # For an id, a flag that puts nulls last and its bits turned, which puts the largest first.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("h"))
    first = rows.groupBy(*where).agg(F.min_by(F.struct("doc_id", "h"), order).alias("x"))
    # One row a range or slice: the only windows that have no key.
    every = Window.orderBy(*where)
    last = F.max(F.struct(*where)).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = first.select(F.col("x.doc_id").alias("id"), F.col("x.h").alias("hash"), F.coalesce(F.lag(F.struct(*where)).over(every), last).alias("before"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    found = rows.drop(*where).join(F.broadcast(pairs), same).groupBy("before").agg(F.min(F.struct("text", "doc_id", "h")).alias("x"))
    return found.select("x.doc_id", "x.text", "x.h", "before.range", "before.slice")


def edited_by_next(docs: DataFrame, k: int = K, size: int = SIZE, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint): each document with its text edited by
    the next one's, in the order of descending ids, and the three texts' fingerprints.

    The edit puts the first characters of the next text, as many as there are, in place of the last third. After the last
    document comes the first; a single one is next to itself. Null texts count as empty; empty texts have a fingerprint
    of zeros, texts shorter than a k-mer are one. Null ids come last, rows of one id by the hashes of their texts.
    Repeated rows stay, each next to the other. An empty table gives none. Further columns are left. Texts of any
    length are hashed whole.

    Rows are dealt by ranges of ids and sorted; a task holds two texts at a time. A range's last row needs the first one of
    the next range: these are a row a range, sent along with the rows of that range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = ranged(rows, min(RANGES, parts(docs.sparkSession)))
    both = rows.withColumn("own", F.lit(True)).unionByName(first_rows(rows).withColumn("own", F.lit(False)))
    dealt = both.repartitionByRange(parts(docs.sparkSession), "range", "slice").sortWithinPartitions("range", "slice", F.desc("own"), F.desc_nulls_last("doc_id"), "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in runs_of(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out = []
            for doc, text, own in zip(ids, texts, batch.column("own").to_pylist(), strict=True):
                mark = signature(text.encode(), k, size, orders)
                if held:
                    last, before, its = held
                    third = len(before) // 3
                    edited = before[: len(before) - third] + text[:third]
                    out.append((last, len(before), edited, its, signature(edited.encode(), k, size, orders) if third else its, mark))
                held = (doc, text, mark) if own else None
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:3], (pa.int64(), pa.int64(), pa.string()), strict=True)] + [shown(c) for c in columns[3:]], NAMES)

    return dealt.select("doc_id", "text", "own").mapInArrow(run, SHAPE)


SHAPE = "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string"
NAMES = [c.split()[0] for c in SHAPE.split(", ")]
