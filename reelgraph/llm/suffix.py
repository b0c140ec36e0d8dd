"""Operator 3: removal of long strings that occur earlier in the corpus, by sorting sampled suffixes.

Only a sample of the suffixes is sorted: those that start where a locally smallest hash of `SEED` bytes stands. Each
string of `WIDTH` bytes holds such a place, and equal strings hold it at equal distance, so the equality of
all other strings of that length is settled from the sampled ones to their right. Hashes are sorted, not texts: nothing is
in suffix order.

1. A sampled suffix carries the run of strings that it decides as one tuple (hash of the seed, hash of the whole run,
   document, place). Spark's sort, which spills to disk, brings equal seeds and, within them, equal runs together. A
   run that occurred before is removed whole; a seed with one kind of run has no more repeats.
2. The first of each kind of run under a seed of several kinds is sorted by seed once more, now with its bytes. Within
   a seed the single strings are laid out from the sampled suffix and compared. Seeds with very many kinds are cut up:
   there each single string is sorted by a hash of its own.

Tasks merge equal tuples before they send them, so that a string in a third of all documents reaches the sort a few
times a task at most.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, byte_runs, mixed, runs_of, stored

WIDTH, SEED = 100, 32
SPAN = WIDTH - SEED + 1
#: A seed with more kinds of runs than this in one task is cut up into single strings.
KINDS = 64
#: Tuples that a task holds before it merges and sends them; starts of strings looked at together.
HELD, SEGMENT = 1 << 19, 1 << 20
NO_ID = -(1 << 63)
LOW = np.uint64((1 << 24) - 1)
WHOLE, REPEAT, OPEN, MARK = 0, 1, 2, 3
#: Single strings held at once on the second level.
HELD_STRINGS = 1 << 18
TUPLES = "seed bigint, run bigint, d bigint, t bigint, at bigint"


def packed(start: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    return start << 24 | n << 2 | kind


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by the first one's place."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, starts that are allowed) of overlapping pieces of the joined texts."""
    starts = len(data) - WIDTH + 1
    if starts <= 0:
        return
    whole = np.ones(starts, bool)
    for end in offsets[1:-1].tolist():
        whole[max(0, end - WIDTH + 1) : end] = False
    for a in range(0, starts, SEGMENT):
        b = min(starts, a + SEGMENT)
        yield a, data[a : b + WIDTH - 1], whole[a:b]


def sampled(data: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of allowed starts that one sampled suffix decides: first start, number, hash of seed, hash of run."""
    seeds, hashes = mixed(RangeHash(data, 1).every(SEED)[: len(data) - SEED + 1]), RangeHash(data, 7)
    order = (seeds & ~LOW) | np.arange(len(seeds), dtype=np.uint64)
    place = (smallest(order, SPAN) & LOW).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    edge = np.concatenate((np.flatnonzero(new | ~whole), [len(place)]))
    before = np.ones(len(place), bool)
    before[1:] = ~whole[:-1]
    starts = np.flatnonzero(whole & (new | before))
    ends = edge[np.searchsorted(edge, starts, side="right")]
    at = place[starts]
    run = hashes.of(starts, ends + WIDTH - 1) + (at - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return starts, ends - starts, seeds[at], mixed(run)


def merged(d: np.ndarray, t: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjoining or equal runs of one document as one; none grows over a border of 2 Mi starts."""
    order = np.lexsort((start, t, d))
    d, t, start, n = d[order], t[order], start[order], n[order]
    if not len(d):
        return d, t, start, n
    reach = start + n
    cut = np.ones(len(d), bool)
    cut[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (start[1:] != reach[:-1]) | (start[1:] >> 21 != start[:-1] >> 21)
    first = np.flatnonzero(cut)
    last = np.concatenate((first[1:] - 1, [len(d) - 1]))
    return d[first], t[first], start[first], reach[last] - start[first]


def first_of(keys: tuple[np.ndarray, ...], d: np.ndarray, t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the first of their key by document and place, rows whose key has an earlier one). A row that is
    the first one once more, of an equal text with the same id, is neither."""
    both = mixed(keys[0] + keys[1] * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((start, t, d, both))
    first = np.ones(len(order), bool)
    first[1:] = (keys[0][order[1:]] != keys[0][order[:-1]]) | (keys[1][order[1:]] != keys[1][order[:-1]])
    lead = order[first][np.cumsum(first) - 1]
    return order[first], order[(d[order] != d[lead]) | (t[order] != t[lead]) | (start[order] != start[lead])]


def batch_of(seed, run, d, t, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(run.view(np.int64)), pa.array(d), pa.array(t), pa.array(at)], ["seed", "run", "d", "t", "at"])


def level_one(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    seed, run, d, t, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
    kept, later = first_of((seed, run), d, t, start)
    rd, rt, rs, rn = merged(d[later], t[later], start[later], n[later])
    yield batch_of(mixed(rd.view(np.uint64) + rs.astype(np.uint64)), np.zeros(len(rd), np.uint64), rd, rt, packed(rs, rn, REPEAT))
    kept = kept[np.argsort(seed[kept], kind="stable")]
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], seed[kept][1:] != seed[kept][:-1]))), [len(kept)]))
    many = np.flatnonzero(np.diff(edge) > KINDS)
    hot = np.repeat(np.diff(edge) > KINDS, np.diff(edge))
    cold, open_ = kept[~hot], kept[hot]
    yield batch_of(seed[cold], run[cold], d[cold], t[cold], packed(start[cold], n[cold], WHOLE))
    if len(many):
        yield batch_of(mixed(d[open_].view(np.uint64) ^ mixed(start[open_].astype(np.uint64))), np.zeros(len(open_), np.uint64), d[open_], t[open_], packed(start[open_], n[open_], OPEN))
        two = np.concatenate((kept[edge[many]], kept[edge[many] + 1]))
        yield batch_of(seed[two], run[two], np.full(len(two), NO_ID), np.zeros(len(two), np.int64), np.full(len(two), MARK, np.int64))


def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in runs_of(batches, "text"):
        data, offsets = byte_runs(batch.column("text"))
        ids, kinds = batch.column("d").to_numpy(), batch.column("t").to_numpy()
        for base, piece, whole in segments(data, offsets):
            starts, n, seed, run = sampled(piece, whole)
            doc = np.searchsorted(offsets, starts + base, side="right") - 1
            held.append((seed, run, ids[doc], kinds[doc], starts + base - offsets[doc], n))
            rows += len(starts)
        if rows >= HELD:
            yield from level_one(held)
            held, rows = [], 0
    if rows:
        yield from level_one(held)


def lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column, end to end, and how many each row has; a null list has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second level: the open runs with their bytes, by seed; those of a cut-up seed as single strings, by hash."""

    def sent(keys, d, t, at, raw):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(d), pa.array(t), pa.array(at), pa.array(raw, pa.binary())], ["seed", "d", "t", "at", "bytes"])

    def strings(held):
        one, two, d, t, start = (np.concatenate([h[k] for h in held]) for k in range(5))
        raw = [r for h in held for r in h[5]]
        kept, later = first_of((one, two), d, t, start)
        rd, rt, rs, rn = merged(d[later], t[later], start[later], np.ones(len(later), np.int64))
        yield sent(rd ^ rs, rd, rt, packed(rs, rn, REPEAT), [b""] * len(rd))
        yield sent(one[kept].view(np.int64), d[kept], t[kept], packed(start[kept], np.ones(len(kept), np.int64), WHOLE), [raw[k] for k in kept.tolist()])

    held, rows = [], 0
    for batch in runs_of(batches, "text"):
        data, offsets = byte_runs(batch.column("text"))
        text, ids, kinds = data.tobytes(), batch.column("d").to_numpy(), batch.column("t").to_numpy()
        values, count = lists(batch.column("runs"))
        seed, at = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        doc = np.repeat(np.arange(len(count)), count)
        begin, n = (at >> 24) + offsets[doc], at >> 2 & 0x3FFFFF
        by_seed, single = np.flatnonzero(at & 3 == WHOLE), np.flatnonzero(at & 3 == OPEN)
        if len(by_seed):
            yield sent(seed[by_seed], ids[doc[by_seed]], kinds[doc[by_seed]], at[by_seed], [text[a : a + k + WIDTH - 1] for a, k in zip(begin[by_seed].tolist(), n[by_seed].tolist(), strict=True)])
        if len(single):
            b, k = begin[single], n[single]
            start = np.unique(np.repeat(b - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum()))
            own = np.searchsorted(offsets, start, side="right") - 1
            for base, piece, _ in segments(data, offsets):
                a, b = np.searchsorted(start, (base, base + len(piece) - WIDTH + 1))
                one, two = (mixed(RangeHash(piece, s).of(start[a:b] - base, start[a:b] - base + WIDTH)) for s in (3, 5))
                held.append((one, two, ids[own[a:b]], kinds[own[a:b]], start[a:b] - offsets[own[a:b]], [text[k : k + WIDTH] for k in start[a:b].tolist()]))
            rows += len(start)
        if rows >= HELD_STRINGS:
            yield from strings(held)
            held, rows = [], 0
    if rows:
        yield from strings(held)


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of seed: the strings among them that occur before, as runs of places."""

    def solve(rows: pa.Table):
        at, d, t = (rows.column(c).to_numpy() for c in ("at", "d", "t"))
        data, offsets = byte_runs(rows.column("bytes"))
        done = np.flatnonzero(at & 3 == REPEAT)
        if len(done):
            yield pa.RecordBatch.from_arrays([pa.array(d[done]), pa.array(t[done]), pa.array(at[done])], ["d", "t", "at"])
        n = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
        for a, b in groups_of(rows.column("seed").to_numpy(), n):
            k = np.repeat(np.arange(a, b), n[a:b])
            inside = np.arange(len(k)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            if not len(k):
                continue
            piece = data[offsets[a] : offsets[b]]
            where = offsets[k] - offsets[a] + inside
            one, two = (mixed(RangeHash(piece, s).of(where, where + WIDTH)) for s in (3, 5))
            start = (at[k] >> 24) + inside
            _, later = first_of((one, two), d[k], t[k], start)
            rd, rt, rs, rn = merged(d[k][later], t[k][later], start[later], np.ones(len(later), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rd), pa.array(rt), pa.array(packed(rs, rn, REPEAT))], ["d", "t", "at"])

    def groups_of(seed: np.ndarray, n: np.ndarray):
        """Runs of rows with about HELD_STRINGS strings that don't part a seed."""
        edge = np.concatenate((np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1]))), [len(seed)]))
        before = np.concatenate(([0], np.cumsum(n)))[edge]
        a = 0
        while a < len(edge) - 1:
            b = max(a + 1, int(np.searchsorted(before, before[a] + HELD_STRINGS, side="right")) - 1)
            yield int(edge[a]), int(edge[b])
            a = b

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        seed = batch.column("seed").to_numpy()
        cut = int(np.searchsorted(seed, seed[-1])) if len(seed) else 0
        if cut:  # the seeds before the last one are whole
            yield from solve(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        elif waiting and len(seed) and waiting[-1].column("seed")[-1].as_py() != seed[0]:
            yield from solve(pa.Table.from_batches(waiting))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from solve(pa.Table.from_batches(waiting))


def sorted_tuples(tuples: DataFrame) -> DataFrame:
    """Brings equal tuples together; adds `later` (one of another document or place comes before), `several` (its seed
    has several runs) and `cut_up` (in some task very many)."""
    kind, own = F.col("at").bitwiseAND(F.lit(3)), F.struct("d", "t", "at")
    same = Window.partitionBy("seed", "run").orderBy(kind == MARK, "d", "t", "at")
    by_seed = Window.partitionBy("seed")
    rows = tuples.repartition("seed").withColumn("later", own != F.first(own).over(same))
    rows = rows.withColumn("several", F.min("run").over(by_seed) != F.max("run").over(by_seed)).withColumn("cut_up", F.max(kind).over(by_seed) == MARK)
    return rows.where(kind != MARK).select("seed", "d", "t", "at", kind.alias("kind"), "later", "several", "cut_up")


def repeated(rows: DataFrame, d: str, t: str) -> DataFrame:
    """(d, t, runs) for each document of rows (d and t name it, text) that has any: the packed runs of starts of strings that
    occur before.

    The rows meet their open runs here, and all their runs where they are cut. They come along here with all their columns,
    so that both are one and the same shuffle for Spark, which then makes it once."""
    text = [F.col(f"`{d}`").alias("d"), F.col(f"`{t}`").alias("t"), F.col("text").cast("binary").alias("text")]
    found = sorted_tuples(rows.select(*text).mapInArrow(sample, TUPLES))
    whole = F.col("kind") == WHOLE
    is_open = (F.col("kind") == OPEN) | (whole & ~F.col("later") & F.col("several"))
    repeats = (F.col("kind") == REPEAT) | (whole & F.col("later"))
    # The last two bits of an open run say how it is sorted on the second level.
    bits = F.when(is_open & F.col("cut_up"), OPEN).otherwise(F.col("kind"))
    at = F.col("at").bitwiseAND(F.lit(-4)).bitwiseOR(bits.cast("long"))
    one = stored(found.where(is_open | repeats).select("seed", "d", "t", at.alias("at"), is_open.alias("open")))

    # No more than a document has places.
    runs = one.where("open").groupBy("d", "t").agg(F.collect_set(F.struct("seed", "at")).alias("runs"))
    own = f"runs {uuid.uuid4().hex}"
    rest = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (d, t, "text")]).alias("rest")
    met = rows.join(runs.select(F.col("d").alias(d), F.col("t").alias(t), F.col("runs").alias(own)), [d, t])
    pieces = met.select(*text, F.col(f"`{own}`").alias("runs"), rest).mapInArrow(opened, "seed bigint, d bigint, t bigint, at bigint, bytes binary")
    two = pieces.repartition("seed").sortWithinPartitions("seed").mapInArrow(settled, "d bigint, t bigint, at bigint")
    return one.where("NOT open").select("d", "t", "at").unionByName(two).groupBy("d", "t").agg(F.collect_list("at").alias("runs"))


def named(docs: DataFrame, columns: list[Column], d: str, t: str, copy: str) -> DataFrame:
    """The columns of docs with three that name a row: d, the doc_id (NO_ID for null); t, a hash of the text where ids
    are null or repeated, else 0; copy, which numbers rows of the same id and text from 0.

    Only ids are counted for it; texts are dealt out by name only if some id is null or repeated."""
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    ids = stored(docs.groupBy(key.alias(d)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col(d) == NO_ID)).select(d, F.lit(True).alias(t)))
    if ids.isEmpty():
        return docs.select(*columns, key.alias(d), F.lit(0).cast("long").alias(t), F.lit(0).alias(copy))
    rows = docs.select(*columns, F.xxhash64("text").alias(copy), key.alias(d)).join(ids, d, "left")
    rows = rows.withColumn(t, F.when(F.col(f"`{t}`"), F.col(f"`{copy}`")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn(copy, F.row_number().over(Window.partitionBy(f"`{d}`", f"`{t}`").orderBy(f"`{copy}`")) - 1)


def left_of(text: bytes, runs: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside the strings that start in the runs, and the number of stretches removed."""
    if not len(runs):
        return text, 0
    start, n = runs >> 24, (runs >> 2) & 0x3FFFFF
    step = np.zeros(len(text) + 1, np.int32)
    np.add.at(step, np.minimum(start, len(text)), 1)
    np.add.at(step, np.minimum(start + n + WIDTH - 1, len(text)), -1)
    gone = (np.cumsum(step[:-1], dtype=np.int32) > 0).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
    return b"".join(text[a:b] for a, b in zip([0, *edges[1::2].tolist()], [*edges[::2].tolist(), len(text)], strict=True)), len(edges) // 2


def with_runs(batch: pa.RecordBatch, text: str, runs: str, copy: str) -> Iterator[tuple[bytes, np.ndarray]]:
    """The texts and their runs. Every string of a copy occurs before."""
    values, count = lists(batch.column(runs))
    values, ends = values.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(count)
    for t, n, end, k in zip(batch.column(text).cast(pa.large_binary()).to_pylist(), count.tolist(), ends.tolist(), batch.column(copy).to_pylist(), strict=True):
        every = k and len(t or b"") - WIDTH + 1
        yield t or b"", values[end - n : end] if not every or every < 0 else np.arange(0, every, 1 << 21, dtype=np.int64) << 24 | np.minimum(every - np.arange(0, every, 1 << 21), 1 << 21) << 2


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of (doc_id, text); kept is what is left.

    A null or empty text has no bytes. A null doc_id is smaller than all others. Rows of one id are documents of their
    own, in the order of a hash of their texts; of rows with equal id and text the first keeps what it has for itself.
    An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text", 8 << 20):
            out = []
            for text, runs in with_runs(batch, "text", "runs", "copy"):
                kept, spans = left_of(text, runs)
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = named(docs, [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text")], "d", "t", "copy")
    joined = texts.join(repeated(texts, "d", "t"), ["d", "t"], "left").select("doc_id", "text", "runs", "copy")
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of documents with repeats cut out of their texts; texts that are removed whole go, empty ones stay.

    Other columns stay as they are but for n_chars, if there is one: the number of characters left. What a cut leaves of
    a character is dropped.
    """
    mark = uuid.uuid4().hex
    d, t, copy, runs_name, schema, names = f"d {mark}", f"t {mark}", f"copy {mark}", f"runs {mark}", docs.schema, docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text", 8 << 20):
            kept, texts = [], []
            for k, (given, (text, runs)) in enumerate(zip(batch.column("text").to_pylist(), with_runs(batch, "text", runs_name, copy), strict=True)):
                left, spans = left_of(text, runs)
                if left or not spans:
                    kept.append(k)
                    texts.append(left.decode(errors="ignore") if spans else given)
            rows = batch.take(pa.array(kept, pa.int64()))
            new = {"text": pa.array(texts, batch.column("text").type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(k) for k, c in enumerate(names)], names)

    texts = named(docs, [docs[f"`{c}`"] for c in names], d, t, copy)
    gone = repeated(texts, d, t)
    joined = texts.join(gone.select(F.col("d").alias(d), F.col("t").alias(t), F.col("runs").alias(runs_name)), [d, t], "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], f"`{runs_name}`", f"`{copy}`").mapInArrow(cut, schema)


#: remove_repeats over `documents` as DuckDB SQL, without the text left: every 100-byte string by its hash.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i FROM d) x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) x WHERE n > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r) x),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS begun FROM e),
t AS (SELECT p.doc_id, string_agg(substr(h, 2 * begun + 1, 2 * (a - begun)), '' ORDER BY a, b) AS kept, sum(b - a) AS gone, count(*) - 1 AS spans, max(length(h)) // 2 AS n FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t"""
