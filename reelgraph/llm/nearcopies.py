"""Operator 1 at a wider radius: one document of each group whose five-word shingles are alike by 0.8 or more.

At that likeness two SimHash fingerprints of 64 bits differ by ten bits on average, and a byte is shared by one pair in four:
too few for an index. So a second fingerprint is made of the same hashes: its byte p is that of the one shingle that comes
first in an order of its own, and two texts share a byte as often as their sets of shingles are alike. The method stays that
of the operator: postings by byte positions, a tally of the shared positional bytes of a pair against a least number, and a
check of what is left on the shingles themselves.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import byte_runs, random_words, runs_of, stored
from .graph import components

#: Bytes of a wide fingerprint, each with its order of shingles.
POSITIONS = 100
ORDERS = random_words(29, POSITIONS).astype(np.uint32)
#: Neighbouring bytes that name a posting list. Of the 20 lists of a text, a pair alike by 0.8 shares one or more with
#: probability 0.9996, and two texts without a common shingle one with 2e-11.
NAMED_BY = 5
#: Members of a long list are compared by blocks of about this many.
BLOCK = 512
#: Hashes of a text, the smallest ones, that go with it to its lists. Texts of fewer shingles are compared there exactly.
SKETCH = 4096


def least_shared(similarity: float) -> int:
    """The tally that all but one in 700 pairs of this similarity reach: three deviations below the mean."""
    return math.floor(POSITIONS * similarity - 3 * math.sqrt(POSITIONS * similarity * (1 - similarity)))


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (big-endian) of each shingle, in pieces; words as in simhash.fingerprint. No words: nothing."""
    short, digest = True, xxhash.xxh64_digest
    for words in simhash.pieces(text.lower(), width - 1):
        if len(words) >= width:
            short, joined = False, b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[: len(words) - width] + 1))
            yield np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]), ">u8")
    words = text.lower().split() if short else []
    if words:
        yield np.frombuffer(digest(b" ".join(words), 42), ">u8")


def both_fingerprints(text: bytes, width: int) -> tuple[int, bytes | None]:
    """SimHash (zero without words) and the wide fingerprint (null without words) of a text."""
    ones, total, first = np.zeros(64, np.int64), 0, np.full(POSITIONS, 2**32 - 1, np.uint32)
    for h in shingle_hashes(text, width):
        total += len(h)
        low = h.astype(np.uint32)
        for a in range(0, len(h), 1024):
            ones += np.unpackbits(h[a : a + 1024].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            np.minimum(first, (low[a : a + 1024, None] * ORDERS).min(axis=0), out=first)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big"), first.astype(np.uint8).tobytes() if total else None


def marked_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, fp, bytes): both fingerprints of each row of (doc_id, text), t a hash of the text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "text", 8 << 20):
            marks = [both_fingerprints(t or b"", width) for t in rows.column("text").cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array([m[0] for m in marks], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("t"), fp, pa.array([m[1] for m in marks], pa.binary())], ["doc_id", "t", "fp", "bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(of, "doc_id bigint, t bigint, fp bigint, bytes binary")


def positional(column: pa.Array) -> np.ndarray:
    return byte_runs(column)[0].reshape(-1, POSITIONS)


def tallied(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared): the number of positions at which the wide fingerprints of a pair agree."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            shared = (positional(rows.column("x")) == positional(rows.column("y"))).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(shared)], ["a", "b", "shared"])

    side = lambda name, wide: texts.select(F.col("t").alias(name), F.col("bytes").alias(wide))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(of, "a bigint, b bigint, shared int")


def shingle_sets(docs: DataFrame, texts: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """(t, shingles) for each text of (t): four bytes of the hash of each of its shingles, sorted, once each; the first
    `most` of them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "text", 4 << 20):
            made = [np.unique(np.concatenate([h.astype(np.uint32) for h in shingle_hashes(t or b"", width)] or [np.zeros(0, np.uint32)]))[:most].tobytes() for t in rows.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("t"), pa.array(made, pa.binary())], ["t", "shingles"])

    cut = docs.select(F.xxhash64("text").alias("t"), "text").join(texts, "t", "left_semi").mapInArrow(sets, "t bigint, shingles binary")
    return stored(cut.groupBy("t").agg(F.first("shingles").alias("shingles")))


def verified(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts, by their hashes, whose sets of shingles are alike by `similarity` or more. Only texts that
    are in a pair are cut into shingles; a set holds four bytes of each hash."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ok = []
            for x, y in zip(rows.column("x"), rows.column("y"), strict=True):
                common, whole = overlap(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32))
                ok.append(common >= similarity * whole)
            yield rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    known = shingle_sets(docs, stored(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()), width)
    side = lambda name, of: known.select(F.col("t").alias(name), F.col("shingles").alias(of))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint")


def overlap(one: np.ndarray, two: np.ndarray) -> tuple[int, int]:
    """What two sets have in common, and the size of both together."""
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common, len(one) + len(two) - common


def judged(one: np.ndarray, two: np.ndarray, similarity: float, most: int) -> bool | None:
    """If two sets are alike by `similarity`, given the `most` smallest hashes of each. Null: a set may go on beyond what is
    given, and the hashes up to there are no more than six deviations below."""
    cut = [s for s in (one, two) if len(s) >= most]
    if not cut:
        common, whole = overlap(one, two)
        return common >= similarity * whole
    last = min(s[-1] for s in cut)
    common, whole = overlap(*[s[: np.searchsorted(s, last, "right")] for s in (one, two)])
    return None if common >= similarity * whole - 6 * math.sqrt(whole * similarity * (1 - similarity)) else False


def met_across(mixed: DataFrame, least: int, similarity: float) -> DataFrame:
    """Pairs (a, b, sure) of different groups that share a list and at least `least` positional bytes, of rows (key, k, t,
    root, bytes, shingles, n), k the place of the list's bytes and n its members. A list is compared by pairs of blocks of
    about BLOCK members, so that no task holds one whole; a pair is looked at in the first list that it shares.

    Sure pairs are links: they are checked here, and of those of two blocks as many are given as join all groups that they
    link, fewer than the blocks have members. Texts of more than SKETCH shingles give pairs that are to be checked yet."""
    most = SKETCH

    def of(rows: pa.Table) -> pa.Table:
        i, j, k = (rows.column(c)[0].as_py() for c in ("i", "j", "k"))
        block, t, root = (rows.column(c).to_numpy().copy() for c in ("block", "t", "root"))
        wide = positional(rows.column("bytes"))
        data, ends = byte_runs(rows.column("shingles"))
        sets = [data[a:b].view(np.uint32) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        left, right, found = np.flatnonzero(block == i), np.flatnonzero(block == j), []
        for x in left.tolist():
            others = right[right > x] if i == j else right
            others = others[root[others] != root[x]]
            same = wide[others] == wide[x]
            first = same.reshape(len(same), POSITIONS // NAMED_BY, NAMED_BY).all(axis=2).argmax(axis=1)
            for y in others[(same.sum(axis=1) >= least) & (first == k)].tolist():
                if root[x] != root[y] and (sure := judged(sets[x], sets[y], similarity, most)) is not False:
                    found.append((min(t[x], t[y]), max(t[x], t[y]), bool(sure)))
                    if sure:
                        root[root == root[y]] = root[x]
        a, b, sure = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = mixed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("t", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    columns = ("key", "k", "t", "root", "bytes", "shingles", "block")
    spread = dealt.select(*columns, other).select(*columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return spread.groupBy("key", "i", "j").applyInArrow(of, "a bigint, b bigint, sure boolean")


def classes(marked: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(fp, root) for each SimHash fingerprint of `marked`: equal roots for texts that are linked.

    First each text is paired with the first text of one of its lists, the one with which it shares most bytes: one pair a
    text, however large a group. With the links of SimHash fingerprints these give groups; then all pairs of different
    groups that share a list are looked at, and there the tally alone says what is checked. What is checked and no link
    leaves no row, as there are as many such pairs as the square of a group of texts that are partly alike.
    """
    least = least_shared(similarity)
    texts = stored(marked.where("bytes IS NOT NULL").groupBy("t").agg(F.first("fp").alias("fp"), F.first("bytes").alias("bytes")))
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("bytes", 1 + NAMED_BY * k, NAMED_BY)) for k in range(POSITIONS // NAMED_BY)])
    index = texts.select("t", F.posexplode(keys).alias("k", "key"))
    first = F.min(F.struct(F.xxhash64("t", F.lit(3)).alias("h"), F.col("t").alias("head"))).alias("m")
    shared = stored(index.groupBy("key").agg(F.count("*").alias("n"), first).where("n > 1").select("key", "n", "m.head"))
    listed = stored(index.join(shared, "key"))

    heads = listed.where("t <> head").select(F.col("head").alias("a"), F.col("t").alias("b")).distinct()
    best = tallied(heads, texts).where(F.col("shared") >= least).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    fps = lambda name, of: texts.select(F.col("t").alias(name), F.col("fp").alias(of))
    close = verified(stored(best.select("a", "b")), docs, width, similarity)
    wide = close.join(fps("a", "x"), "a").join(fps("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    distinct = stored(marked.select("fp").distinct())
    roots = components(simhash.links(distinct).unionByName(wide))
    rooted = stored(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))

    placed = texts.join(rooted, "fp").select("t", "root", "bytes")
    several = listed.join(placed.select("t", "root"), "t").groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "n")
    members = stored(listed.select("key", "k", "t").join(stored(several), "key"))
    sketches = shingle_sets(docs, members.select("t").distinct(), width, SKETCH)
    across = stored(met_across(members.join(placed, "t").join(sketches, "t"), least, similarity))
    if across.isEmpty():
        return rooted
    place = lambda name, of: placed.select(F.col("t").alias(name), F.col("root").alias(of))
    close = across.where("sure").select("a", "b").unionByName(verified(across.where("NOT sure").select("a", "b"), docs, width, similarity))
    later = components(close.join(place("a", "x"), "a").join(place("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    return rooted.join(later.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left").select("fp", F.coalesce("whole", "root").alias("root"))


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of documents that are the first of their group, by doc_id (null last) and a hash of the text; of rows with
    equal id and text one stays, whichever. Groups are linked by sets of `width`-word shingles alike by `similarity` or
    more, and by SimHash fingerprints of these shingles at two bits or fewer.

    A text of fewer words is one shingle. Null texts, empty ones and those of white space are copies of each other and of
    nothing else. Long texts are read whole, an empty table gives no rows, other columns (of any name) come along.
    """
    own = f"key {uuid.uuid4().hex}"
    key = lambda t: F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), t.alias("t"))
    marked = stored(marked_rows(docs, width))
    keyed = marked.groupBy("fp", key(F.col("t")).alias("key")).agg(F.count("*").alias("n"))
    rooted = stored(keyed.join(classes(marked, docs, width, similarity), "fp").select("root", "key", "n"))
    firsts = rooted.groupBy("root").agg(F.min("key").alias("key"))
    gone = rooted.select("key").join(firsts.select("key"), "key", "left_anti").distinct()
    kept = docs.withColumn(own, key(F.xxhash64("text"))).join(gone.withColumnRenamed("key", own), own, "left_anti")
    repeated = stored(rooted.where("n > 1").join(firsts.select("key"), "key").select(F.col("key").alias(own)))
    if repeated.isEmpty():
        return kept.select(*[f"`{c}`" for c in docs.columns])
    copies = kept.join(repeated, own, "left_semi").dropDuplicates([own])
    return kept.join(repeated, own, "left_anti").unionByName(copies).select(*[f"`{c}`" for c in docs.columns])
