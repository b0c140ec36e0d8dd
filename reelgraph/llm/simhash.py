"""Operator 1: SimHash fingerprints, and near duplicates by an inverted index over their byte positions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of, stored
from .graph import components

#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of lower-cased (A-Z) words cut at ASCII white space, in shingles of `width` words, each as often as it occurs.
    A shorter text is one shingle; without words the fingerprint is zero."""
    ones, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    for words in pieces(text.lower(), width - 1):
        if len(words) < width:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(words) - width + 1]
        raw = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]), np.uint8).reshape(-1, 8)
        total += len(raw)
        for a in range(0, len(raw), 8192):
            ones += np.unpackbits(raw[a : a + 8192], axis=1).sum(axis=0, dtype=np.int64)
    if not total:
        words = text.lower().split()
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def pieces(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text in lists of about PIECE bytes; each list begins with the last `overlap` words before it."""
    at, tail = 0, []
    while at < len(text):
        blank = BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        words = tail + text[at:end].split()
        yield words
        at, tail = end, words[len(words) - overlap :] if overlap < len(words) else words


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, t, fp): one row per row of (doc_id, text), t a hash of the text; a null text has no words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "text", 8 << 20):
            fp = np.array([fingerprint(t or b"", width) for t in rows.column("text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("t"), pa.array(fp)], ["doc_id", "t", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(of, "doc_id bigint, t bigint, fp bigint")


#: Every pair of 64-bit fingerprints with 2 differing bits or fewer differs in at most 2 of 8 bytes, so ...
POSITIONS, MOST_BITS = 8, 2
#: ... it shares both byte pairs of at least one of these six choices of two out of four, ...
HALVES = [0xFFFF << 16 * i | 0xFFFF << 16 * k for i in range(4) for k in range(i)]
#: ... and at least this many of the four other bytes. A posting list holds the fingerprints that have a choice's four
#: bytes and one of the others at its position.
LEAST_SHARED = POSITIONS - MOST_BITS - 4
LISTS = [(choice, half | 0xFF << 8 * p) for choice, half in enumerate(HALVES) for p in range(POSITIONS) if not half >> 8 * p & 0xFF]
#: Longer posting lists are not paired up: their members meet at fingerprints one bit away, which is exact as well.
LONG_LIST = 64


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the given distinct fingerprints (fp) exactly as links at MOST_BITS bits or fewer do.

    For each pair that meets in posting lists of a choice, the lists are tallied: each stands for one byte shared beside
    the choice's four. A pair within MOST_BITS bits has LEAST_SHARED or more in some choice, or meets in a long list. In
    a long list a node may be a fingerprint that no document has: one with two or more members one bit away.
    """
    postings = F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bytes")) for k, (_, m) in enumerate(LISTS)]))
    index = distinct.select("fp", postings.alias("p")).select("fp", "p.*")
    sizes = stored(index.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    listed = stored(index.join(sizes, ["list", "bytes"]))

    short = listed.where(F.col("n") <= LONG_LIST)
    other = short.select("list", "bytes", F.col("fp").alias("b"))
    pairs = short.withColumnRenamed("fp", "a").join(other, ["list", "bytes"]).where("a < b")
    choice = F.element_at(F.array(*[F.lit(c) for c, _ in LISTS]), F.col("list") + 1)
    tallied = pairs.groupBy("a", "b", choice.alias("choice")).agg(F.count("*").alias("shared")).where(F.col("shared") >= LEAST_SHARED)
    near = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b").distinct()

    long = listed.where(F.col("n") > LONG_LIST)
    middles = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    # Of the 64 bits only those outside the shared five bytes can differ.
    free = F.filter(middles, lambda x: F.element_at(F.array(*[F.lit(signed(m)) for _, m in LISTS]), F.col("list") + 1).bitwiseAND(x) == F.col("bytes"))
    met = long.select("fp", F.explode(free).alias("middle")).distinct()
    busy = met.groupBy("middle").agg(F.count("*").alias("n")).where("n > 1").select("middle")
    stars = met.join(busy, "middle").select(F.col("fp").alias("a"), F.col("middle").alias("b"))
    return near.unionByName(stars)


def classes(marked: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint of `marked`: equal roots for linked ones."""
    distinct = stored(marked.select("fp").distinct())
    roots = components(links(distinct))
    return distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints at two bits or fewer. A null or empty text, or one
    of white space alone, has fingerprint zero and links like any other. Repeated rows are rows; a null doc_id gets its
    group's smallest known id, null if there is none. An empty table gives no rows. Equal fingerprints are merged before
    the index is built, so a group of copies counts once in it, and no group is ever gathered in one place.
    """
    marked = stored(fingerprints(docs, width))
    rooted = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")).join(classes(marked), "fp"))
    named = stored(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of documents that are the first of their group, by doc_id (null last) and a hash of the text; of rows
    with equal id and text one stays, whichever. No two groups share a text, so none is lost to a shared id."""
    key = lambda rows: F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), rows.alias("t"))
    marked = stored(fingerprints(docs, width).select("fp", key(F.col("t")).alias("key")))
    rooted = stored(marked.groupBy("fp", "key").agg(F.count("*").alias("n")).join(classes(marked), "fp").select("root", "key", "n"))
    firsts = rooted.groupBy("root").agg(F.min("key").alias("key"))
    gone = rooted.select("key").join(firsts.select("key"), "key", "left_anti").distinct()
    own = f"key {uuid.uuid4().hex}"
    kept = docs.withColumn(own, key(F.xxhash64("text"))).join(gone.withColumnRenamed("key", own), own, "left_anti")
    several = stored(rooted.where("n > 1").join(firsts.select("key"), "key").select(F.col("key").alias(own)))
    if several.isEmpty():
        return kept.select(*[f"`{c}`" for c in docs.columns])
    copies = kept.join(several, own, "left_semi").dropDuplicates([own])
    return kept.join(several, own, "left_anti").unionByName(copies).select(*[f"`{c}`" for c in docs.columns])
