"""Operator 6: training documents that hold a benchmark item, whole or edited.

Word n-grams of the items, with and without gaps, that are rare in the corpus are the seeds. A document with two seeds
of an item near each other, or one of a short item, is aligned with it by Smith-Waterman over words; the score is the
share of the item's best possible one. Items too short for a seed are found where a document is nothing but them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, runs_of, stored
from .words import Known, Words

GRAM = 3
#: Words of a seed, by their distance from its first one. The gaps find items of which every third word is changed.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Items of up to so many words need one seed, longer ones two in different places.
SHORT = 12
#: A seed is rare if it is in at most so many times as many documents as the item's median one, plus a few.
RARE, FEW = 4, 20
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Bytes of items that travel with a task; a larger benchmark is worked through in blocks of this size.
BLOCK_BYTES = 16 << 20
FOUND = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint, passage string"


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds that lie in one text, and the index of their first words."""
    h, hashes, places = words.full(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for turn, pattern in enumerate(PATTERNS):
        n = len(words.starts) - pattern[-1]
        if n <= 0:
            continue
        first = np.flatnonzero(words.doc[:n] == words.doc[pattern[-1] :])
        both = h[first] + np.uint64(turn)
        for k in pattern[1:]:
            both = both * np.uint64(0x9E3779B97F4A7C15) + h[first + k]
        hashes.append(mixed(both))
        places.append(first)
    return np.concatenate(hashes), np.concatenate(places)


class Items:
    """The items of one block: their words as hashes, and where each seed stands in them."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = Words([t for _, t in rows])
        edge = np.searchsorted(words.doc, np.arange(len(rows) + 1))
        self.hashes = np.split(words.full(), edge[1:-1])
        self.sizes = np.diff(edge)
        seeds, first = grams(words)
        self.item = words.doc[first]
        self.place = first - np.searchsorted(words.doc, self.item)
        self.known = Known(seeds)
        self.row = np.searchsorted(self.known.keys, seeds)
        #: Items without a seed, by all their words.
        self.tiny: dict[tuple[int, ...], list[int]] = {}
        for i in np.flatnonzero((self.sizes > 0) & (self.sizes < GRAM)).tolist():
            self.tiny.setdefault(tuple(self.hashes[i].tolist()), []).append(i)

    def keep_rare(self, counts: dict[int, int]) -> None:
        """Drops an item's seeds that are common beside its other ones. Every item keeps half of its seeds or more."""
        count = np.array([counts.get(int(k), 0) for k in self.known.keys.view(np.int64)], float)[self.row]
        order = np.lexsort((count, self.item))
        edge = np.flatnonzero(np.concatenate(([True], self.item[order][1:] != self.item[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
        # An item's middle count; the lower one of two.
        median = count[order][(edge[:-1] + edge[1:] - 1) // 2] if len(order) else count
        keep = np.zeros(len(order), bool)
        keep[order] = count[order] <= np.repeat(RARE * median + FEW, np.diff(edge)) if len(order) else keep
        seeds = self.known.keys[self.row[keep]]
        self.item, self.place, self.known = self.item[keep], self.place[keep], Known(seeds)
        row = np.searchsorted(self.known.keys, seeds)
        order = np.argsort(row, kind="stable")
        self.item, self.place = self.item[order], self.place[order]
        self.first = np.searchsorted(row[order], np.arange(len(self.known.keys) + 1))


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over word hashes: score as a share of the item's best, first and last word of the text's part.

    One row of the table is held at a time. A cell is the score and, below it in the same number, where its alignment
    began, earlier places being larger, so that of equal scores the earlier start is kept."""
    m, n = len(item), len(text)
    one = np.int64(1) << 32
    fresh = one - 1 - np.arange(n + 1, dtype=np.int64)  # score 0, beginning here
    slope = -GAP * one * np.arange(n + 1, dtype=np.int64)
    above, best, last = fresh.copy(), np.int64(0), 0
    for i in range(m):
        row = fresh.copy()
        row[1:] = np.maximum(row[1:], np.maximum(above[:-1] + np.where(text == item[i], MATCH * one, MISMATCH * one), above[1:] + GAP * one))
        above = np.maximum(np.maximum.accumulate(row + slope) - slope, fresh)
        j = int(above.argmax())
        if above[j] >> 32 > best >> 32:
            best, last = above[j], j
    return int(best >> 32) / (MATCH * m), int(one - 1 - (best & (one - 1))) if best else 0, last - 1


def seed_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each seed occurs: over all of them, whole texts. One row per seed reaches the driver."""
    known = items.known

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.keys), np.int64)
        for batch in runs_of(batches, "text"):
            words = Words(batch.column("text").to_pylist())
            seeds, first = grams(words)
            at, row = known.find(seeds)
            pairs = np.unique(words.doc[first[at]] * len(total) + row) if len(at) else at
            total += np.bincount(pairs % max(len(total), 1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.keys[some].view(np.int64)), pa.array(total[some])], ["seed", "n"])

    rows = docs.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    return {r["seed"]: r["n"] for r in rows.collect()}


def near(words: Words, items: Items, least: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, end) of the stretches to be aligned, by text and item.

    An alignment that scores `least` covers no more than `span` words. Hits that lie closer than that are one stretch,
    which is cut into windows of two spans, one span apart, so that each alignment lies in one of them."""
    seeds, first = grams(words)
    at, row = items.known.find(seeds)
    if not len(at):
        return
    n = items.first[row + 1] - items.first[row]
    hit = np.repeat(items.first[row] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    word, item, place = np.repeat(first[at], n), items.item[hit], items.place[hit]
    doc = words.doc[word]
    limits = np.searchsorted(words.doc, np.arange(words.doc[-1] + 2))
    order = np.lexsort((word, item, doc))
    word, item, place, doc = word[order], item[order], place[order], doc[order]
    size = items.sizes[item]
    span = np.ceil(size * (3 - 2 * min(least, 1))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > span[1:]))))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(word)], strict=True):
        if size[a] > SHORT and len(np.unique(place[a:b])) < 2:
            continue
        wide = int(span[a])
        low, high = max(int(limits[doc[a]]), int(word[a]) - wide), min(int(limits[doc[a] + 1]), int(word[b - 1]) + wide)
        for begin in range(low, max(high - wide, low + 1), wide):
            yield int(doc[a]), int(item[a]), begin, min(begin + 2 * wide, high)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row per document and item whose best alignment scores `least` or more: (doc_id, item_id, score, first_word,
    last_word, passage), the passage in lower-cased words, counted from 0.

    Null and empty texts and items hold nothing. An item of one or two words is found, with score 1, in the documents that
    have these words in this order and no others: as part of a longer text they tell nothing. A null doc_id is kept
    as null. Repeated rows give repeated rows. Empty tables give none. Texts of any length are aligned in windows, and
    an alignment holds one row of its table. The benchmark is read in blocks of bounded size (BLOCK_BYTES; one, for most
    benchmarks), each of which meets all documents; every document is aligned with every item it may hold, in its task.
    """
    return found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, least)


def found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    size = benchmark.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = 1 + size // BLOCK_BYTES
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for k in range(blocks):
        rows = sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        some = leaks_of_block(docs, Items(rows), least)
        out = some if out is None else out.unionByName(some)
    return out


def leaks_of_block(docs: DataFrame, items: Items, least: float) -> DataFrame:
    items.keep_rare(seed_counts(docs, items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text"):
            words = Words(batch.column("text").to_pylist())
            hashes = words.full()
            edges = np.searchsorted(words.doc, np.arange(batch.num_rows + 1))
            starts, sizes = edges[:-1], np.diff(edges)
            best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
            for doc, item, a, b in near(words, items, least):
                so_far = best.get((doc, item), (0.0,))[0]
                if so_far == 1.0:
                    continue
                score, first, last = align(items.hashes[item], hashes[a:b])
                if score >= least and score > so_far:
                    best[doc, item] = (score, a + first - int(starts[doc]), a + last - int(starts[doc]), a + first)
            for doc in np.flatnonzero((sizes > 0) & (sizes < GRAM)).tolist() if items.tiny else ():
                a, n = int(starts[doc]), int(sizes[doc])
                for item in items.tiny.get(tuple(hashes[a : a + n].tolist()), ()):
                    best[doc, item] = (1.0, 0, n - 1, a)
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[d], items.ids[i], s, f, e, " ".join(words.text(k) for k in range(w, w + e - f + 1))) for (d, i), (s, f, e, w) in sorted(best.items())]
            if out:
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.mapInArrow(search, FOUND)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of documents that hold no item. A text decides, not an id: rows without an id or with one that others
    have go if their own text holds an item, and only then."""
    own = f"text {uuid.uuid4().hex}"
    hashed = F.xxhash64("text")
    bad = stored(found(docs.select(hashed.alias("doc_id"), "text"), benchmark, least).select(F.col("doc_id").alias(own)).distinct())
    return docs.withColumn(own, hashed).join(bad, own, "left_anti").select(*[f"`{c}`" for c in docs.columns])
