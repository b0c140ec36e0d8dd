"""Ranked lexical search by presence masks.

Documents become postings of the terms that items ask for. A task takes blocks of documents; in a block, the bitmaps of an
item's terms give each document the mask of the terms it holds, and documents are grouped by mask. A mask's highest
possible score is the sum of its terms' highest scores in the block; masks are evaluated from the highest on, until none
can reach the item's k-th best document so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_runs, runs_of, stored

#: Bytes of item text that travel with the tasks at once; a longer list of items takes several turns.
BLOCK_BYTES = 16 << 20
#: Documents of a block, and cells (terms of an item by documents) that are laid out at once.
BLOCK, CELLS = 8192, 1 << 22
#: A term is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "row bigint, doc_id bigint, score bigint"


def term_lists(column: pa.Array) -> pa.ListArray:
    """The terms of each text as a list array of bytes, among empty ones where blanks follow each other."""
    data, offsets = byte_runs(column)
    texts = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes().translate(TERMS))])
    return pc.split_pattern(texts, b" ")


class Items:
    """Items as lists of rows in a table of distinct terms, once each."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        lists = term_lists(pa.array([t for _, t in rows], pa.string()))
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        filled = pc.greater(pc.binary_length(flat), 0)
        flat, parent = pc.filter(flat, filled), pc.filter(parent, filled).to_numpy()
        self.terms = pc.unique(flat)
        pairs = np.unique(parent * max(len(self.terms), 1) + pc.index_in(flat, self.terms).to_numpy())
        item, term = np.divmod(pairs, max(len(self.terms), 1))
        self.lists = np.split(term, np.searchsorted(item, np.arange(1, len(rows)))) if rows else []


def index(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(doc_id, n, terms, tfs): of each document the number of all its terms, and those of `terms` that it holds, by their
    place in it, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text"):
            lists = term_lists(batch.column("text"))
            flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
            n = np.bincount(parent[pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)], minlength=len(lists))
            place = pc.index_in(flat, terms)
            held = place.is_valid().to_numpy(zero_copy_only=False)
            pairs, tf = np.unique(parent[held] * max(len(terms), 1) + place.drop_null().to_numpy(), return_counts=True)
            doc, term = np.divmod(pairs, max(len(terms), 1))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(lists) + 1)), pa.int32())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Best:
    """The k best documents of an item so far: highest scores first, equal ones by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """Documents that score less can't come in."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        new = [(s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s >= self.least]
        if new:
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


class Block:
    """Postings of some documents, by term, with what each adds to a score."""

    def __init__(self, ids: list[int | None], length: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, terms: int):
        """length: the m of each document; doc, term, tf: the postings; weight: by term."""
        self.ids, self.size = ids, len(ids)
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
        self.first = np.searchsorted(term, np.arange(terms + 1))
        self.adds = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * length[self.doc]))
        self.most = np.zeros(terms, np.int64)
        np.maximum.at(self.most, term, self.adds)

    def search(self, terms: np.ndarray, best: Best) -> tuple[int, int]:
        """Offers the block's documents for an item; returns how many masks there are and how many were evaluated."""
        most = self.most[terms]
        if most.sum() < best.least:
            return 0, 0
        count = self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(count)
        posting = np.arange(ends[-1]) + np.repeat(self.first[terms] - (ends - count), count)
        row, doc, adds = np.repeat(np.arange(len(terms)), count), self.doc[posting], self.adds[posting]
        masks = done = 0
        step = max(1, CELLS // len(terms))
        for low in range(0, self.size, step):
            inside = slice(None) if step >= self.size else (doc >= low) & (doc < low + step)
            a, b = self.search_masks(row[inside], doc[inside] - low, adds[inside], most, self.ids[low : low + step], best)
            masks, done = masks + a, done + b
        return masks, done

    def search_masks(self, row: np.ndarray, doc: np.ndarray, adds: np.ndarray, most: np.ndarray, ids: list[int | None], best: Best) -> tuple[int, int]:
        """The same for postings (row of the item's terms, document, what it adds) of some documents."""
        # A bitmap a term; read across, the bits of a document are its mask.
        bits = np.zeros((len(most), len(ids)), bool)
        bits[row, doc] = True
        packed = np.packbits(bits, axis=0)
        wide = np.zeros((len(ids), -(-len(packed) // 8) * 8), np.uint8)
        wide[:, : len(packed)] = packed.T
        words = wide.view(np.uint64)
        order = np.lexsort(words.T)
        fresh = np.concatenate(([True], (words[order[1:]] != words[order[:-1]]).any(axis=1)))
        at = np.append(np.flatnonzero(fresh), len(ids))
        bound = most @ bits[:, order[at[:-1]]]
        score = np.zeros((len(most), len(ids)), np.int64)
        score[row, doc] = adds
        done = 0
        for group in np.argsort(-bound, kind="stable").tolist():
            if bound[group] < best.least:
                break
            members = order[at[group] : at[group + 1]]
            best.offer(score[:, members].sum(axis=0), [ids[d] for d in members.tolist()])
            done += 1
        return len(at) - 1, done


def blocks(batches: Iterator[pa.RecordBatch], docs: int, per_document: int, weight: np.ndarray, size: int) -> Iterator[Block]:
    """Blocks of `size` documents of an index; docs and per_document are N and L, of which a document's m follows."""
    held: list[pa.RecordBatch] = []

    def block() -> Block:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("terms").combine_chunks()
        n = rows.column("n").to_numpy()
        length = 50 + (50 * n * docs) // per_document
        doc = pc.list_parent_indices(lists).to_numpy()
        tf = pc.list_flatten(rows.column("tfs").combine_chunks()).to_numpy()
        return Block(rows.column("doc_id").to_pylist(), length, doc, pc.list_flatten(lists).to_numpy(), tf, weight, len(weight))

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, size - sum(b.num_rows for b in held))
            at += some.num_rows
            held.append(some)
            if sum(b.num_rows for b in held) == size:
                yield block()
                held = []
    if held:
        yield block()


def best_of_tasks(indexed: DataFrame, items: Items, docs: int, terms_in_all: int, weight: np.ndarray, k: int, size: int = BLOCK) -> DataFrame:
    """(row, doc_id, score): the k best documents of each item among those of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.ids]
        for block in blocks(batches, docs, terms_in_all, weight, size):
            for terms, mine in zip(items.lists, best, strict=True):
                if len(terms):
                    block.search(terms, mine)
        for row, mine in enumerate(best):
            if mine.rows:
                scores, ids = zip(*mine.rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["row", "doc_id", "score"])

    return indexed.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(run, FOUND)


def search(docs: DataFrame, benchmark: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents that score highest, equal scores by id, ranked from 1.

    Null and empty texts have no terms: such documents score nothing and are not counted in N; such items find nothing.
    Documents that repeat an id are documents of their own, a null id comes last among equals; items that repeat an id
    have a list each, and a null item_id is kept. Empty tables give no rows. Further columns are left. Texts of any
    length are read whole, once. Items are taken in blocks of bounded size (BLOCK_BYTES; one, for most benchmarks), each
    of which is searched in all documents; their terms, and a row per term, are what reaches the driver and the tasks.
    """
    size = benchmark.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    turns = 1 + size // BLOCK_BYTES
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    out = None
    for turn in range(turns):
        some = asked.where(F.pmod(F.xxhash64("text"), F.lit(turns)) == turn)
        items = Items([(r["item_id"], r["text"]) for r in some.collect()])
        found = search_block(docs, items, k)
        out = found if out is None else out.unionByName(found)
    return out


def search_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    indexed = stored(index(docs, items.terms))
    total = indexed.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = np.zeros(len(items.terms), np.int64)
    for r in indexed.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total["N"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    each = best_of_tasks(indexed, items, total["N"], max(total["L"], 1), weight, k)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame(list(enumerate(items.ids)), "row bigint, item_id bigint")
    best = each.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same in SQL for DuckDB.
SQL = r"""WITH lower AS (SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents UNION ALL SELECT 'i', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
terms AS (SELECT kind, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower),
postings AS (SELECT id AS doc_id, term, count(*)::BIGINT AS tf FROM terms WHERE kind = 'd' GROUP BY 1, 2), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY 1),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY 1) x, total),
asked AS (SELECT DISTINCT id AS item_id, term FROM terms WHERE kind = 'i'),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0) x WHERE rank <= 50"""
