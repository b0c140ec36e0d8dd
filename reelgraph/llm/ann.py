"""Operator 9: nearest neighbours by balanced posting lists.

Balanced centroids are fitted on a bounded sample and linked in a graph that travels with each task. Every vector goes
into the list of its nearest centroid and, if it lies near a border, into those of others as well. A query walks the
graph to the nearest centroids and reads the lists whose distance is within a ratio, which is fitted on the sample too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts as parts_of
from .common import stored

#: Bounds of what is fitted on: vectors sampled, centroids. Mean number of vectors a centroid aimed at.
SAMPLE, MOST_CENTROIDS, LIST = 32_768, 4096, 25
#: No centroid is nearest to more than this many times its share of the sample, if its vectors can be told apart.
BALANCE = 2.0
#: Neighbouring lists are read together, about so many of them. A larger group of lists is cut into parts of about
#: PART entries, and so are the queries that read one group.
GROUP, PART, QUERIES = 16, 8192, 1024
#: A vector goes to at most COPIES lists, within 1 + BORDER times the nearest centroid's distance.
COPIES, BORDER = 6, 0.2
#: A query reads the lists within a ratio of the distance to its ANCHOR-th nearest centroid. The ratio is the one at
#: which TRIALS vectors of the sample find this share of their nearest in the sample; more vectors lie nearer.
ANCHOR, TRIALS, TARGET = 4, 256, 0.95
DEGREE, ENTRIES = 24, 48


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, for choosing lists only."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


@dataclass
class Graph:
    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Graph:
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        near = np.concatenate([np.argsort(distances(centroids[a : a + 512], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for a in range(0, n, 512)])
        # A few far links keep the graph in one piece.
        far = np.random.default_rng(3).integers(0, n, (n, min(4, n)))
        return cls(centroids, np.concatenate((near, far), axis=1), np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int)))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found for each row, nearest first, and their distances; -1 fills up.
        Best-first: in each step every row opens its nearest centroid that is not open yet."""
        if 4 * width >= len(self.centroids):  # a walk would open most of them
            dist = distances(x, self.centroids)
            ids = np.argsort(dist, axis=1, kind="stable")[:, :width]
            return ids, np.sqrt(np.take_along_axis(dist, ids, axis=1))
        rows, many = len(x), np.arange(len(x))[:, None]
        ids = np.broadcast_to(self.entries, (rows, len(self.entries)))
        dist = distances(x, self.centroids[self.entries])
        opened = np.zeros(ids.shape, bool)
        if ids.shape[1] < width:
            fill = width - ids.shape[1]
            ids, dist, opened = np.pad(ids, ((0, 0), (0, fill)), constant_values=-1), np.pad(dist, ((0, 0), (0, fill)), constant_values=np.inf), np.pad(opened, ((0, 0), (0, fill)), constant_values=True)
        while True:
            order = np.lexsort((ids, dist), axis=1)[:, :width]
            ids, dist, opened = ids[many, order].copy(), dist[many, order], opened[many, order].copy()
            waits = ~opened
            go = waits.any(axis=1)
            if not go.any():
                break
            best = waits.argmax(axis=1)
            opened[np.arange(rows)[go], best[go]] = True
            found = np.where(go[:, None], self.neighbours[ids[np.arange(rows), best]], -1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[(found[:, :, None] == ids[:, None, :]).any(axis=2)] = -1
            near = ((self.centroids[found] - x[:, None, :]) ** 2).sum(axis=2)
            near[found < 0] = np.inf
            ids, dist, opened = np.concatenate((ids, found), axis=1), np.concatenate((dist, near), axis=1), np.concatenate((opened, found < 0), axis=1)
        ids[~np.isfinite(dist)] = -1
        return ids, np.sqrt(dist)


def fit(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids, balanced: in all rounds but the last ones each centroid that is nearest to too many rows gives
    half of them to one that has the fewest."""
    sample = np.unique(sample, axis=0)
    random = np.random.default_rng(1)
    k = min(k, len(sample))
    centroids = sample[random.choice(len(sample), k, replace=False)]
    for turn in range(rounds):
        own = np.concatenate([distances(sample[a : a + 2048], centroids).argmin(1) for a in range(0, len(sample), 2048)])
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
        if turn < rounds - 2:
            large = np.flatnonzero(count > BALANCE * len(sample) / k)
            small = np.argsort(count, kind="stable")[: len(large)]
            rows = np.argsort(own, kind="stable")
            first = np.searchsorted(own[rows], large)
            for big, at, few in zip(large.tolist(), first.tolist(), small.tolist(), strict=True):
                if count[few] * BALANCE < count[big] and few != big:
                    centroids[few] = sample[rows[at + int(random.integers(count[big]))]]
    return np.unique(centroids, axis=0)


def lists_of(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists each vector goes to, its nearest centroid's first, then those about as near."""
    ids, dist = graph.search(x, min(2 * COPIES, len(graph.centroids)))
    ids, dist = ids[:, :COPIES], dist[:, :COPIES]
    return np.nonzero((ids >= 0) & (dist <= (1 + BORDER) * dist[:, :1]))[0], ids[(ids >= 0) & (dist <= (1 + BORDER) * dist[:, :1])]


def fitted_ratio(graph: Graph, sample: np.ndarray, k: int) -> float:
    """The distance ratio at which trial vectors find TARGET of their k nearest in the sample."""
    trials = sample[np.random.default_rng(2).permutation(len(sample))[:TRIALS]]
    dist = distances(trials, sample)
    near = np.argsort(dist, axis=1, kind="stable")[:, 1 : k + 1]  # not the vector itself
    if not near.size:
        return 1.0
    row, lists = lists_of(graph, sample[near.ravel()])
    far = np.sqrt(distances(trials, graph.centroids))
    anchor = np.partition(far, min(ANCHOR, far.shape[1]) - 1, axis=1)[:, min(ANCHOR, far.shape[1]) - 1]
    trial = np.repeat(np.arange(len(trials)), near.shape[1])
    need = np.full(near.size, np.inf)
    np.minimum.at(need, row, far[trial[row], lists] / np.maximum(anchor[trial[row]], 1e-30))
    return float(np.quantile(need, TARGET))


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vectors are whole: not null, no null or non-finite component, not zero, and of the
    commonest length (the shorter one in a tie)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.forall("v", lambda x: ~bad(x)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["size"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists_to_read(graph: Graph, x: np.ndarray, ratio: float, sizes: np.ndarray, entries: int) -> Iterator[np.ndarray]:
    """For each vector the lists within `ratio` times the distance of the ANCHOR-th nearest centroid, and further ones
    until they hold `entries` entries. The walk over the graph is widened until it reaches so far."""
    width, waiting, number = 8 * ANCHOR, np.arange(len(x)), len(graph.centroids)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
    while len(waiting):
        width = min(width, number)
        ids, dist = graph.search(x[waiting], width)
        dist = np.where(ids >= 0, dist, np.inf)
        inside = (dist <= ratio * dist[:, min(ANCHOR, width) - 1 :][:, :1]) | (np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1) - np.where(ids >= 0, sizes[ids], 0) <= entries)
        inside &= ids >= 0
        done = ~inside[:, -1] | (width == number)
        for row in np.flatnonzero(done).tolist():
            out[waiting[row]] = ids[row][inside[row]]
        waiting, width = waiting[~done], 4 * width
    yield from out


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, reach: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k nearest rows found.

    Nearness is Euclidean distance in double precision on the given vectors, ties go to the smaller vec_id; rows with
    the query's own id are no candidates. With k candidates or fewer all are returned. Rows that take no part (see
    taking_part) or have a null id are neither queries nor candidates. Repeated ids: each query id is asked once per
    different vector's row and an answer id counts once, with its smallest distance. An empty table gives no rows.
    `reach` sets the distance ratio; infinity reads every list, so that the result is exact.
    """
    rows = stored(taking_part(vectors))
    n = rows.count()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    # About SAMPLE rows: what is drawn in a task is all that leaves it.
    sample = matrix(rows.select("v").sample(min(1.0, SAMPLE / n), seed=1).toArrow().column("v"))
    graph = Graph.of(fit(sample, min(MOST_CENTROIDS, max(1, n // LIST))))
    ratio = fitted_ratio(graph, sample, k) if reach is None else reach
    # Near centroids share a group: their own nearest of a few centroids.
    heads = fit(graph.centroids, max(1, len(graph.centroids) // GROUP))
    group_of = distances(graph.centroids, heads).argmin(axis=1)
    number = len(graph.centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                row, lists = lists_of(graph, matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(group_of[lists], pa.int32()), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "bin", "vec_id", "v"])

    postings = stored(rows.mapInArrow(assign, "list int, bin int, vec_id bigint, v array<double>"))
    # At most MOST_CENTROIDS rows.
    sizes = np.zeros(number, np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                x = matrix(part.column("v"))
                take, bins, lists = [], [], []
                for i, read in enumerate(lists_to_read(graph, x, ratio, sizes, (k + 1) * COPIES)):
                    for g in np.unique(group_of[read]).tolist():
                        take.append(i)
                        bins.append(g)
                        lists.append(read[group_of[read] == g].tolist())
                take = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(lists, pa.list_(pa.int32())), part.column("vec_id").take(take), part.column("v").take(take)], ["bin", "lists", "query_id", "q"])

    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates().repartition(parts_of(rows.sparkSession), "vec_id")
    probes = stored(queries.mapInArrow(choose, "bin int, lists array<int>, query_id bigint, q array<double>"))
    asked = probes.groupBy("bin").agg(F.count("*").alias("asked"))
    parts = postings.groupBy("bin").agg(F.count("*").alias("size")).join(asked, "bin")
    parts = stored(parts.select("bin", F.ceil(F.col("size") / PART).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("blocks")))
    every_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = postings.join(parts, "bin").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("bin", "part", every_of("blocks").alias("block"), "list", "vec_id", "v")
    right = probes.join(parts, "bin").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("bin", every_of("parts").alias("part"), "block", "lists", "query_id", "q")

    def scan(there: pa.Table, asking: pa.Table) -> pa.Table:
        """The k nearest of each query in its own lists among these, exact distances."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if there.num_rows and asking.num_rows:
            order = np.lexsort((there.column("vec_id").to_numpy(), there.column("list").to_numpy()))
            lists, ids, v = there.column("list").to_numpy()[order], there.column("vec_id").to_numpy()[order], matrix(there.column("v"))[order]
            query, q, wanted = asking.column("query_id").to_numpy(), matrix(asking.column("q")), asking.column("lists").to_pylist()
            for a, own in enumerate(wanted):
                rows = np.flatnonzero(np.isin(lists, own) & (ids != query[a]))
                d = np.sqrt(((v[rows] - q[a]) ** 2).sum(axis=1))
                order = np.lexsort((ids[rows], d))
                # A vector may stand in several of the lists.
                best = order[np.sort(np.unique(ids[rows[order]], return_index=True)[1])[:k]]
                found.append((np.full(len(best), query[a]), ids[rows[best]], d[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    keys = ["bin", "part", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id bigint, vec_id bigint, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
