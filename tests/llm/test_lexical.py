"""Ranked search against a score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags]
    N, L = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = set(terms(text))
        scored = []
        for i, bag, n in bags:
            m = 50 + (50 * n * N) // L if L else 0
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in asked if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scored)[:k], 1)]
    return out


def shown(rows):
    return sorted(map(repr, rows))


def found(spark, docs, items, k=50):
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return [tuple(r) for r in lexical.search(a, spark.createDataFrame(items, "item_id long, text string"), k).select("item_id", "rank", "doc_id", "score").collect()]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = [f"w{int(draw.paretovariate(0.7)) % 500}" for _ in range(4000)] + ["Ünï", "İx", "中文", "A1b", "straße"]
    text = lambda n: draw.choice((" ", "_", "-\n", "\x7f ")).join(draw.choice(words) for _ in range(n))
    docs = [(k, text(draw.choice((0, 1, 5, 50, 400)))) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(70)] + [(None, docs[9][1]), (None, docs[9][1]), (9, docs[9][1]), (2000, None), (2001, "--- ___"), (2002, "w1 " * 30000)]
    items = [(k, text(draw.choice((1, 3, 20, 90, 300)))) for k in range(40)] + [(None, "w1 w2"), (3, "w3"), (3, "w3"), (50, ""), (51, None), (52, "nowhere"), (53, "W1 w1 É")]
    return docs, items


def test_agrees_with_a_score_of_every_document(spark, corpus):
    docs, items = corpus
    for k in (50, 3):
        assert shown(found(spark, docs, items, k)) == shown(plain(docs, items, k))


def test_blocks_of_any_size_and_items_in_turns(spark, corpus, monkeypatch):
    docs, items = corpus
    want = shown(plain(docs, items, 10))
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 4000)
    assert sum(len((t or "").encode()) for _, t in items) > 3 * 4000
    assert shown(found(spark, docs, items, 10)) == want


def test_masks_are_left_out_once_none_can_reach_the_best(corpus):
    draw = random.Random(4)
    weight = np.array([9000, 6000, 3000, 1000, 500, 200] * 20)
    masks = done = 0
    for size, cells in ((1000, 1 << 22), (1000, 5000), (1, 100)):
        lexical.CELLS, kept = cells, lexical.CELLS
        try:
            best, every = lexical.Best(10), []
            item = np.array(sorted(draw.sample(range(len(weight)), 90)))
            for start in range(0, 3 * size, size):
                pairs = sorted({(draw.randrange(size), draw.randrange(len(weight))) for _ in range(size * 12)})
                doc, term = map(np.array, zip(*pairs, strict=True))
                tf, length = np.array([draw.randrange(1, 9) for _ in pairs]), np.array([draw.randrange(50, 300) for _ in range(size)])
                block = lexical.Block(list(range(start, start + size)), length, doc, term, tf, weight, len(weight))
                a, b = block.search(item, best)
                masks, done = masks + a, done + b
                for d in range(size):
                    score = sum(int(weight[t]) * (10**9 * int(f) // (1000 * int(f) + 20 * int(length[d]))) for (x, t), f in zip(pairs, tf.tolist(), strict=True) if x == d and t in item) if size == 1 or start == 0 else None
                    every.append((score, start + d))
            if size == 1:
                assert [r[1] for r in best.rows] == [d for s, d in sorted(every, key=lambda r: (-r[0], r[1])) if s > 0]
        finally:
            lexical.CELLS = kept
    assert 0 < done < masks / 2


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "the cat"), (None, "lorem 1234"), (2, "le chat")], "item_id long, text string").withColumns({"rank": F.lit(1), "score": F.lit(2)})
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lexical.search(odd, items).select("item_id", "rank", "doc_id", "score").collect()
    assert shown(map(tuple, got)) == shown(plain(docs, [(r["item_id"], r["text"]) for r in items.collect()], 50))
    assert lexical.search(empty, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0
    assert lexical.search(odd, items.where("item_id = 9 OR text = 'none'")).count() == 0
