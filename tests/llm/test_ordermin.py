"""Order MinHash against a plain version."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from reelgraph.llm import ordermin, queries

from ..conftest import DATA


def plain(text, k, size, orders):
    """Tuples of k-mers by order, from the same hashes: all k-mers are ranked for each order."""
    hashes, _ = ordermin.numbered(text, k)
    seen, numbers = {}, []
    for i in range(len(hashes)):
        kmer = text[i : i + k]
        numbers.append(seen.get(kmer, 0))
        seen[kmer] = numbers[-1] + 1
    with np.errstate(over="ignore"):
        rank = ordermin.mixed(hashes + np.array(numbers, np.uint64) * np.uint64(0xA24BAED4963EE407)).tolist()
    out = []
    for j in range(orders):
        first = sorted(range(len(rank)), key=lambda i: (rank[i] - j * (2**64 // orders)) % 2**64)[:size]
        out.append(tuple(text[i : i + k] for i in sorted(first)))
    return out


def test_signature_is_that_of_ordered_minimal_kmers():
    draw = random.Random(5)
    texts = [bytes(draw.choice(b"ab ") for _ in range(n)) for n in (1, 7, 12, 13, 40, 300)] + [b"x" * 500, bytes(draw.randrange(256) for _ in range(9000)), b"the cat sat on the mat " * 30]
    for orders, size in ((8, 2), (16, 3)):
        tuples, hashes = {}, {}
        for t in texts:
            want, got = plain(t, 12, size, orders), ordermin.signature(t, 12, size, orders)
            assert len(got) == orders
            for w, g in zip(want, got.tolist(), strict=True):
                assert tuples.setdefault(w, g) == g
                hashes.setdefault(g, set()).add(w)
        # 16 bits seldom stand for two tuples.
        assert sum(len(h) > 1 for h in hashes.values()) <= 2
    assert not ordermin.signature(b"").any()


def test_sensitive_to_order_and_repeats():
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(600)]
    text = " ".join(words)
    like = lambda a, b: float((ordermin.signature(a.encode()) == ordermin.signature(b.encode())).mean())
    turned = " ".join(words[300:] + words[:300])
    shuffled = " ".join(draw.sample(words, 600))
    edited = " ".join(words[:200] + ["zzzzzz"] + words[201:])
    assert like(text, text) == 1 and like(text, edited) > 0.8 > 0.75 > like(text, turned) > like(text, shuffled)
    # Twice the text has the same set of k-mers (but for those at the seam), numbered anew.
    assert like(text, text + " " + text) < 0.6


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    """rows: (doc_id, text) in order."""
    out = []
    for k, (i, text) in enumerate(rows):
        third, after = len(text) // 3, rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - third] + after[:third]
        a, b, c = (ordermin.signature(t.encode()) for t in (text, edited, after))
        hexed = lambda x: "".join(f"{v:04x}" for v in x.tolist())
        out.append((i, len(text), sha(edited), hexed(a), hexed(b), float((a == b).mean()), float((a == c).mean())))
    return out


def shown(rows):
    return sorted(map(repr, rows))


def digests(df):
    like = lambda c: ordermin.likeness(F.col("fingerprint"), F.col(c))
    return [tuple(r) for r in df.select("doc_id", "n_chars", F.sha2("edited", 256), "fingerprint", "edited_fingerprint", like("edited_fingerprint"), like("next_fingerprint")).collect()]


def test_query_of_all_documents(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()), reverse=True)
    got = [tuple(r) for r in queries.op12_order_minhash(spark, DATA).collect()]
    assert shown(got) == shown(expected(docs))
    long = [r for r in got if r[1] > 3000]
    assert sum(r[5] for r in long) / len(long) > 0.2 > 0.1 > sum(r[6] for r in long) / len(long)


def test_ranges_of_ids_with_gaps(spark):
    draw = random.Random(8)
    ids = draw.sample(range(-(10**12), 10**12), 300) + list(range(100)) + [2**63 - 1, -(2**63)]
    rows = [(i, "".join(draw.choice("abc é") for _ in range(draw.randrange(60)))) for i in ids]
    want = expected(sorted(rows, reverse=True))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert shown(digests(ordermin.edited_by_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))) == shown(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_id_that_most_rows_have(spark):
    """Nulls, repeated rows and an id that holds most rows: by id, then by the hash of the text."""
    rows = [(7, f"text number {k % 150} of id seven") for k in range(300)] + [(None, "a"), (None, None), (None, "a")] + [(k, "b" * k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((r["doc_id"], r["text"] or "", r["h"]) for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        rows = ordermin.ranged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 16)
        assert rows.groupBy("range", "slice").count().agg(F.max("count")).first()[0] < 60
        assert shown(digests(ordermin.edited_by_next(docs))) == shown(expected([r[:2] for r in order]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, odd, empty):
    order = sorted(((r["doc_id"], r["text"] or "", r["h"]) for r in odd.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    assert shown(digests(ordermin.edited_by_next(odd))) == shown(expected([r[:2] for r in order]))
    assert ordermin.edited_by_next(empty).count() == 0
    one = spark.createDataFrame([(1, "a single document by itself")], "doc_id long, text string")
    assert shown(digests(ordermin.edited_by_next(one))) == shown(expected([(1, "a single document by itself")]))
    marked = ordermin.fingerprinted(odd, "text").collect()
    assert all(r["fingerprint"] == "".join(f"{v:04x}" for v in ordermin.signature((r["text"] or "").encode()).tolist()) for r in marked)
