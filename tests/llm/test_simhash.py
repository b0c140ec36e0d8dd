import random
import re

import xxhash
from pyspark.sql import functions as F

from reelgraph.llm import graph, simhash


def brute(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for k in range(i):
            if bin(fps[i] ^ fps[k]).count("1") <= 2:
                parent[find(i)] = find(k)
    roots = [find(i) for i in range(len(fps))]
    best = {}
    for r, i in zip(roots, ids, strict=True):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return [best.get(r) for r in roots]


def test_against_brute_force(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    fps = [brute(r["text"]) for r in rows]
    want = sorted((r["doc_id"] or -1, f"{f:016x}", c) for r, f, c in zip(rows, fps, smallest(fps, [r["doc_id"] for r in rows]), strict=True))
    assert got == want


def test_long_texts_in_pieces(monkeypatch):
    random.seed(7)
    texts = [b" ".join(random.choice([b"a", b"Bee", b"see\n", b"\t dee", b"x" * 90]) for _ in range(random.randint(0, 60))) for _ in range(80)]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 25)
    assert whole == [simhash.fingerprint(t) for t in texts] == [brute(t.decode()) for t in texts]


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_of_near_fingerprints(spark, monkeypatch):
    random.seed(1)
    fps = set()
    for _ in range(6):
        base = random.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in random.sample(range(64), k)) for k in (0, 1, 2, 3) for _ in range(12)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    want = smallest(fps, list(range(len(fps))))
    for most in (64, 1):  # short lists only; all lists long
        monkeypatch.setattr(simhash, "LONG_LIST", most)
        root = {r["node"]: r["root"] for r in graph.components(simhash.links(df)).collect()}
        roots = [root.get(simhash.signed(f), simhash.signed(f)) for f in fps]
        groups = {}
        for i, r in enumerate(roots):
            groups.setdefault(r, []).append(i)
        assert sorted(groups.values()) == sorted([i for i, w in enumerate(want) if w == k] for k in set(want))


def test_components_of_a_path(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = graph.components(edges).collect()
    assert len(out) == 300 and len({r["root"] for r in out}) == 1
    assert graph.components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, odd, empty):
    kept = simhash.keep_one_of_each(odd)
    assert kept.schema == odd.schema
    # Of the two texts under id 5 none is a copy; the cat's first row with an id is 6.
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 5, 5, 6, 8, 9, 10]
    assert not kept.where("doc_id IS NULL").count()
    assert simhash.near_duplicates(empty).count() == simhash.keep_one_of_each(empty).count() == 0


def test_rows_without_an_id_of_their_own_stay(spark):
    say = lambda k: f"sentence number {k} of a text that is like no other, with {k * k} in it and {k * 7919} too"
    rows = [(1, say(1)), (1, say(2)), (1, say(1)), (None, say(3)), (None, say(3)), (None, say(4)), (None, say(2)), (2, say(1)), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.keep_one_of_each(df).collect()) == sorted([(1, say(1)), (1, say(2)), (0, say(3)), (0, say(4)), (3, "")])
