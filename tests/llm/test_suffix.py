import hashlib
import random

import xxhash

from reelgraph.llm import suffix

FIELDS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows):
    """Row by row in the order of id, hash of text, place: each 100-byte string that starts earlier is removed."""
    hashed = lambda t: None if t is None else xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else hashed(r[1])))
    seen, out = set(), []
    for i, t in order:
        b = (t or "").encode()
        cut = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cut[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        spans = sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(bytes(c for c, g in zip(b, cut, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in suffix.remove_repeats(docs).select(FIELDS).collect()), key=str)


def test_against_brute_force(spark):
    random.seed(3)
    parts = ["".join(random.choice("abc ") for _ in range(random.choice([90, 99, 100, 101, 150, 400]))) for _ in range(30)]
    rows = [(i, "".join(random.choice(parts)[random.choice([0, 0, 1, 5]) :] for _ in range(random.randint(0, 8)))) for i in range(150)]
    rows += [(1000, "a" * 3000), (1001, "ab" * 900), (1002, ""), (1003, None), (None, parts[0] * 2), (1004, "é" * 60), (1005, "é" * 60), (1006, "x" * 99), (1007, "x" * 99), (1008, "x" * 100), (1009, "x" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)


def test_passage_before_many_texts(spark):
    """One seed with more kinds of runs in a task than it may have."""
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    passage = word(160)
    rows = [(i, word(40) + passage + word(90)) for i in range(2 * suffix.KINDS)] + [(900, "q" + passage[40:] + word(5)), (901, passage[:99]), (902, passage[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tuples = df.selectExpr("doc_id AS d", "0L AS t", "cast(text AS binary) AS text").mapInArrow(suffix.sample, suffix.TUPLES).where("at & 3 = 2")
    assert tuples.count() > suffix.KINDS
    assert got(df) == brute(rows)


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: no row loses what is only in it, copies go but one."""
    random.seed(6)
    word = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    twin, other, part = word(319), word(400), word(319)
    rows = [(1, twin), (1, twin), (1, other), (None, word(319) + part), (None, word(638)), (None, part), (None, twin[:200]), (None, other), (None, other), (2, part + part), (2, "short"), (2, "short"), (3, None), (3, None), (None, None)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert got(df) == brute(rows)
        left = sorted(r["text"] for r in suffix.cut_repeats(df).collect() if r["text"] is not None)
        assert left == sorted(r["kept"].decode() for r in suffix.remove_repeats(df).collect() if r["kept"] or not r["n_removed"])[-len(left) :] and other in left


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").where("length(text) < 1000 OR text IS NULL").collect()]
    df = odd.where("length(text) < 1000 OR text IS NULL")
    assert got(df) == brute(rows)
    long = {r["doc_id"]: r for r in suffix.remove_repeats(odd).where("doc_id <> 5").collect()}
    assert long[4]["n_removed"] == long[4]["n_bytes"] == 108000 and long[3]["n_bytes"] - long[3]["n_removed"] == 27
    assert suffix.remove_repeats(empty).count() == suffix.cut_repeats(empty).count() == 0


def test_cut_texts(spark, odd):
    out = suffix.cut_repeats(odd)
    assert out.schema == odd.schema
    left = out.collect()
    assert not [r for r in left if r["doc_id"] == 4] and len(left) == odd.count() - 2
    assert [r["n_chars"] for r in left if r["doc_id"] == 3] == [27]


def test_texts_are_shuffled_once(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    docs = spark.createDataFrame([(1, "a" * 150, "x"), (2, "b" + "a" * 150, "y")], "doc_id long, text string, lang string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for rows in (suffix.remove_repeats(docs), suffix.cut_repeats(docs)):
            assert rows.count() >= 1
            assert rows._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1
    finally:
        for k, value in old.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
