"""Fill-in-the-middle against a plain version."""

import hashlib
import re

from pyspark.sql import functions as F

from reelgraph.llm import fim, queries

from ..conftest import DATA

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    assert prefix + middle + suffix == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def shown(rows):
    return sorted(map(repr, rows))


def test_agrees_with_the_plain_version(spark):
    texts = ["", None, " ", "\t\n ", "a", " a", "a ", "a b  c\n\nd ", "x<P>y", "<S>", "<M", "<<", "<P", "S> a <", "é ñ x  y", "中文 \U0001f600 z", "\x1c \x0b\x0c a", "\x00 \x00", "ab " * 70000, "x" * 200000, " " * 100000, "<" * 50 + " " + "<" * 50]
    rows = [(None if k == 50 else k, t) for k, t in enumerate(texts * 12)] + [(7, "twice here"), (7, "twice here"), (7, "other text with id seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for given in ({}, {"seed": 7, "rate": 100, "spm_rate": 30}):
        out = fim.fill_in_middle(docs, **given).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert shown(tuple(r)[:6] for r in out) == shown((i, *plain(i, t, **given)) for i, t in rows)
        assert shown((r["doc_id"], r["back"]) for r in out) == shown((i, t or "") for i, t in rows)


def test_odd_rows(odd, empty):
    out = fim.fill_in_middle(odd).collect()
    assert shown(tuple(r) for r in out) == shown((r["doc_id"], *plain(r["doc_id"], r["text"])) for r in odd.collect())
    assert fim.fill_in_middle(empty).count() == 0


def test_query_of_all_documents(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r["doc_id"]: (*(p := plain(r["doc_id"], r["text"]))[:4], sha(p[4]), sha(r["text"] or "")) for r in docs}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_fill_in_middle(spark, DATA).collect()}
    assert got == want and {w[1] for w in want.values()} == {"plain", "psm", "spm"}
