import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from reelgraph.llm import packing, tokenbin, tokens
from reelgraph.llm.queries import TOKENIZERS
from reelgraph.llm.tokens import encoder

FILES = [f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"]
TEXTS = [
    "", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\tb c", "I'll go,  we're", "<|endoftext|> hi", "a\u0301 b \u0301c", "1d10t i.d.i 12 34", "\n\nfoo\n\nbar", "\n", "ﬁ ß İI ΑΣ σ", "w\x1cx y", "a\u00a0b c\u2003d", "tail\n", "q \r\n w",
    "don't a's x'll. ..'s", "a_b c__ d² e", "a.\nB\n\nc d", "x.\n'll y", "中文 字。好 の, b", "e\u0301\u0301 x", "word*** word,!! x's", "a\u2028b c", "\x00 \U0001f600",
]


@pytest.mark.parametrize("file", FILES)
def test_ids_are_the_library_s(file):
    library = Tokenizer.from_file(file)
    assert [x.tolist() for x in encoder(file).encode(TEXTS)] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_a_hash_is_not_trusted(monkeypatch):
    """Words that share the first hash, in one block or with a cached word, get ids of their own."""
    for file in FILES:
        enc, library = tokens.WordEncoder(file), Tokenizer.from_file(file)
        monkeypatch.setattr(tokens, "mixed", lambda h: h & np.uint64(3))
        for texts in (["one two three", "four five", "", "six"], ["seven one", "eight two"]):
            assert [x.tolist() for x in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        monkeypatch.undo()


def test_very_long_text(spark):
    text = "".join(f"Some words {k} of a text.\n" for k in range(120_000))
    df = spark.createDataFrame([(1, "a"), (2, text), (3, "b")], "doc_id long, text string")
    got = sorted(tuple(r) for r in tokenbin.read_tokens(tokenbin.write_tokens(df, FILES[0])).collect())
    ids = ids_of(FILES[0], text)
    assert got[1] == (2, got[0][2], len(ids), crc(ids)) and got[2][1] == got[1][1] + len(ids)
    pieces = [r for r in packing.pack_sequences(df, FILES[1]).collect() if r["doc_id"] == 2]
    assert sum(r["length"] for r in pieces) == len(ids_of(FILES[1], text))


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 3 * tokenbin.BLOCK + 17).astype("<u4")
    payload, blocks = tokenbin.pack_blocks(ids, bits)
    assert len(payload) <= len(ids) * bits / 8 + len(blocks)
    for start, n in ((0, len(ids)), (5, 3), (tokenbin.BLOCK - 2, 5), (len(ids) - 1, 1), (2 * tokenbin.BLOCK, tokenbin.BLOCK), (9, 0)):
        assert (tokenbin.read_range(payload, blocks, bits, start, n) == ids[start : start + n]).all()


def ids_of(file, text):
    return Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_written_and_read(spark, odd, empty):
    got = [tuple(r) for r in tokenbin.read_tokens(tokenbin.write_tokens(odd, FILES[0])).collect()]
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    start, want = 0, []
    for r in rows:
        ids = ids_of(FILES[0], r["text"])
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenbin.read_tokens(tokenbin.write_tokens(empty, FILES[0])).count() == 0


def test_words_that_polynomial_hashes_cannot_tell_apart():
    """Words of two pieces in the order of Thue and Morse, and the same with the pieces changed for each other."""
    for path in FILES:
        coder = tokens.WordEncoder(path)
        for a, b in (("a", "b"), ("xy", "zw"), ("q", "q1-")):
            for n in (7, 8, 9, 10, 12):
                order = [bin(i).count("1") % 2 for i in range(1 << n)]
                one, two = ("".join((x, y)[o] for o in order) for x, y in ((a, b), (b, a)))
                texts = [f"see {one} end", f"see {two} end", one, two]
                assert [x.tolist() for x in coder.encode(texts)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packed_pieces(spark, odd, empty):
    rows = packing.pack_sequences(odd, FILES[1]).collect()
    docs = odd.select("doc_id", "text").collect()
    want = Counter((d["doc_id"], k, k * 2048, len(ids[k * 2048 : (k + 1) * 2048]), crc(ids[k * 2048 : (k + 1) * 2048])) for d in docs for ids in [ids_of(FILES[1], d["text"])] for k in range((len(ids) + 2047) // 2048))
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_sequences(empty, FILES[1]).count() == 0


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            k = bins.index(room)
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_loses_no_best_packing():
    for seed in range(800):
        random.seed(seed)
        capacity = random.choice([10, 20, 30])
        items = [random.randint(1, capacity) for _ in range(random.randint(0, 8))]
        fixed, left = packing.reduce_dominated(Counter(items), capacity)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == (fewest(items, capacity) if items else 0)
        assert len(packing.plan(Counter(items), capacity)) >= len(set(items))


def test_plan_does_not_grow_with_the_corpus():
    """Many pieces of each length: the plan has a few slots a length, and the reduction takes many of them at a time."""
    import time

    slots, took = [], []
    for copies in (3_000, 300_000):
        began = time.perf_counter()
        plan = packing.plan({length: copies + length % 7 for length in range(520, 700)})
        took.append(time.perf_counter() - began)
        slots.append(len(plan))
        assert (plan[:, 2] * plan[:, 3]).sum() == sum(copies + length % 7 for length in range(520, 700))
    assert slots[1] < 1.5 * slots[0] + 50 and took[1] < 3 * took[0] + 1
