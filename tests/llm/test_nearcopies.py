import random

import numpy as np
import pytest

from reelgraph.llm import nearcopies, simhash


def shingles(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, changes, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def corpus(seed, lengths=(20, 60, 150, 400), bases=60):
    """Texts, some with edited copies at all likenesses, one passage that many otherwise different texts share, and copies
    of one text by the dozen."""
    rng = random.Random(seed)
    texts, passage = [], [f"p{k}" for k in range(60)]
    for _ in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice(lengths))]
        texts.append(words)
        for _ in range(3):
            texts.append(edited(words, rng.randint(1, max(1, len(words) // 25)), rng))
    for _ in range(40):
        texts.append(passage + [f"w{rng.randrange(5000)}" for _ in range(rng.randint(5, 60))])
    hot = [f"h{k}" for k in range(300)]
    texts += [edited(hot, rng.randint(1, 6), rng) for _ in range(60)]
    return [" ".join(w) for w in texts]


def test_hashes_and_fingerprints(monkeypatch):
    for text in corpus(3)[:30] + ["", " ", "One", "two  words\n"]:
        whole = nearcopies.both_fingerprints(text.encode(), 5)
        assert whole[0] == simhash.fingerprint(text.encode(), 5)
        got = [h for piece in nearcopies.shingle_hashes(text.encode(), 5) for h in piece.tolist()]
        assert len(set(got)) == len(shingles(text))
        monkeypatch.setattr(simhash, "PIECE", 25)
        assert whole == nearcopies.both_fingerprints(text.encode(), 5)
        monkeypatch.undo()


def test_bytes_are_shared_as_often_as_shingles():
    rng, gaps = random.Random(5), []
    for _ in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        one, two = " ".join(words), " ".join(edited(words, rng.randint(1, 8), rng))
        x, y = (np.frombuffer(nearcopies.both_fingerprints(t.encode(), 5)[1], np.uint8) for t in (one, two))
        gaps.append((x == y).mean() - likeness(shingles(one), shingles(two)))
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.06


@pytest.mark.parametrize("block", [512, 8])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = corpus(block)
    sets = [shingles(t) for t in texts]
    near = [(i, k, likeness(sets[i], sets[k])) for i in range(len(texts)) for k in range(i)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, k, s in near:
        if s >= 0.8:
            parent[find(i)] = find(k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in nearcopies.keep_one_of_each(df).collect()}
    want = {min(i for i in range(len(texts)) if find(i) == r) for r in set(map(find, range(len(texts))))}
    # One in some hundred pairs at the very bound may be missed; nothing that is like no other text goes.
    assert want <= kept and len(kept - want) <= len(texts) // 100
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        pairs = [(i, k) for i, k, s in near if low <= s < high]
        caught = sum(not {i, k} <= kept for i, k in pairs)
        print(f"{low} to {high}: {caught} of {len(pairs)}")
        assert len(pairs) > 20 and caught >= 0.99 * len(pairs)


def test_odd_rows(spark, odd, empty):
    kept = nearcopies.keep_one_of_each(odd)
    assert kept.schema == odd.schema
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 5, 5, 6, 8, 9, 10]
    assert not kept.where("doc_id IS NULL").count()
    assert nearcopies.keep_one_of_each(empty).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    say = lambda k: f"sentence number {k} of a text that is like no other, with {k * k} in it and {k * 7919} too"
    rows = [(1, say(1)), (1, say(2)), (1, say(1)), (None, say(3)), (None, say(3)), (None, say(4)), (None, say(2)), (2, say(1)), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in nearcopies.keep_one_of_each(df).collect()) == sorted([(1, say(1)), (1, say(2)), (0, say(3)), (0, say(4)), (3, "")])


def test_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Texts that are partly alike meet in many lists and reach the tally, but only SimHash links any."""
    pairs, stored = [], nearcopies.stored

    def counted(rows):
        kept = stored(rows)
        pairs.extend([kept.count()] if "b" in kept.columns else [])
        return kept

    monkeypatch.setattr(nearcopies, "stored", counted)
    passage = " ".join(f"p{k}" for k in range(260))
    texts = [(i, f"{passage} {' '.join(f'own{i}x{k}' for k in range(44))}") for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    sets = [shingles(t) for _, t in texts]
    assert 0.7 < likeness(sets[0], sets[1]) < 0.8
    fps = [simhash.fingerprint(t.encode(), 5) for _, t in texts]
    alone = {i for i, x in enumerate(fps) if sum((x ^ y).bit_count() <= 2 for y in fps) == 1}
    kept = {r["doc_id"] for r in nearcopies.keep_one_of_each(df).collect()}
    assert len(alone) > 100 and alone <= kept
    assert pairs and max(pairs) <= 5 * len(texts), pairs


@pytest.mark.parametrize("most", [24, 96])
def test_long_texts_are_sifted_by_their_smallest_hashes(spark, monkeypatch, most):
    texts = corpus(17)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    whole = {r["doc_id"] for r in nearcopies.keep_one_of_each(df).collect()}
    monkeypatch.setattr(nearcopies, "SKETCH", most)
    assert whole == {r["doc_id"] for r in nearcopies.keep_one_of_each(df).collect()}
    rng = np.random.default_rng(3)
    for share in rng.uniform(0.05, 1, 300):
        one, two = (np.unique(np.concatenate((rng.integers(0, 2**32, 2000, np.uint32), both))) for both in [rng.integers(0, 2**32, int(share * 40000), np.uint32)] * 2)
        common, every = nearcopies.overlap(one, two)
        got = nearcopies.judged(one[:most], two[:most], 0.8, most)
        assert got is not True and (got is None or common < 0.8 * every)
        assert nearcopies.judged(one, two, 0.8, 10**6) == (common >= 0.8 * every)
