"""Operator 2: toxicity of whole texts, after disguised words have been restored.

Restoration is a noisy channel: a word with digits, marks, stretched or spaced-out letters spans a lattice of what may
have been meant; the path that the channel and a character trigram model like best is taken (Viterbi). The model is
counted over all documents. A logistic regression over words and word beginnings scores the text with the restored
words added.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, runs_of, stored
from .words import Known, Words

#: Letters of the character model: blank, a-z, the Latin-1 letters, all others.
LETTERS = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
OTHER, SIZE = len(LETTERS), 64
CODES = {c: k for k, c in enumerate(LETTERS)}
#: What a sign may stand for in a disguised word.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Costs of the channel, as log probabilities: a sign for a letter, a mark left out, a digit or like sign left out, a
#: letter of three or more in a row left out.
SIGN, LEFT_OUT, LOST, STRETCHED = -1.0, -0.5, -8.0, -0.3
#: Words of one character in a row that may be a word spaced out.
LEAST_SPACED = 3
#: Signs after which what all paths share is settled; a longer word may be several.
LONGEST = 48
#: Bounds of what is learned from: labelled texts of each kind (about), and features.
SAMPLE, FEATURES, PREFIXES = 3000, 2000, (4, 5, 6)
#: A feature is looked at if it is in this many toxic texts of the sample, and so many times more often than in others.
LEAST_TEXTS, LEAST_RATIO = 4, 3.0
CACHED = 200_000
#: Accelerated gradient steps and ridge of the regression.
STEPS, RIDGE = 600, 1e-5


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return TABLE[np.minimum(points, 1023)]


TABLE = np.array([CODES.get(chr(k), OTHER if chr(k).isalpha() else 0) for k in range(1023)] + [OTHER], np.int64)


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of letters over all documents, whole texts: SIZE ** 3 numbers, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in runs_of(batches, "text"):
            c = codes_of(" ".join(t or "" for t in batch.column("text").to_pylist()))
            c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))] if len(c) else c
            # From each word's start on, the two letters before it count as blanks.
            one = np.concatenate(([0], c[:-1])) if len(c) else c
            two = np.where(one == 0, 0, np.concatenate(([0, 0], c[:-2]))[: len(c)]) if len(c) else c
            total += np.bincount(two * SIZE * SIZE + one * SIZE + c, minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out.reshape(SIZE, SIZE, SIZE)


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(letter | two before), interpolated with shorter contexts."""
    uni = counts.sum(axis=(0, 1)) + 1
    uni = uni / uni.sum()
    bi = (counts.sum(axis=0) + 5 * uni) / (counts.sum(axis=(0, 2))[:, None] + 5)
    tri = (counts + 5 * bi[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(tri).astype(np.float32)


def restore(word: str, model: np.ndarray, parted: bool = False) -> str:
    """The likeliest meant word, or, if `parted`, words: a word may then end behind any letter. Each sign may stand for a
    letter or for nothing, a repeated letter for one. No path is left out: a state is the last two letters of the model and
    the last one as it stands. Words of any length: behind every LONGEST signs the text so far is settled as far as all
    paths agree."""
    states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    settled: list[str] = []
    for at, sign in enumerate(word):
        if at and at % LONGEST == 0:
            # Only what all paths share is settled, so that none is cut short; the rest travels on.
            texts = [text for _, text in states.values()]
            common = len(os.path.commonprefix(texts))
            settled.append(texts[0][:common])
            states = {k: (cost, text[common:]) for k, (cost, text) in states.items()}
        if sign.isalpha():
            options = [(sign, 0.0)]
        else:
            options = [(c, SIGN) for c in LEET.get(sign, "")]
            options += [("", LOST if options else LEFT_OUT)]
        stretched = sign * 3 in word[max(0, at - 2) : at + 3]
        following: dict[tuple[int, int, str], tuple[float, str]] = {}
        for (two, one, last), (cost, text) in states.items():
            for c, extra in options:
                moves = [(two, one, last, cost + extra, text)] if not c else []
                if c:
                    k = CODES.get(c, OTHER)
                    moves = [(one, k, c, cost + extra + float(model[two, one, k]), text + c)]
                    if parted and one:
                        moves.append((0, k, c, cost + extra + float(model[two, one, 0]) + float(model[0, 0, k]), text + " " + c))
                    if c == last and stretched:
                        moves.append((two, one, last, cost + extra + STRETCHED, text))
                for a, b, c2, total, grown in moves:
                    if total > following.get((a, b, c2), (-math.inf,))[0]:
                        following[a, b, c2] = (total, grown)
        states = following
    best = max(((cost + float(model[two, one, 0]), text) for (two, one, _), (cost, text) in states.items()), default=(0.0, ""))
    return "".join(settled) + best[1]


def disguised(words: Words) -> np.ndarray:
    """Whether each blank-parted word has a sign before a letter, a digit or a letter's stand-in behind one (but "!", which
    ends words) or a letter three times running."""
    d = words.data
    letter = ((d >= 97) & (d <= 122)) | (d >= 128)
    digit = (d >= 48) & (d <= 57) | np.isin(d, [ord(c) for c in LEET if not c.isdigit() and c != "!"])
    mark = np.zeros(len(d) + 1, np.int64)
    if len(d) > 2:
        sign = ~letter & (d > 32)
        flag = np.zeros(len(d), bool)
        flag[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & digit[1:])
        flag[:-2] |= letter[:-2] & (d[:-2] == d[1:-1]) & (d[1:-1] == d[2:]) & (d[:-2] < 128)
        mark[1:] = np.cumsum(flag)
    return mark[np.maximum(words.ends - 1, words.starts)] - mark[words.starts] > 0


def spaced(words: Words) -> Iterator[tuple[int, str]]:
    """(text, letters) of runs of LEAST_SPACED or more words of one character each."""
    # By code points: a word has as many as it has bytes that don't continue one.
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    single = points[words.ends] - points[words.starts] == 1
    if not single.any():
        return
    step = np.diff(np.concatenate(([0], single.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        docs = words.doc[a:b]
        for k in np.unique(docs).tolist():
            own = np.flatnonzero(docs == k) + a
            if len(own) >= LEAST_SPACED:
                yield k, "".join(words.text(x) for x in own.tolist())


@dataclass
class Restorer:
    model: np.ndarray
    cache: dict[tuple[str, bool], str] = field(default_factory=dict)

    def __getstate__(self):
        return {"model": self.model, "cache": {}}

    def word(self, word: str, parted: bool = False) -> str:
        """A word longer than LONGEST may be several, joined by signs."""
        bare, parted = word.strip(".,;:!?\"'()[]{}*#&%"), parted or len(word) > LONGEST
        if len(word) > 4 * LONGEST:  # not kept: there are few, and they are large
            return restore(bare, self.model, parted)
        if len(self.cache) > CACHED:
            self.cache.clear()
        if (word, parted) not in self.cache:
            self.cache[word, parted] = restore(bare, self.model, parted)
        return self.cache[word, parted]

    def restored(self, texts: list[str | None]) -> list[str]:
        """For each text its disguised words as restored, joined by blanks."""
        words = Words(texts, table=None)
        found: list[set[str]] = [set() for _ in texts]
        for k in np.flatnonzero(disguised(words)).tolist():
            found[words.doc[k]].add(self.word(words.text(k)))
        for doc, letters in spaced(words):
            found[doc].add(self.word(letters, parted=True))
        return [" ".join(sorted(f)) for f in found]

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of words and word beginnings, each once a text, the restored words among them."""
        extra = self.restored(texts)
        words = Words([f"{t or ''} {e}" for t, e in zip(texts, extra, strict=True)])
        hashes = np.concatenate([words.full(), *(words.prefix(n) for n in PREFIXES)])
        return np.tile(words.doc, 1 + len(PREFIXES)), hashes


@dataclass
class Model:
    restorer: Restorer
    known: Known
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        doc, hashes = self.restorer.features(texts)
        at, row = self.known.find(hashes)
        both = np.unique(doc[at] * max(len(self.weights), 1) + row) if len(at) else at
        total = np.bincount(both // max(len(self.weights), 1), self.weights[both % max(len(self.weights), 1)], minlength=len(texts)) if len(at) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that are not held out: about SAMPLE of each kind, drawn by a hash of the id. The
    sample of labels is bounded, so it is sent to where the texts are. Without rows of both kinds all scores are that of
    the kind there is, and 0 without rows.

    A document with several labels is toxic if one says so.
    """
    restorer = Restorer(character_model(character_counts(docs)))
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    nothing = Model(restorer, Known(np.zeros(0, np.uint64)), np.zeros(0), 30.0 if set(n) == {1} else -30.0)
    if len(n) < 2:
        return nothing
    share = F.when(F.col("y") == 1, min(1.0, SAMPLE / n[1])).otherwise(min(1.0, SAMPLE / n[0]))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) / 1_000_000 < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text"):
            doc, h = restorer.features(batch.column("text").to_pylist())
            pairs = np.unique(np.stack((doc.astype(np.uint64), h), axis=1), axis=0)
            own = pairs[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), batch.column("y").take(pa.array(own)), pa.array(pairs[:, 1].view(np.int64))], ["doc_id", "y", "h"])

    seen = stored(texts.mapInArrow(hashes, "doc_id bigint, y int, h bigint"))
    size = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if len(size) < 2:
        return nothing
    counts = seen.where("h <> 0").groupBy("h").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    ratio = (F.col("a") / size[1]) / ((F.col("b") + 0.5) / size[0])
    chosen = counts.where((F.col("a") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).orderBy(F.desc(F.col("a") * F.log(ratio)), "h").limit(FEATURES).select("h")
    known = Known(np.array([r["h"] for r in chosen.collect()], np.int64).view(np.uint64))
    # At most SAMPLE rows of each kind with FEATURES places.
    held = seen.join(F.broadcast(chosen), "h").groupBy("doc_id", "y").agg(F.collect_set("h").alias("h")).collect()
    own = np.repeat(np.arange(len(held)), [len(r["h"]) for r in held])
    column = np.searchsorted(known.keys, np.array([h for r in held for h in r["h"]], np.int64).view(np.uint64))
    forth = lambda w: np.bincount(own, w[column], minlength=len(held))  # noqa: E731  texts times features
    back = lambda e: np.bincount(column, e[own], minlength=len(known.keys))
    y = np.array([r["y"] for r in held], float)
    # Texts without any feature are one row that stands for all of them.
    rest = {k: size[k] - int((y == k).sum()) for k in (0, 1)}
    # The sample has as many toxic as other texts; weights bring back the true shares.
    true = {k: n[k] / (n[0] + n[1]) / size[k] * (size[0] + size[1]) for k in (0, 1)}
    weight = np.where(y == 1, true[1], true[0])
    total = weight.sum() + rest[0] * true[0] + rest[1] * true[1]
    p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    curve = np.ones(len(known.keys))
    for _ in range(20):  # the largest curvature bounds the step
        curve = back(weight * forth(curve / max(np.linalg.norm(curve), 1e-9))) / total
    rate = 1 / (0.25 * (np.linalg.norm(curve) + 1) + RIDGE)
    w = ahead = np.zeros(len(known.keys) + 1)
    for step in range(STEPS):
        error = weight * (p(forth(ahead[:-1]) + ahead[-1]) - y)
        empty = rest[0] * true[0] * p(ahead[-1]) + rest[1] * true[1] * (p(ahead[-1]) - 1)
        slope = np.append(back(error) / total + RIDGE * ahead[:-1], (error.sum() + empty) / total)
        w, before = ahead - rate * slope, w
        ahead = w + step / (step + 3) * (w - before)
    w, b = w[:-1], w[-1]
    return Model(restorer, known, w, float(b))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of (doc_id, text): whole texts; null and empty ones have the score
    of a text without a telling word. Repeated rows and null ids are rows like others."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text"):
            score = np.round(model.scores(batch.column("text").to_pylist()), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs (doc_id, text), learned from labels (doc_id, toxic).

    Whole texts, however long. Null and empty texts have the score of a text without a telling word; repeated rows and
    null ids are rows like others; labels that are null, neither 0 nor 1 or of no document teach nothing. An empty table
    of documents gives no rows, one of labels scores of 0."""
    return judge(docs, train(docs, labels))
