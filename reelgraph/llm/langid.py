"""Operator 5: language of whole texts by a string kernel.

Kernel: the number of n-grams (1 to 4 bytes of the lower-cased text, hashed to BINS bins) that two texts share, each
counted once, over the root of the product of their own numbers. It is approximated by Nystrom features on landmark
texts; one ridge regression per language against the rest gives the scores. A block of texts is scored by two matrix
products: presence rows times landmarks, then kernel rows times weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, held_out, runs_of

BINS, GRAMS = 1 << 14, 4
#: Bounds of what is learned from: texts per language and in all (about), landmarks per language and in all.
SAMPLE, ALL_SAMPLE, LANDMARKS, ALL_LANDMARKS = 800, 16_000, 32, 256
RIDGE = 1.0
ROWS = 64
UNKNOWN = "und"
#: Likeness to the landmarks is taken piece by piece, as the n-grams of a long text would fill the bins.
PIECE = 4096
#: The least likeness of a known language: MARGIN times the likeness that all but SHARE of the held-out texts have, to one
#: of STEPS steps. With fewer than FEWEST such texts there is no bound.
SHARE, MARGIN, FEWEST, STEPS = 0.05, 0.55, 20, 10_000
#: A piece with fewer n-grams than VARIED times the root of its bytes repeats a few characters and is like nothing.
VARIED = 0.5


def presence(texts: list[bytes]) -> np.ndarray:
    """One row of BINS flags per text: which hashed n-grams it has."""
    flags = np.zeros(len(texts) * BINS, np.uint8)
    for k, text in enumerate(texts):
        mine = flags[k * BINS : (k + 1) * BINS]
        for a in range(0, len(text), 1 << 18):
            codes = np.zeros(0, np.uint32)
            data = np.frombuffer(text[a : a + (1 << 18) + GRAMS - 1], np.uint8).astype(np.uint32)
            for n in range(1, GRAMS + 1):
                if len(data) < n:
                    break
                codes = data if n == 1 else codes[:-1] << np.uint32(8) | data[n - 1 :]
                mine[(codes * np.uint32(0x9E3779B1) + np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)) >> np.uint32(18)] = 1
    return flags.reshape(len(texts), BINS)


def kernel(rows: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float32)
    own = np.maximum(rows.sum(axis=1), 1)
    return rows @ landmarks / np.sqrt(own)[:, None] / np.sqrt(sizes)[None, :]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # BINS x m, packed to bits
    sizes: np.ndarray
    weights: np.ndarray  # m x languages

    def scores(self, texts: list[bytes]) -> np.ndarray:
        dense = np.unpackbits(self.landmarks, axis=0, count=BINS).astype(np.float32) if not hasattr(self, "dense") else self.dense
        self.dense = dense
        return kernel(presence(texts), dense, self.sizes) @ self.weights

    def likeness(self, texts: list[bytes]) -> np.ndarray:
        """For each text the share of its n-grams (or of a landmark's, if those are fewer) that the most similar landmark
        has, less what chance alone would share: 0 by chance, 1 at most. The mean over its pieces by their bytes."""
        pieces = [(k, t[a : a + PIECE]) for k, t in enumerate(texts) for a in range(0, max(len(t), 1), PIECE)]
        of, size = np.array([k for k, _ in pieces], np.int64), np.array([len(t) for _, t in pieces], float)
        like = np.zeros(len(pieces))
        self.scores([])
        for a in range(0, len(pieces), ROWS):
            rows = presence([t for _, t in pieces[a : a + ROWS]]).astype(np.float32)
            own = rows.sum(axis=1)[:, None]
            least, chance = np.minimum(own, self.sizes), own * self.sizes / BINS
            alike = ((rows @ self.dense - chance) / np.maximum(least - chance, 1e-6)).max(axis=1)
            like[a : a + ROWS] = np.where(own[:, 0] < VARIED * np.sqrt(size[a : a + ROWS]), 0, np.clip(alike, 0, 1))
        return np.bincount(of, like * size, len(texts)) / np.maximum(np.bincount(of, size, len(texts)), 1)


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def train(docs: DataFrame) -> Model | None:
    """Learns from a sample of (doc_id, text, lang) that is bounded by SAMPLE per language: the rows that are not held
    out and have a lang and a letter, drawn by a hash of the id. None if there are no such rows."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, min(SAMPLE, ALL_SAMPLE / len(counts)) / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text", 4 << 20):
            packed = np.packbits(presence([lowered(t) for t in batch.column("text").to_pylist()]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([p.tobytes() for p in packed], pa.binary())], ["doc_id", "lang", "bits"])

    drawn = rows.where(draw < share).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    # About SAMPLE rows of BINS / 8 bytes per language.
    sample = sorted(drawn.mapInArrow(bits, "doc_id bigint, lang string, bits binary").collect(), key=lambda r: (r["lang"], r["doc_id"], r["bits"]))
    languages = sorted({r["lang"] for r in sample})
    label = np.array([languages.index(r["lang"]) for r in sample])
    flags = np.frombuffer(b"".join(r["bits"] for r in sample), np.uint8).reshape(len(sample), -1)
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    random = np.random.default_rng(7)
    chosen = np.concatenate([random.permutation(np.flatnonzero(label == k))[:each] for k in range(len(languages))])
    dense = np.unpackbits(flags[chosen], axis=1, count=BINS).astype(np.float32).T.copy()
    sizes = np.maximum(dense.sum(axis=0), 1)
    square = np.concatenate([kernel(np.unpackbits(flags[chosen[a : a + ROWS]], axis=1, count=BINS), dense, sizes) for a in range(0, len(chosen), ROWS)])
    values, vectors = np.linalg.eigh((square + square.T).astype(np.float64) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = np.concatenate([kernel(np.unpackbits(flags[a : a + ROWS], axis=1, count=BINS), dense, sizes) for a in range(0, len(flags), ROWS)]) @ root
    # Every language weighs the same, however many rows it has.
    weight = (len(label) / len(languages) / np.bincount(label, minlength=len(languages)))[label][:, None]
    target = (label[:, None] == np.arange(len(languages))).astype(np.float64)
    ridge = np.linalg.solve(features.T @ (weight * features) + RIDGE * np.eye(features.shape[1]), features.T @ (weight * target))
    return Model(languages, np.packbits(dense.astype(np.uint8), axis=0), sizes.astype(np.float32), (root @ ridge).astype(np.float32))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of (doc_id, text): `und`, score 0, for null texts and texts without a letter
    or if nothing was learned. Whole texts, however long; repeated rows and null ids are rows like others."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [k for k, t in enumerate(texts) if model and has_letter(t)]
            for a in range(0, len(known), ROWS):
                some = known[a : a + ROWS]
                s = np.clip(model.scores([lowered(texts[k]) for k in some]), 1e-6, None)
                best = s.argmax(axis=1)
                score[some] = np.round(s[np.arange(len(some)), best] / s.sum(axis=1), 6)
                for k, b in zip(some, best.tolist(), strict=True):
                    lang[k] = model.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predicted, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of (doc_id, text, lang): learned from the rows that are not held out,
    applied to all. Null ids are held out; null langs teach nothing; see `classify` for null, empty and repeated rows. An
    empty table gives no rows."""
    return classify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def least_likeness(docs: DataFrame, model: Model | None) -> float:
    """The least likeness of a known language, from all held-out rows that have a lang and a letter. Likenesses are counted
    in STEPS steps from 0 to 1, so that no task and no driver holds them all; each lang weighs the same up to SAMPLE rows or
    an equal part of ALL_SAMPLE, as its rows weigh less where it has more. 0 without a model or with too few rows."""

    def likenesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text", 4 << 20):
            like = model.likeness([lowered(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.floor(like * STEPS).astype(np.int64))], ["lang", "step"])

    if model is None:
        return 0.0
    rows = docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counted = rows.select("lang", "text").mapInArrow(likenesses, "lang string, step bigint").groupBy("lang", "step").agg(F.count("*").alias("n")).collect()
    counts: dict[str, int] = {}
    for r in counted:
        counts[r["lang"]] = counts.get(r["lang"], 0) + r["n"]
    if sum(counts.values()) < FEWEST:
        return 0.0
    weights = np.zeros(STEPS + 1)
    for r in counted:
        weights[r["step"]] += r["n"] * min(1.0, min(SAMPLE, ALL_SAMPLE / len(counts)) / counts[r["lang"]])
    return MARGIN * float(np.searchsorted(np.cumsum(weights), SHARE * weights.sum())) / STEPS


def keep_known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of documents whose language is known, with a score of `least` or more; their columns as they are.

    Every text is held against the model: its language is unknown if it has no letter or is less like the landmarks than
    `least_likeness`. A score compares languages only, so it can't tell this."""
    model = train(docs)
    like = least_likeness(docs, model)
    schema = docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            known = [k for k, t in enumerate(texts) if model and has_letter(t)]
            sure = []
            for a in range(0, len(known), ROWS):
                some = known[a : a + ROWS]
                lower = [lowered(texts[k]) for k in some]
                s = np.clip(model.scores(lower), 1e-6, None)
                good = (s.max(axis=1) / s.sum(axis=1) >= least) & (model.likeness(lower) >= like)
                sure += [k for k, x in zip(some, good.tolist(), strict=True) if x]
            yield batch.take(pa.array(sure, pa.int64()))

    return docs.mapInArrow(kept, schema)
