"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgraph.llm import decontam, langid, nearcopies, packing, suffix
from reelgraph.llm.common import lean, stored, table
from reelgraph.llm.queries import TOKENIZERS


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognisable language (no letter at all, less like any landmark of the classifier than held-out
    texts are, or nothing to learn from) go."""
    lean(spark)
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words a shingle, alike by 0.8 or more, or within two bits of SimHash) the first
    document by id stays; null ids come last, rows of one id are told apart by their texts. Empty texts are copies of each
    other; long ones are read whole."""
    lean(spark)
    return nearcopies.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur before are cut out of the texts; a document that is cut away whole goes.
    A character that a cut leaves in pieces goes with it; n_chars is that of the text left."""
    lean(spark)
    return suffix.cut_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own text holds a benchmark item go, with or without an id. Null and empty texts hold none; long ones
    are aligned whole, in windows."""
    lean(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens, a row for each piece. Null and empty texts are the end id alone, long ones
    are cut into pieces; rows that repeat an id stay apart."""
    lean(spark)
    return packing.pack_sequences(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Tokenizing, fingerprints and the models can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
