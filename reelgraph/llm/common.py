"""What the operators of this subpackage share: input columns, shared tables, batches."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and a Python worker: texts are long, and a worker holds a batch and its results.
BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> None:
    """Sets this session's Arrow batches to BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is unset, a new one if Spark runs in one process
    (tests), else an error: no other folder is known to be shared."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: the lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model learns from: crc32 of the id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(crc_of_id(doc_id) % 5 == 0, F.lit(True))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most `most` bytes; a single longer row is a run of its own."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def byte_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts have at most `most` bytes together, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_runs(batch.column(text))
        for a, b in groups(np.diff(offsets), most):
            yield batch.slice(a, b - a)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def chain(lists):
    return list(itertools.chain.from_iterable(lists))


#: The first n bytes of a little-endian number, by n.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words up to so many bytes are hashed as numbers of eight bytes, longer ones singly.
PACKED = 24


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each byte range. They share no algebra that the bytes could be chosen by, as those of RangeHash do:
    short ranges are mixed eight bytes at a time, each time anew; long ones go through XXH64 with two seeds."""
    padded = np.concatenate((data, np.zeros(PACKED + 8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, 0, (1,))
    size = ends - starts
    one, two = size.astype(np.uint64) + np.uint64(11), size.astype(np.uint64) + np.uint64(13)
    with np.errstate(over="ignore"):
        for at in range(0, PACKED, 8):
            piece = eight[np.minimum(starts + at, len(eight) - 1)] & LOW_BYTES[np.clip(size - at, 0, 8)]
            one, two = mixed(one + piece) * np.uint64(0xC2B2AE3D27D4EB4F), mixed(two ^ piece) * np.uint64(0x165667B19E3779F9)
    for k in np.flatnonzero(size > PACKED).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        one[k], two[k] = xxhash.xxh64_intdigest(word, seed=11), xxhash.xxh64_intdigest(word, seed=13)
    return one, two


#: Powers that a worker keeps between calls; those for longer buffers are made anew.
KEPT_POWERS = 1 << 21


class RangeHash:
    """64-bit polynomial hashes of any byte ranges of a buffer, each in constant time after one pass over it."""

    powers = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray, seed: int = 1):
        """Hashes of different seeds number the bytes differently but share base and modulus: ranges of 128 bytes and more
        can be made up (of two pieces in the order of Thue and Morse) that agree in all of them. See word_hashes."""
        n = len(data)
        power, inverse = self.powers
        if len(power) < n + 1:
            base = int(random_words(1, 1)[0]) | 5
            size = max(n + 1, 1 << 16)
            power, inverse = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
            power[0] = inverse[0] = 1
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            if size <= KEPT_POWERS:
                RangeHash.powers = power, inverse
        letter, self.inverse = random_words(seed + 1, 256), inverse
        self.sums = np.zeros(n + 1, np.uint64)
        terms = letter[data]
        terms *= power[:n]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def every(self, width: int) -> np.ndarray:
        """The hash of each range of `width` bytes, by its start."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)
