"""Operator 7: token ids in a fixed-width binary format.

A *shard* is one row of a Parquet table and holds a run of documents in ascending doc_id order. Its ids are stored in
the fewest bits that hold every id of the vocabulary, in blocks of `BLOCK` ids. A block starts on a byte of its own, so
the place of id i is found by arithmetic from its block's offset, and a block is unpacked by one numpy expression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_runs, groups, parts, stored
from .tokens import encoder

BLOCK = 65_536
SHARD = "shard bigint, part int, number int, bits int, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, blocks array<bigint>, payload binary"
#: Text bytes of a shard; a single longer document is a shard of its own.
SHARD_BYTES = 8 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids, `bits` bits each, lowest bit first; the last byte is filled with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """n ids from the `skip`-th on."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, 2 * skip).astype("<u4")
    first = skip * bits
    raw = np.frombuffer(data, np.uint8)[first // 8 : (first + n * bits + 7) // 8]
    flat = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + n * bits].reshape(n, bits)
    return (flat.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


def block_bytes(bits: int) -> int:
    return (BLOCK * bits + 7) // 8


def pack_blocks(ids: np.ndarray, bits: int) -> tuple[bytes, list[int]]:
    blocks = [pack(ids[a : a + BLOCK], bits) for a in range(0, len(ids), BLOCK)]
    return b"".join(blocks), np.cumsum([0] + [len(b) for b in blocks])[:-1].tolist() if blocks else []


def read_range(payload: bytes, blocks: list[int], bits: int, start: int, n: int) -> np.ndarray:
    """Random access: ids start .. start + n of a shard; only the blocks they are in are touched."""
    out = []
    while n > 0:
        k, inside = divmod(start, BLOCK)
        take = min(n, BLOCK - inside)
        out.append(unpack(payload[blocks[k] : blocks[k] + block_bytes(bits)], bits, take, inside))
        start, n = start + take, n - take
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, vocabulary: int | None = None) -> DataFrame:
    """The written shards of (doc_id, text), as a table in the shared folder.

    Documents are dealt by ranges of doc_id, so shards in the order of (part, number) hold ascending ids. A null text
    is empty: its document is the end id alone. A null doc_id comes first. Repeated ids stay separate, side by side,
    the smaller text first. An empty table gives no shard. A text reaches one task once, whole.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        bits = max(1, int((vocabulary or enc.library.get_vocab_size()) - 1).bit_length())
        end = np.array([end_id], np.uint32)
        for batch in batches:
            _, offsets = byte_runs(batch.column("text"))
            for a, b in groups(np.diff(offsets), SHARD_BYTES):
                rows = batch.slice(a, b - a)
                coded = enc.encode([t or "" for t in rows.column("text").to_pylist()])
                payload, blocks = pack_blocks(np.concatenate([x for ids in coded for x in (ids, end)]), bits)
                lengths = [len(x) + 1 for x in coded]
                row = [(part << 32) + number, part, number, bits, sum(lengths), rows.column("doc_id").to_pylist(), lengths, blocks, payload]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES, strict=True)], NAMES)
                number += 1

    spark = docs.sparkSession
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first(), F.length("text"))
    return stored(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(shards, SHARD))


NAMES = [x.split()[0] for x in SHARD.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from written shards: start counts the ids of all documents before it.

    One row per document written: null and empty texts, repeated rows and null ids as `write_tokens` has them. A long text
    is read block by block into one array of its ids, 4 bytes each. Without shards there are no rows."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ends = np.cumsum(s["lengths"])
                starts = ends - np.array(s["lengths"])
                crc = [crc_of_ids(read_range(s["payload"], s["blocks"], s["bits"], a, b - a)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([s["shard"]] * len(crc), pa.int64()), pa.array(s["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(s["lengths"], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    # Sums over parts (as many as there are partitions), then over the shards within a part.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))
    within = shards.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")).alias("shard_before"))
    starts = within.join(before, "part").select("shard", (F.col("part_before") + F.col("shard_before")).alias("before"))
    rows = shards.select("shard", "doc_ids", "lengths", "blocks", "bits", "payload").mapInArrow(documents, "shard bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
