"""Fill-in-the-middle: texts cut into units, and dealt anew as prefix, suffix and middle, with column kernels of Arrow.

A batch of texts is split into a list array of units, whose flat values keep their parents' indices; a unit's ordinal in
its text gives its role, each role is filtered out of the flat values, built into lists again and joined to pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs_of

#: The marks, and the unit of a text, over bytes (white space is ASCII, so bytes and code points part alike).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = rb"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: A byte that no UTF-8 text holds ends each unit.
END = b"\xff"
SHAPE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a seed and an id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text as a list array of bytes; those of a text are its bytes end to end."""
    ended = pc.replace_substring_regex(texts.cast(pa.binary()), pattern=UNIT, replacement=rb"\0" + END)
    return pc.split_pattern(ended, pattern=END)


def remainder(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def transform(batch: pa.RecordBatch, rate: int, spm_rate: int) -> list[pa.Array]:
    """The columns of SHAPE for a batch with text and h1 to h4."""
    text = batch.column("text").fill_null("")
    parts = units(text)
    # What follows the last end is one more value, which is empty.
    n = pc.subtract(pc.list_value_length(parts).cast(pa.int64()), 1)
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(parts.offsets.cast(pa.int64()), parent))
    cuts = [remainder(batch.column(h), pc.add(n, 1)) for h in ("h1", "h2")]
    first, second = (pc.take(f(*cuts), parent) for f in (pc.min_element_wise, pc.max_element_wise))
    roles = {
        "prefix": pc.less(ordinal, first),
        "middle": pc.and_(pc.greater_equal(ordinal, first), pc.less(ordinal, second)),
        "suffix": pc.greater_equal(ordinal, second),
    }
    piece = {}
    for role, mask in roles.items():
        held = np.bincount(pc.filter(parent, mask).to_numpy(), minlength=len(text))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32()), pc.filter(flat, mask))
        piece[role] = pc.binary_join(lists, b"")
    h3, h4 = (remainder(batch.column(h), pa.scalar(100, pa.int64())) for h in ("h3", "h4"))
    marked = pc.or_(pc.or_(*(pc.match_substring(text, m) for m in (PREFIX, SUFFIX))), pc.match_substring(text, MIDDLE))
    plain = pc.or_(pc.or_(pc.equal(pc.binary_length(text), 0), marked), pc.greater_equal(h3, rate))
    spm = pc.less(h4, spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    joined = lambda *x: pc.binary_join_element_wise(*[p.encode() if isinstance(p, str) else p for p in x], b"")
    output = pc.if_else(spm, joined(SUFFIX, piece["suffix"], PREFIX, piece["prefix"], MIDDLE, piece["middle"]), joined(PREFIX, piece["prefix"], SUFFIX, piece["suffix"], MIDDLE, piece["middle"]))
    output = pc.if_else(plain, text, output.cast(pa.string()))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece[r].cast(pa.string())).cast(pa.int64())) for r in ("prefix", "middle")]
    return [n, form, *chars, output]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document, a row for a row.

    `rate` of 100 texts are cut, at two places drawn by `seed` and id, into prefix, middle and suffix of whole units, and
    `spm_rate` of 100 of these put the suffix first. A null text is empty; an empty text, and one that holds a mark, is
    plain. A null id draws as an empty one and stays null. Rows of one id are cut by the same draws. Texts of any length
    are split whole (a batch is 1 MB of text, or one longer text). An empty table gives none. Further columns are left.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id").cast("long"), seed), 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *transform(batch, rate, spm_rate)], ["doc_id", *[c.split()[0] for c in SHAPE.split(", ")]])

    return rows.mapInArrow(run, f"doc_id bigint, {SHAPE}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that was cut holds no mark, so the marks part the output exactly."""
    piece = F.split(output, "<[PSM]>", -1)
    whole = lambda *at: F.concat(*[F.get(piece, F.lit(k)) for k in at])
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)


#: The same in SQL for DuckDB.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2, ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
c AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""
