"""Words of many texts at once, as byte ranges of one buffer and as hashes."""

from __future__ import annotations

import numpy as np

from .common import RangeHash, mixed

#: ASCII characters other than letters and digits end a word.
SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class Words:
    """The lower-cased words of texts; a null text has none."""

    def __init__(self, texts: list[str | None], table: bytes | None = SPACED):
        raw = [(t or "").lower().encode() for t in texts]
        joined = b" ".join(raw) + b" "
        self.data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
        blank = self.data <= 32
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first_bytes = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.doc = np.searchsorted(self.first_bytes, self.starts, side="right") - 1
        self.hashes = RangeHash(self.data, 21)

    def full(self) -> np.ndarray:
        return mixed(self.hashes.of(self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes; zero for shorter words."""
        ends = self.starts + n
        long = ends <= self.ends
        out = np.zeros(len(self.starts), np.uint64)
        out[long] = mixed(self.hashes.of(self.starts[long], ends[long]) + np.uint64(n << 32))
        return out

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode(errors="replace")


class Known:
    """Fast membership of hashes in a sorted table: a bitmap first, then bisection."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.keys >> np.uint64(46)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, rows of the table) of those that are in it."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(46)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[row] == hashes[at]
        return at[same], row[same]
