"""Tokenizing whole texts with a public tokenizer file, by way of a cache of words."""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import groups, mixed, word_hashes

#: Words kept by a worker before its cache starts anew; results don't depend on it.
CACHED_WORDS = 1_000_000
#: A word and a run of marks behind it. Both files cut between the two; an apostrophe may start a contraction.
WORD_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class WordEncoder:
    """Ids of whole texts, as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    Both supported files split a text before they merge, and no split piece reaches over a single blank between two
    other characters. So each blank-separated word is encoded once by the library and then looked up. Texts with other
    white space next to a blank, or with the text of a special token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.model._resize_cache(0)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.normal = self.library.normalizer
        # A lower-casing file drops white space; else a word owns the blank before it.
        self.blank = "" if self.normal is not None else " "
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.marks: dict[str, array] = {}
        self.forget()

    def forget(self) -> None:
        """The cache: a word's hash, in a sorted array, gives its row; a row gives another hash of the word, which must be
        the same, and the place and number of its ids in the pool. Arrays take a tenth of what a dict does."""
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.others, self.places, self.pool = array("Q"), array("q", [0]), array("I")

    def packed(self, text: str) -> array:
        return array("I", self.library.encode(text, add_special_tokens=False).ids)

    def letters(self, word: str) -> array:
        """A run of letters is a split piece; the model merges it as it stands."""
        if self.normal is not None:
            word, given = self.normal.normalize_str(word), word
            if not word.isalpha():
                return self.packed(given)
        shown = word.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)])

    def word(self, word: str, blank: str) -> array:
        if word.isalpha():
            return self.letters(blank + word)
        if (m := WORD_MARKS.fullmatch(word)) and m[1].isalpha():
            return self.letters(blank + m[1]) + self.mark(m[2])
        if self.blank and "\n" in word and all(lines := word.split("\n")):
            ids = self.word(lines[0], blank)
            for x in lines[1:]:
                ids = ids + self.mark("\n") + self.word(x, "")
            return ids
        return self.packed(blank + word)

    def mark(self, marks: str) -> array:
        if marks not in self.marks:
            self.marks[marks] = self.packed(marks)
        return self.marks[marks]

    def whole(self, text: str) -> bool:
        """True if the library must see the text as one."""
        if any(s in text for s in self.special):
            return True
        if not self.blank:
            return False
        if "  " in text or " \n" in text or "\n " in text or text[-1:].isspace() or text[:1] == " ":
            return True
        # White space other than single blanks and line feeds.
        return len(text.replace(" ", "").replace("\n", "").split(None, 1)) > 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One unsigned 32-bit array of ids per text; an empty text has none."""
        raw = [t.encode() for t in texts]
        out = []
        for a, b in groups(np.array([len(r) for r in raw]), 1 << 20) if raw else ():
            out += self.block(texts[a:b], raw[a:b])
        return out

    def block(self, texts: list[str], raw: list[bytes]) -> list[np.ndarray]:
        if len(self.rows) > CACHED_WORDS:
            self.forget()
        joined = b" ".join(raw)
        data = np.frombuffer(joined, np.uint8)
        cut = data == 32
        if not self.blank:
            cut |= data == 10
        cut = np.flatnonzero(cut)
        starts, ends = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(data)]))
        hashes, others = word_hashes(data, starts, ends)
        first = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]))
        if self.blank:
            hashes[first] += np.uint64(0x5851F42D4C957F2D)
        keys, at, which = np.unique(mixed(hashes), return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        found = np.zeros(len(keys), np.int32)
        found[known] = self.rows[where[known]]
        new = np.flatnonzero(~known)
        found[new] = np.arange(len(self.places) - 1, len(self.places) - 1 + len(new))
        heads = set(first.tolist()) if self.blank else ()
        for k in at[new].tolist():
            word = joined[starts[k] : ends[k]].decode()
            if word:
                self.pool.extend(self.word(word, "" if k in heads else self.blank))
            self.places.append(len(self.pool))
        self.others.extend(others[at[new]].tolist())
        self.keys, self.rows = np.insert(self.keys, where[new], keys[new]), np.insert(self.rows, where[new], found[new])
        places = np.frombuffer(self.places, np.int64)
        row = found[which]
        # Texts with a word that only seems to be a known one, or the first one here, go to the library.
        unlike = np.flatnonzero(np.frombuffer(self.others, np.uint64)[row] != others)
        apart = set((np.searchsorted(first, unlike, side="right") - 1).tolist())
        begin, count = places[row], places[row + 1] - places[row]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = np.frombuffer(self.pool, np.uint32)[np.repeat(begin - total[:-1], count) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        limits = total[np.concatenate((first, [len(starts)]))]
        del places
        return [np.frombuffer(self.packed(t), np.uint32) if k in apart or self.whole(t) else ids[a:b] for k, (t, a, b) in enumerate(zip(texts, limits[:-1].tolist(), limits[1:].tolist(), strict=True))]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
