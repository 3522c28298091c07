"""Token ids of whole texts with public tokenizers, a distinct piece at a time.

Arrow cuts texts where the tokenizer always cuts and finds the distinct pieces of a run of texts;
each piece that is new to the worker is encoded once by the tokenizer and kept in a flat store; a
text's ids are gathered from the store with NumPy. Texts that hold a string of a special token, or
blanks that the cut does not cover, go to the tokenizer whole. Runs and store are bounded; a full
store is started anew.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in a worker's store, and bytes of text in a run.
STORE_PIECES, RUN_BYTES = 1_000_000, 8 << 20
#: A blank between blanks, where a cut before it would part one token. The first form is for Arrow's matcher, whose blanks must be listed.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f"{_BLANK} (?:{_BLANK}|\\z)"
_open: dict[str, TextEncoder] = {}
#: One word of Latin letters, which every pre-tokenizer here keeps whole, and a mark after it.
_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_MARKS = ".,"


def _byte_letters() -> dict[int, str]:
    """The letters in which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces in a row, and where each piece ends."""
    sizes = sizes[places]
    ends = np.cumsum(sizes)
    at = np.repeat(starts[places] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return ids[at], ends


class Store:
    """Ids of pieces one after another; a place is the number of a piece."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, rows: list[list[int]]) -> int:
        """The place of the first of ``rows``; the others follow it."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        more = int(sizes.sum())
        while self.used + more > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(rows) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.ids[self.used:self.used + more] = np.fromiter((i for r in rows for i in r), "<u4", more)
        ends = self.used + np.cumsum(sizes)
        self.starts[self.n:self.n + len(rows)], self.sizes[self.n:self.n + len(rows)] = ends - sizes, sizes
        first, self.used, self.n = self.n, self.used + more, self.n + len(rows)
        return first

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self.ids, self.starts, self.sizes, places)


class TextEncoder:
    """Unsigned 32-bit ids for each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [getattr(t, "content", t) for t in self.tok.get_added_tokens_decoder().values()]
        # Words that keep the blank before them are cut before a blank, others at any blank.
        self.spaced = self.tok.encode(" a b", add_special_tokens=False).ids != self.tok.encode("a b", add_special_tokens=False).ids
        self.letters = _byte_letters()
        self.lower = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("A") == "a"
        self._clear()
        self.direct, lead, probe = True, " " if self.spaced else "", ["stra\u00dfe", "Ein", "\u00c9t\u00e9,", "to.", "x"]
        found, ends = self._ids(pa.array(probe), {}, lead)
        self.direct = [x.tolist() for x in np.split(found, ends[:-1])] == self._raw([lead + p for p in probe])

    def _clear(self) -> None:
        self.store = Store()
        #: Places of pieces that stand after a blank, or alone, and of those that begin a text.
        self.places: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.marks = [self.store.add(self._raw([m])) for m in _MARKS]

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of plain words, with a blank before them or not, by the tokenizer's model itself."""
        model, letters = self.tok.model, self.letters
        return [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]

    def _learned(self, pieces: pa.Array, places: dict[str, int], lead: str) -> np.ndarray:
        """The places of distinct pieces, each with ``lead`` before it; new ones are encoded."""
        names = pieces.to_pylist()
        get = places.get
        out = np.fromiter((get(p, -1) for p in names), np.int64, len(names))
        plain = pc.match_substring_regex(pieces, _WORD + "$").to_numpy(zero_copy_only=False) if self.direct else np.zeros(len(names), bool)
        for which, encode in ((plain, self._words), (~plain, self._raw)):
            new = np.flatnonzero(which & (out < 0))
            if len(new):
                own = [names[i] for i in new.tolist()]
                first = self.store.add(encode([lead + p for p in own]))
                out[new] = np.arange(first, first + len(own))
                places.update(zip(own, range(first, first + len(own))))
        return out

    def _ids(self, pieces: pa.Array, places: dict[str, int], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces in a row and where each ends; words are remembered without mark and capital."""
        if not self.direct:
            return self.store.gathered(self._learned(pieces, places, lead))
        marked = pc.match_substring_regex(pieces, f"{_WORD}[{_MARKS}]$")
        bare = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        if self.lower:
            bare = pc.if_else(pc.match_substring_regex(bare, _WORD + "$"), pc.utf8_lower(bare), bare)
        told = bare.dictionary_encode()
        own = self._learned(told.dictionary, places, lead)[told.indices.to_numpy(zero_copy_only=False)]
        marked = marked.to_numpy(zero_copy_only=False)
        mark = np.full(len(own), self.marks[0])
        for m, place in zip(_MARKS[1:], self.marks[1:]):
            mark[pc.ends_with(pieces, m).to_numpy(zero_copy_only=False)] = place
        both = np.stack((own, mark), 1).ravel()[np.stack((np.ones(len(own), bool), marked), 1).ravel()]
        ids, ends = self.store.gathered(both)
        return ids, ends[np.cumsum(1 + marked) - 1]

    def _run(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of texts without nulls, a run at a time."""
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if self.spaced:
            odd |= pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        cut = pc.split_pattern(plain, " ") if self.spaced else pc.ascii_split_whitespace(plain)
        pieces = cut.flatten()
        if self.store.n > STORE_PIECES:
            self._clear()
        told = pieces.dictionary_encode()
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False)))).astype(np.int64)
        known, upto = self._ids(told.dictionary, self.places, " " if self.spaced else "")
        places = told.indices.to_numpy(zero_copy_only=False)
        if self.spaced:
            # A text's first piece has no blank before it.
            firsts = pieces.take(pa.array(at[:-1])).dictionary_encode()
            more, to = self._ids(firsts.dictionary, self.firsts, "")
            places = places.copy()
            places[at[:-1]] = len(upto) + firsts.indices.to_numpy(zero_copy_only=False)
            known, upto = np.concatenate((known, more)), np.concatenate((upto, len(known) + to))
        ids, ends = gathered(known, np.concatenate(([0], upto[:-1])).astype(np.int64), np.diff(upto, prepend=0), places)
        own = iter(np.split(ids, np.concatenate(([0], ends))[at[1:-1]])) if len(plain) else iter(())
        for i, whole in enumerate(odd.tolist()):
            yield np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4") if whole else next(own)

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in order."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n
            if size >= RUN_BYTES:
                yield from self._run(texts.slice(start, i + 1 - start))
                start, size = i + 1, 0
        if start < len(texts):
            yield from self._run(texts.slice(start))


def encoder(path: str) -> TextEncoder:
    """This worker's encoder of a vocabulary file; it lives as long as the worker."""
    if path not in _open:
        _open[path] = TextEncoder(path)
    return _open[path]
