"""Shared pieces of the tokenizer operators: cutting texts where no pre-token crosses, and a word cache.

The rank vocabulary's pattern gives every single space that precedes a
character other than white space to the pre-token on its right. Text can so be
cut before such a space, and the ids of a piece don't depend on what
surrounds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: A space that white space or the end of the text follows: text can't be cut there.
_ODD = re.compile(r" \s| \Z")
_ODD_ASCII = [f" {c}" for c in map(chr, range(128)) if c.isspace()]
_CUT = regex.compile(r"(?= \S)", regex.V1)
#: Longest piece in characters, and most pieces, that a worker remembers.
KEEP_CHARS = 1000
KEEP_PIECES = 200_000


def is_odd(text: str) -> bool:
    """Whether white space or the end follows a space."""
    if text.isascii():
        return text.endswith(" ") or any(s in text for s in _ODD_ASCII)
    return _ODD.search(text) is not None


class _Known(dict):
    """Position of each piece; a piece that is met for the first time waits to be encoded."""

    def __init__(self, waiting: list[str], prefix: str):
        super().__init__()
        self.waiting, self.prefix = waiting, prefix

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.waiting)
        self.waiting.append(self.prefix + piece)
        return n


class PieceEncoder:
    """Encodes texts piece by piece, each distinct piece once.

    ``encode_pieces`` gives (ids of all pieces in a row, number of ids of each).
    The pieces met are forgotten once they are more than ``keep`` or one of
    them is longer than KEEP_CHARS; this changes speed only, never ids.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = KEEP_PIECES):
        self.encode_pieces, self.keep = encode_pieces, keep
        self._forget()

    def _forget(self) -> None:
        self.waiting: list[str] = []
        self.words, self.exact = _Known(self.waiting, " "), _Known(self.waiting, "")
        self.done, self.ids, self.ends = 0, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        if self.done > self.keep:
            self._forget()
        word, exact = self.words.__getitem__, self.exact.__getitem__
        parts = [np.zeros(0, np.int64)]
        sizes = []
        for t in texts:
            before = len(parts)
            if is_odd(t):
                parts.append(np.array([exact(p) for p in _CUT.split(t) if p], np.int64))
            elif t:
                first, *rest = t.split(" ")
                if first:
                    parts.append(np.array([exact(first)], np.int64))
                parts.append(np.fromiter(map(word, rest), np.int64, len(rest)))
            sizes.append(sum(map(len, parts[before:])))
        new = self.waiting[self.done :]
        if new:
            ids, counts = self.encode_pieces(new)
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            self.waiting[self.done :] = [""] * len(new)
            self.done = len(self.waiting)
        pos = np.concatenate(parts)
        starts, counts = self.ends[pos], self.ends[pos + 1] - self.ends[pos]
        upto = np.cumsum(counts)
        total = int(upto[-1]) if len(upto) else 0
        out = self.ids[np.repeat(starts - upto + counts, counts) + np.arange(total)] if total else np.zeros(0, np.uint32)
        cut = np.concatenate([[0], upto])[np.cumsum(sizes)] if sizes else []
        if new and max(map(len, new)) > KEEP_CHARS:
            self._forget()
        return np.split(out, cut[:-1]) if len(cut) else []


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts at a time are Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()


def in_slices(texts: list[str], most: int = 4_000_000):
    """Index ranges of about ``most`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
