"""Token counts by a linear longest-match automaton.

A trie of the vocabulary carries failure links and, with each link, how many
tokens leaving the node along it completes (Song et al., 2021). A word is read
once, byte by byte; its greedy longest-match token count comes out without any
piece being built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.tokens import in_slices, small
from factloom.session import prepare

#: Stands before each word, as in the vocabulary; pieces that begin with it open a word, the others continue one.
MARK = b" "
#: Longest word and most words that a worker remembers.
KEEP_BYTES, KEEP_WORDS = 64, 400_000


class LongestMatch:
    """Counts greedy longest-match tokens of words; every single byte must be a piece, so no word fails."""

    def __init__(self, vocabulary: Iterable[bytes]):
        pieces = {p for p in vocabulary if p} | {bytes([b]) for b in range(256)}
        kids: list[dict[int, int]] = [{}]
        final = [False]
        for p in sorted(pieces):
            u = 0
            for b in p:
                if b not in kids[u]:
                    kids[u][b] = len(kids)
                    kids.append({})
                    final.append(False)
                u = kids[u][b]
            final[u] = True
        fail, pops = [-1] * len(kids), [0] * len(kids)
        level = [0]
        while level:  # breadth first: a link leads to a shorter string
            below = []
            for u in level:
                for b, v in kids[u].items():
                    if final[v]:
                        fail[v], pops[v] = 0, 1
                    else:
                        z, n = fail[u], pops[u]
                        while b not in kids[z]:
                            n += pops[z]
                            z = fail[z]
                        fail[v], pops[v] = kids[z][b], n
                    below.append(v)
            level = below
        self.kids, self.fail, self.pops, self.known = kids, fail, pops, {}

    def count(self, word: bytes) -> int:
        """Tokens of one word, in time linear in its bytes."""
        kids, fail, pops = self.kids, self.fail, self.pops
        u = n = 0
        for b in word:
            v = kids[u].get(b)
            while v is None:
                n += pops[u]
                u = fail[u]
                v = kids[u].get(b)
            u = v
        while u:
            n += pops[u]
            u = fail[u]
        return n

    def count_words(self, words: list[bytes]) -> int:
        known = self.known
        total = 0
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > KEEP_WORDS:
                known.clear()
            for w in set(words):
                if w not in known and len(w) <= KEEP_BYTES:
                    known[w] = self.count(MARK + w)
        for w in words:
            total += known[w] if w in known else self.count(MARK + w)
        return total


@lru_cache(1)
def from_rank_file(path: str) -> LongestMatch:
    with open(path, "rb") as f:
        return LongestMatch(base64.b64decode(line.split()[0]) for line in f if line.strip())


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Count words (runs of bytes other than ASCII white space) and greedy word-piece tokens of whole texts.

    ``vocabulary``: a rank file that every executor can read at that path.
    Returns doc_id, n_bytes, n_words, n_tokens, one row per input row, repeated
    rows included. A null or empty text has zeros; a null doc_id stays null; an
    empty table gives no rows; other columns aren't read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = from_rank_file(vocabulary)
        for b in small(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n_bytes, n_words, n_tokens = [], [], []
            for lo, hi in in_slices(texts):
                for t in texts[lo:hi]:
                    raw = t.encode()
                    words = raw.split()
                    n_bytes.append(len(raw))
                    n_words.append(len(words))
                    n_tokens.append(automaton.count_words(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens))], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
