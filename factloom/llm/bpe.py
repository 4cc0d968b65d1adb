"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

Each piece's bytes are written as printable characters, its score is its
negative rank, and the normaliser is the identity, so sentencepiece's merge of
the best-scored pair is the merge of the lowest rank. Pre-tokens are encoded
one by one; decoding maps the characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factloom.llm.tokens import PieceEncoder, in_slices, small
from factloom.session import prepare


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a rank file, by rank; ranks must be 0 to n - 1."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                ranks[int(rank)] = base64.b64decode(piece)
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value: bytes | int) -> bytes:
    """A field of a protocol buffer: bytes with their length, or an integer."""
    out = bytearray(_varint(number << 3 | (2 if isinstance(value, bytes) else 0)))
    if isinstance(value, bytes):
        return bytes(out) + _varint(len(value)) + value
    return bytes(out) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the unknown piece that it must have comes last and is never needed."""
    chars = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(chars[b] for b in piece).encode()
        out += _field(1, _field(1, text) + bytes([2 << 3 | 5]) + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + bytes([2 << 3 | 5]) + struct.pack("<f", 0.0) + _field(3, 2))
    # trainer: BPE, vocabulary size, ids of unknown, begin, end and padding (-1: none)
    none = (1 << 64) - 1
    out += _field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, none) + _field(42, none) + _field(43, none))
    # normaliser: identity, no prefix, white space neither removed nor escaped
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes whole texts. ``pattern`` cuts texts into pre-tokens."""

    def __init__(self, pieces: list[bytes], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(pieces))
        chars = byte_characters()
        self.table = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(pieces))]
        self.split = regex.compile(pattern).findall
        self.pieces = PieceEncoder(self._encode_new)

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [self.split(p) for p in pieces]
        mapped = [t.encode().decode("latin-1").translate(self.table) for ts in tokens for t in ts]
        ids = self.model.encode(mapped, num_threads=1)
        counts = np.add.reduceat(np.fromiter(map(len, ids), np.int64, len(ids)), np.cumsum([0, *map(len, tokens)])[:-1])
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        return self.pieces.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the little-endian unsigned 32-bit
    ids), decoded_sha256 (of the decoded bytes) and, with ``ids``, the ids
    themselves as ``token_ids`` (binary). One row per input row, repeated rows
    included; a null text counts as empty and has no ids; a null doc_id stays
    null; an empty table gives no rows; other columns aren't read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in small(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows: list[tuple] = []
            for lo, hi in in_slices(texts):
                for x in own.encode(texts[lo:hi]):
                    raw = x.astype("<u4").tobytes()
                    rows.append((len(x), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(x)).hexdigest(), raw if ids else None))
            n, sha, back, raw = zip(*rows, strict=True) if rows else ((), (), (), ())
            cols = [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * ids)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Turn doc_id, token_ids into doc_id, text; bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = [own.decode(np.frombuffer(x or b"", "<u4")).decode(errors="replace") for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
