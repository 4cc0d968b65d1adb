"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks whose
borders depend on content alone. The store has two Parquet folders: ``chunks``
(SHA-256 digest, ids compressed with zstd), each distinct chunk once, and
``recipes`` (doc_id, start, n_tokens, digests and lengths in order, Merkle
root over the digests), in ascending doc_id order.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.order import running_total
from factloom.llm.tokens import PieceEncoder, in_slices, small
from factloom.session import prepare, shuffle_partitions

#: Id that ends each document.
END_ID = 0
#: Ids in a chunk: least, most, and the mask that makes one border in 512 ids.
LEAST, MOST, MASK = 128, 2048, 511
#: Ids under the rolling hash.
WINDOW = 16

_ROWS = "kind string, spread long, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, digest binary, payload binary"


def _gear() -> np.ndarray:
    """A fixed random number for each id, by its lowest 17 bits."""
    return np.random.default_rng(17).integers(0, 1 << 32, 1 << 17, np.uint32)


_GEAR = _gear()


def borders(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream; the last is its length."""
    h = _GEAR[ids & 0x1FFFF]
    step = 1
    while step < WINDOW:  # after each step h covers twice as many ids
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    ends, last = [], 0
    for e in (np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(last := e)
    while len(ids) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(ids):
        ends.append(len(ids))
    return ends


def merkle_root(digests: list[bytes]) -> bytes:
    """SHA-256 tree over the digests in order; an odd node moves up as it is."""
    level = list(digests)
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once.

    A text that holds a special token's string goes to the library as it is.
    """

    #: Pieces in one call; each begins at a token with a space.
    ROW = 1500
    #: Pieces that a worker remembers.
    KEEP = 900_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.model._resize_cache(0)  # it sees each word once, so its own memory only costs time
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.library.get_vocab_size(), bool)  # ids of tokens that begin with a space
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.pieces = PieceEncoder(self._encode_new, self.KEEP)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the library in long rows; their ids part at the tokens that begin with a space."""
        plain = np.array([p[0] == " " and p.find(" ", 1) < 0 and len(p) > 1 for p in pieces])
        words = [p for p, x in zip(pieces, plain, strict=True) if x]
        ids: list[np.ndarray] = []
        counts = np.zeros(len(pieces), np.int64)
        own = []
        for lo in range(0, len(words), self.ROW):
            row = words[lo : lo + self.ROW]
            got = np.array(self._ids(["".join(row)])[0], np.uint32)
            at = np.flatnonzero(self.opens[got])
            if len(at) != len(row) or at[0]:
                raise ValueError("a token that begins with a space lies inside a word")
            ids.append(got)
            own.append(np.diff(at, append=len(got)))
        if len(words) == len(pieces):
            return np.concatenate(ids), np.concatenate(own)
        rest = self._ids([p for p, x in zip(pieces, plain, strict=True) if not x])
        counts[plain] = np.concatenate(own) if own else 0
        counts[~plain] = [len(x) for x in rest]
        of_plain = np.repeat(plain, counts)
        out = np.zeros(len(of_plain), np.uint32)
        if ids:
            out[of_plain] = np.concatenate(ids)
        out[~of_plain] = [i for x in rest for i in x]
        return out, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not whole:
            return self.pieces.encode(texts)
        out = self.pieces.encode([t if i not in set(whole) else "" for i, t in enumerate(texts)])
        for i in whole:
            out[i] = np.array(self._ids([texts[i]])[0], np.uint32)
        return out


@lru_cache(1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _chunk_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A recipe row per document, and a chunk row for each digest that its task meets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, press, met = library_encoder(tokenizer), zstandard.ZstdCompressor(1), set()
        schema = pa.schema([("kind", pa.string()), ("spread", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("root", pa.binary()), ("digest", pa.binary()), ("payload", pa.binary())])
        for b in small(batches):
            ids_of, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in in_slices(texts):
                rows = []
                for doc_id, ids in zip(ids_of[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    stream = np.append(ids, END_ID).astype("<u4")
                    raw = stream.tobytes()
                    digests, lengths, last = [], [], 0
                    for e in borders(stream):
                        data = raw[4 * last : 4 * e]
                        digests.append(digest := hashlib.sha256(data).digest())
                        lengths.append(e - last)
                        if digest not in met:
                            met.add(digest)
                            part = stream[last:e]
                            wide = part.max() > 0xFFFF
                            rows.append(("chunk", int.from_bytes(digest[:8], "big", signed=True), None, None, None, None, None, digest, (b"\4" if wide else b"\2") + press.compress(data if wide else part.astype("<u2").tobytes())))
                        last = e
                    spread = (doc_id or 0) * 0x9E3779B97F4A7C15 % (1 << 63)
                    rows.append(("recipe", spread, doc_id, len(stream), digests, lengths, merkle_root(digests), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the first row of each digest; rows of one digest are in one partition, one per encoding task at most."""
    met: set = set()
    for b in batches:
        keep = []
        for d in b.column("digest").to_pylist():
            keep.append(d is None or d not in met)
            met.add(d)
        yield b.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, folder: str, tokenizer: str) -> int:
    """Encode every whole text (null: empty), end it with id 0 and write the store; returns the number of ids.

    Repeated rows and doc_ids get a recipe each, their chunks are stored once; a
    null doc_id sorts first; an empty table gives empty folders; other columns
    aren't read. The distinct digests that a task meets and that a partition
    stores are held in memory, in proportion to the task's own rows.
    """
    spark = prepare(docs.sparkSession)
    rows = _chunk_rows(docs, tokenizer).repartition(shuffle_partitions(spark), "spread")
    rows.mapInArrow(_once, _ROWS).write.partitionBy("kind").parquet(f"{folder}/raw")
    raw = spark.read.schema(_ROWS).parquet(f"{folder}/raw")
    recipes = raw.filter("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "lengths", "root")
    placed, total = running_total(recipes, ["doc_id", "root"], "n_tokens", "start")
    placed.write.parquet(f"{folder}/recipes")
    return total


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload of the stored chunks."""
    return spark.read.schema(_ROWS).parquet(f"{folder}/raw").filter("kind = 'chunk'").select("digest", "payload")


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, start long").parquet(f"{folder}/recipes")


def _unpack(payload: bytes, press) -> np.ndarray:
    return np.frombuffer(press.decompress(payload[1:]), "<u4" if payload[0] == 4 else "<u2").astype("<u4")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and crc32 of each stored chunk, after its digest has been held against its ids."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for b in batches:
        digests, crcs, lengths = b.column("digest").to_pylist(), [], []
        for digest, payload in zip(digests, b.column("payload").to_pylist(), strict=True):
            data = _unpack(payload, press).tobytes()
            if hashlib.sha256(data).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            crcs.append(zlib.crc32(data))
            lengths.append(len(data) // 4)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(crcs, pa.int64()), pa.array(lengths, pa.int32())], names=["digest", "crc", "ids"])


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """crc32 of joined data from (crc32, bytes) of its parts.

    Reading n zero bytes maps a crc c to M(c) ^ k; M(c) ^ (crc of the next part) joins.
    """
    out = 0
    for crc, n in parts:
        zeros = _ZEROS[:n] if n <= len(_ZEROS) else bytes(n)
        out = zlib.crc32(zeros, out) ^ zlib.crc32(zeros, 0) ^ crc
    return out


_ZEROS = memoryview(bytes(4 * MOST))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = []
        for n, root, parts in zip(b.column("n_tokens").to_pylist(), b.column("root").to_pylist(), b.column("parts").to_pylist(), strict=True):
            if sum(p["ids"] for p in parts) != n or merkle_root([p["digest"] for p in parts]) != root:
                raise ValueError(f"a document doesn't agree with its manifest {root.hex()}")
            crcs.append(join_crcs([(p["crc"], 4 * p["ids"]) for p in parts]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Read every chunk and recipe back; doc_id, start, n_tokens, ids_crc32 of the reconstructed streams.

    Digests, lengths and Merkle roots are held against the data; a difference
    raises. A document's crc is joined from those of its chunks, so no payload is
    shuffled. ``start`` tells documents apart, as each has one id at least.
    """
    facts = chunks(spark, folder).mapInArrow(_verified, "digest binary, crc long, ids int")
    used = recipes(spark, folder).select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    part = F.struct("pos", "digest", "crc", "ids")
    docs = used.join(facts, "digest", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(part)).alias("parts"))
    return docs.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array of int) of every document, rebuilt from its recipe."""
    used = recipes(spark, folder).select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    rows = used.join(chunks(spark, folder), "digest").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for b in batches:
            ids = [np.concatenate([_unpack(p["payload"], press) for p in parts]).tolist() for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids array<int>")
