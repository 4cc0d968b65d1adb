"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Two fingerprints of 64 bits within ``RADIUS`` agree wholly on some of the
blocks they are cut into, so fingerprints meet in buckets of equal blocks. A
bucket beyond one tile is cut by population count into tiles; pairs of tiles
whose counts differ by more than the radius are skipped, the others are compared
whole with exclusive-or and bit counts. A tile pair gives the edges of a
spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import connected_components
from factloom.llm.tokens import small
from factloom.session import cut, prepare, shuffle_partitions

#: Words in a shingle, seed of its hash, greatest distance of linked fingerprints.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Most fingerprints of a bucket that are compared as one tile.
TILE = 512
#: Blocks by the greatest number of distinct fingerprints; more blocks, longer keys and more of them.
BLOCKS = ((1 << 22, 4), (1 << 31, 5), (1 << 63, 6))


def fingerprint(text: str | None) -> int:
    """SimHash of one whole text: bit set where over half of its shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: 1 - SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and text_key (a digest of the text) of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), b.column("text_key")], names=["doc_id", "fp", "text_key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key")).mapInArrow(run, "doc_id long, fp long, text_key long")


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _masks(blocks: int, radius: int) -> list[int]:
    """Masks of the blocks that agree, as signed longs: any ``radius`` of the blocks may differ."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least linked node) of a spanning forest over fingerprints within the radius."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # groups may go on in the next batch
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "key", "tiles", "fp")]))
            if not held:
                continue
            rows = np.concatenate(held)
            if b is not None:
                same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
                keep = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
                held, rows = [rows[keep:]], rows[:keep]
            if not len(rows):
                continue
            new = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            sizes = np.diff(np.r_[new, len(rows)])
            fps = rows[:, 3].copy().view(np.uint64)
            group, out = np.repeat(np.arange(len(new)), sizes), []
            small = sizes[group] <= 8
            for lag in range(1, 8):  # small groups of all the rows at once
                hit = (group[lag:] == group[:-lag]) & small[lag:]
                i = np.flatnonzero(hit)
                i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= radius]
                out.append((fps[i], fps[i + lag]))
            for g in np.flatnonzero(sizes > 8).tolist():
                out.append(forest(np.unique(fps[new[g] : new[g] + sizes[g]]), radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` within the radius; ``fp`` must be distinct."""
    prepare(distinct.sparkSession)
    n = distinct.count()
    masks = _masks(next(b for most, b in BLOCKS if n <= most), radius)
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("x")
    rows = distinct.select("fp", F.expr("bit_count(fp)").alias("pop"), bands).select("fp", "pop", "x.band", "x.key")
    tiles_of = lambda c: F.ceil(c / F.lit(TILE)).cast("int")
    counts = rows.groupBy("band", "key", "pop").agg(F.count("*").alias("n"))
    # at most 65 population counts a bucket
    buckets = counts.groupBy("band", "key").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("pop", "n"))).alias("hist")).filter("size > 1")
    rows = rows.join(buckets, ["band", "key"])
    own = F.pmod(F.xxhash64("fp"), tiles_of(F.col("hist")[F.col("pop")]).cast("long")).cast("int")
    tile = lambda pop, sub: pop.cast("long") * F.lit(1 << 24) + sub.cast("long")
    others = F.flatten(
        F.transform(
            F.filter(F.map_entries("hist"), lambda e: F.abs(e["key"] - F.col("pop")) <= radius),
            lambda e: F.transform(F.sequence(F.lit(0), tiles_of(e["value"]) - 1), lambda s: tile(e["key"], s)),
        )
    )
    mine = tile(F.col("pop"), own)
    pairs = F.transform(others, lambda t: F.least(t, mine) * F.lit(1 << 31) + F.greatest(t, mine))
    rows = rows.select("band", "key", "fp", F.explode(F.when(F.col("size") <= TILE, F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("tiles"))
    dealt = rows.repartition(shuffle_partitions(distinct.sparkSession), "band", "key", "tiles").sortWithinPartitions("band", "key", "tiles")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def _rooted(fps: DataFrame, radius: int) -> DataFrame:
    """fp, least (smallest doc_id that has it) and root (of the component) of the distinct fingerprints."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct, radius))
    return cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint every whole text and link those at ``radius`` or fewer differing bits.

    Returns doc_id, fingerprint (16 lowercase hex digits), component_id (the
    smallest doc_id reachable over links). A null text, like one without words,
    has fingerprint zero and is linked like any other. Equal fingerprints are one
    node, so copies cost one comparison. Repeated rows stay; a null doc_id never
    becomes a component_id unless its component has no other. An empty table gives
    no rows; other columns aren't read.
    """
    fps = cut(fingerprints(docs))
    rooted = _rooted(fps, radius)
    comps = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(comps, "root").select(F.col("fp").alias("node"), "component_id")
    return fps.join(by_fp, fps.fp == by_fp.node).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Keep one row of each component: the one of the smallest doc_id, null last; of rows that repeat that id the one of the least text digest.

    All columns stay as they are. Rows are told apart by id and text; of rows that agree
    in both any one stays. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs))
    roots = _rooted(fps, RADIUS).select(F.col("fp").alias("node"), "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    # the first row of each fingerprint, then of each component
    firsts = fps.groupBy("fp").agg(first).join(roots, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("first").alias("first"))
    kept = cut(firsts.select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key")))
    own = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (_text_key() == kept["__key"]), "left_semi")
    same = fps.groupBy("doc_id", "text_key").count().filter("count > 1")
    if same.join(kept, same["doc_id"].eqNullSafe(kept["__id"]) & (same["text_key"] == kept["__key"]), "left_semi").isEmpty():
        return own
    return own.withColumn("__key", _text_key()).dropDuplicates(["doc_id", "__key"]).drop("__key")
