"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.order import running_total
from factloom.session import prepare

#: Bits of each quantised dimension.
BITS = 8
#: Shards of the registered query.
SHARDS = 24


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cells (n x dims, values below 2**bits) on the Hilbert curve.

    Gray-code method of Skilling (2004), one pass over the bits for all rows.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            x[0] = np.where(hit, x[0] ^ p, x[0])
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _hilbert(lang: pd.Series, source: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.column_stack([lang, source, size]), BITS))


def _placed(docs: DataFrame, shards: int, keep: list[str]) -> DataFrame:
    """The rows with the columns ``keep`` and, under names that begin with "__", shard, slot, curve index and cells."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    cell = lambda c: (F.crc32(F.coalesce(F.col(c), F.lit("\0"))) % (1 << BITS)).cast("int")
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__size": (F.octet_length(text) + 8).cast("long"), "__crc": F.crc32(text), "__lang": cell("lang"), "__source": cell("source")})
    rows = rows.select(*keep, "__id", "__size", "__crc", "__lang", "__source").withColumn("__cell", F.floor(BITS * F.log2(F.col("__size"))).cast("int"))
    rows = rows.withColumn("__curve", F.pandas_udf(_hilbert, "long")("__lang", "__source", "__cell"))
    ranked, n = running_total(rows, ["__curve", "__crc", "__id"], None, "__rank")
    # integer arithmetic: the first rank of shard s is ceil(s * n / shards)
    shard = F.expr(f"(__rank * {shards}L) div {max(n, 1)}L")
    return ranked.withColumn("__shard", shard).withColumn("__slot", (F.col("__rank") - F.expr(f"(__shard * {n}L + {shards - 1}L) div {shards}L")).cast("long"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put every document in one of ``shards`` runs of the Hilbert order (law ``rows``).

    Dimensions: language and source by a hash of 8 bits (values that collide share a cell, which
    prunes less but loses nothing), size by eight times its
    binary logarithm, which 8 bits hold up to 4 GB. The order is (curve index, text checksum, doc_id), so equal texts
    of equal metadata stay side by side. Runs are cut by rank: the counts of two
    shards differ by one at most. Null text counts as empty, null lang or source
    as its own value, null doc_id sorts first; repeated rows are kept, each with
    a slot of its own; an empty table gives an empty result. Only the five named
    columns are read, so extra columns can't clash.
    """
    out = _placed(docs, shards, [])
    names = {"__id": "doc_id", "__size": "size", "__crc": "text_crc32", "law": "law", "__shard": "shard", "__slot": "slot", "grown": "grown_shard", "__curve": "curve", "__lang": "q_lang", "__source": "q_source", "__cell": "q_size"}
    out = out.withColumns({"law": F.lit("rows"), "grown": F.lit(None).cast("int"), "__shard": F.col("__shard").cast("int")})
    return out.select(*[F.col(c).alias(n) for c, n in names.items()])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write all rows and columns as one folder per shard (``__shard``), in curve order, so that file statistics prune.

    Rows carry their columns through the one range partitioning that ranks them, so each row lands in the shard
    and at the slot (``__slot``) that ``hilbert_shards`` states, repeated rows too. A partition is a run
    of the curve: a shard is written by all the tasks that hold a part of it.
    """
    out = _placed(docs, shards, docs.columns).withColumn("__shard", F.col("__shard").cast("int"))
    out.select(*docs.columns, "__slot", "__shard").write.partitionBy("__shard").parquet(path)
