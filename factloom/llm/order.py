"""Positions in a global order, without gathering rows in one task.

The rows are dealt by range, sorted within each partition and checkpointed, so
that the partition of a row is fixed. Only one count or sum per partition
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut, shuffle_partitions

_MID = "__mid"
_SHIFT = 33  # monotonically_increasing_id keeps the partition above these bits


def ordered(df: DataFrame, by: list) -> DataFrame:
    """Range-partitioned, sorted, checkpointed rows with the id of partition and row in ``__mid``."""
    n = shuffle_partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(_MID, F.monotonically_increasing_id()))


def _offsets(df: DataFrame, weight) -> dict[int, int]:
    """What precedes each partition; one row per partition comes to the driver."""
    part = F.shiftright(_MID, _SHIFT).alias("part")
    rows = df.groupBy(part).agg(F.sum(weight).alias("n")).collect()
    out, total = {}, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        out[r["part"]] = total
        total += r["n"] or 0
    out[-1] = total
    return out


def running_total(df: DataFrame, by: list, weight: str | None, name: str) -> tuple[DataFrame, int]:
    """Add the sum of ``weight`` (1 if None) over all rows before each row in the order ``by``.

    Returns the frame and the sum over all rows. Ties in ``by`` take any fixed
    order; null weights count as 0; an empty frame gives no row and 0.
    """
    src = ordered(df, by)
    offsets = _offsets(src, F.lit(1) if weight is None else F.col(weight))
    schema = T.StructType([f for f in src.schema if f.name != _MID] + [T.StructField(name, T.LongType())])
    arrow_names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            mid = b.column(_MID).to_numpy(zero_copy_only=False)
            if carry is None:
                carry = offsets[int(mid[0]) >> _SHIFT]
            w = np.ones(b.num_rows, np.int64) if weight is None else b.column(weight).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            end = np.cumsum(w)
            col = pa.array(carry + end - w, pa.int64())
            carry += int(end[-1])
            yield pa.RecordBatch.from_arrays([col if c == name else b.column(c) for c in arrow_names], names=arrow_names)

    return src.mapInArrow(run, schema), offsets[-1]
