"""Streams: trace edges merged batch by batch, paths of traces kept in state, and files indexed as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.traces import PATHS, add_edges, edge_sums, trace_paths
from factloom.session import delete_folder, prepare


def merge_edges_into(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Write a batch's edge sums (source, target, latency_ms, error) as its own folder: a batch that runs again replaces itself."""
    edge_sums(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def read_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edge sums over all batches."""
    return add_edges(spark.read.option("recursiveFileLookup", True).schema("source string, target string, count long, sum_ms double, errors long").parquet(folder))


def stream_edges(rows: DataFrame, folder: str, checkpoint: str, **trigger):
    """Run a stream of (source, target, latency_ms, error) into edge sums; batches are additive and replace themselves when replayed."""
    prepare(rows.sparkSession)
    return rows.writeStream.foreachBatch(lambda df, i: merge_edges_into(df, i, folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(rows: DataFrame, time: str, late: str = "10 minutes", length: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by time window and key, with a watermark for late rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def stream_paths(spans: DataFrame, idle_ms: int = 60_000):
    """(trace, signature, ms, errors) of traces once they have been idle for ``idle_ms``; spans (trace, span, parent, service, latency_ms, error, ts).

    A trace's spans are its state; more than 64 for each path that may be kept and the trace is dropped, as its paths would be.
    """
    most = PATHS * 64

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            found = trace_paths([(key[0], *r) for r in map(tuple, held)]) if len(held) <= most else []
            yield pd.DataFrame([(key[0], *f) for f in found], columns=["trace", "signature", "ms", "errors"])
            return
        for pdf in pdfs:
            held += [tuple(r) for r in pdf[["span", "parent", "service", "latency_ms", "error"]].astype(object).where(pdf.notna(), None).to_numpy().tolist()]
        state.update((held[: most + 1],))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(columns=["trace", "signature", "ms", "errors"])

    schema = "spans array<struct<span:string,parent:string,service:string,latency_ms:double,error:boolean>>"
    return spans.groupBy("trace").applyInPandasWithState(step, "trace string, signature string, ms double, errors long", schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounced(events: DataFrame, time: str = "ts", key: str = "path", gap: str = "400 milliseconds") -> DataFrame:
    """One row for each burst of events of a key: bursts part where nothing comes for the gap."""
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def index_changed(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """The files of a batch (path, digest, ...) whose digest isn't the registry's."""
    return batch.join(registry.select("path", "digest"), ["path", "digest"], "left_anti")


def clear(spark: SparkSession, folder: str) -> None:
    delete_folder(spark, folder)
