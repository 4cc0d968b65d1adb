"""Streams equal batches."""

from factloom.operators.traces import trace_paths
from factloom.streaming import epochs, traces


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1.0, False), ("a", "b", 3.0, True)], "source string, target string, latency_ms double, error boolean")
    for i in (0, 1, 1):
        traces.merge_edges_into(df, i, str(tmp_path))
    assert [tuple(r) for r in traces.read_edges(spark, str(tmp_path)).collect()] == [("a", "b", 4, 8.0, 2)]


def test_windows_take_late_rows(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'x' event_type, 1.0D value union all select timestamp'2024-01-01 00:50:00', 'x', 2.0D")
    assert [r["n"] for r in traces.windowed(rows, "ts").collect()] == [2]


def test_bursts_part_after_a_gap(spark):
    rows = spark.sql("select timestamp_millis(v) ts, 'p' path from values (0), (300), (2000) t(v)")
    assert sorted(r["events"] for r in traces.debounced(rows).collect()) == [1, 2]


def test_state_gives_the_paths_of_the_batch(spark, tmp_path):
    spans = [("t", "1", None, "web", 1.0, False), ("t", "2", "1", "api", 2.0, True), ("t", "3", "1", "db", 3.0, False)]
    schema = "trace string, span string, parent string, service string, latency_ms double, error boolean"
    spark.createDataFrame(spans, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = traces.stream_paths(stream, 1000).writeStream.format("memory").queryName("paths").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(60):
        q.awaitTermination(1)
        if spark.sql("select * from paths").count():
            break
    q.stop()
    got = sorted((r["signature"], r["ms"], r["errors"]) for r in spark.sql("select * from paths").collect())
    assert got == trace_paths(spans)


def test_epochs_and_caches(spark):
    log = spark.createDataFrame([("source", 1), ("source", 2)], "kind string, batch long")
    before = epochs.epoch(log, "r1").first()[0]
    assert epochs.epoch(epochs.bump(log, "source", 2), "r1").first()[0] == before != epochs.epoch(epochs.bump(log, "intent", 1), "r1").first()[0]
    cache = epochs.cache_put(spark.createDataFrame([], "key string, epoch string, pack string"), "k", before, "p")
    assert epochs.cache_get(cache, "k", before).first()[0] == "p" and epochs.cache_get(cache, "k", "other").count() == 0
    ledger = epochs.record_visible(spark.createDataFrame([("old", "a")], "epoch string, id string"), spark.createDataFrame([("b",)], "id string"), "new")
    assert [r["id"] for r in epochs.unseen(spark.createDataFrame([("a",), ("b",)], "id string"), ledger).collect()] == ["a"]
