"""Order-dependent and sequential operators against plain versions, and their invariants."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import graph, resolve, selection, store, traces


def test_walk_prefers_rank_and_stops_at_cycles():
    near = {"a": [(3, "c"), (4, "b")], "b": [(4, "a"), (4, "d")], "c": [(3, "d")]}
    assert graph.walk_paths(near, "a") == [["a", "c"], ["a", "b", "d"]]
    assert graph.walk_paths({}, "a") == []


def test_bounded_paths_equal_the_walk(spark):
    rnd = random.Random(3)
    edges = sorted({(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}", rnd.choice([3, 4])) for _ in range(60)})
    near = {}
    for a, b, r in edges:
        near.setdefault(a, []).append((r, b))
    df = spark.createDataFrame(edges, "src string, dst string, rank int")
    got = graph.bounded_paths(df, spark.createDataFrame([("n1",)], "id string"), 12).orderBy("ordinal").collect()
    assert [r["path"] for r in got] == graph.walk_paths(near, "n1", 12)


def test_walks_through_hubs_expand_no_more_than_their_visits(spark):
    rnd = random.Random(5)
    edges = {("n0", f"h{i:03}", rnd.choice([3, 4])) for i in range(150)} | {("n1", "n0", 4)} | {(f"h{i:03}", f"n{rnd.randrange(40)}", 3) for i in range(150)}
    edges |= {(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", rnd.choice([2, 3, 4])) for _ in range(90)}
    edges = sorted({(a, b): (a, b, r) for a, b, r in sorted(edges)}.values())
    near = {}
    for a, b, r in edges:
        near.setdefault(a, []).append((r, b))
    df, seeds = spark.createDataFrame(edges, "src string, dst string, rank int"), ["n0", "n1", "n7", "h003", "absent"]
    entries = spark.createDataFrame([(x,) for x in seeds], "id string")
    for depth, visits in ((6, 64), (12, 9), (1, 64), (3, 200)):
        got = {}
        for r in graph.bounded_paths(df, entries, depth, visits).orderBy("entry", "ordinal").collect():
            got.setdefault(r["entry"], []).append(r["path"])
        assert got == {s: p for s in seeds if (p := graph.walk_paths(near, s, depth, visits))}
        sizes = graph.expanded(df, entries, depth, visits).groupBy("seed").count().collect()
        assert max(r["count"] for r in sizes) <= visits


def test_agglomeration_blocks_chains():
    every = {(0, 1): 20, (0, 2): 20, (1, 2): 20}
    # 7 is below 12, and over three members its mean is below 0.4 of it
    assert graph.agglomerate(["a", "b", "c", "d"], every | {(2, 3): 7}) == [["a", "b", "c"], ["d"]]
    names = ["a", "b", "c"]
    assert graph.agglomerate(names, {(0, 1): 20, (1, 2): 7}) == [["a", "b", "c"]]
    assert graph.agglomerate(names, {(0, 1): 20, (1, 2): 12}) == [["a", "b", "c"]]
    assert graph.agglomerate(names, {(0, 1): 12}, {(0, 1)}) == [["a"], ["b"], ["c"]]


def test_cluster_names():
    assert graph.cluster_name(["a/b/c", "a/b/d"]) == "a/b"
    assert graph.cluster_name(["x", "y"]) == "x+y"


@given(st.lists(st.tuples(st.integers(1, 90), st.booleans()), min_size=1, max_size=25), st.integers(0, 200))
@settings(max_examples=15, deadline=None)
def test_budget_selection_skips_and_goes_on(spark, items, budget):
    rows = [("g", i, c, float(100 - c), req, i) for i, (c, req) in enumerate(items)]
    df = spark.createDataFrame(rows, "g string, id long, cost long, value double, required boolean, position long")
    got = selection.select_with_budget(df, ["g"], budget, budget).first()
    spent = sum(c for c, req in items if req)
    want = [str(i) for i, (c, req) in sorted(enumerate(items), key=lambda x: (-(100 - x[1][0]) / x[1][0], x[0])) if req]
    for i, (c, req) in sorted(enumerate(items), key=lambda x: (-(100.0 - x[1][0]) / max(x[1][0], 1), x[0])):
        if not req and spent + c <= budget:
            spent += c
            want.append(str(i))
    assert got["ids"] == want and got["spent"] == spent


def test_mmr_spreads_over_groups():
    ranked = [("a", 0.9, "x"), ("b", 0.8, "x"), ("c", 0.5, "y")]
    assert selection.mmr(ranked, 3) == ["a", "c", "b"]


def test_trace_replay_doubles_counts_and_keeps_means(spark):
    body = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"api"}}]},"scopeSpans":[{"spans":[{"traceId":"t","spanId":"1","startTimeUnixNano":"0","endTimeUnixNano":"2000000","status":{"code":2}},{"traceId":"t","spanId":"2","parentSpanId":"1","startTimeUnixNano":0,"endTimeUnixNano":1000000}]}]}]}'
    df = spark.createDataFrame([(body,), ("not json",), (None,)], "body string")
    one = traces.service_edges(traces.spans(df, "body"))
    two = traces.with_mean(traces.add_edges(one, one))
    assert sorted((r["source"], r["target"], r["count"], r["mean_ms"], r["errors"]) for r in two.collect()) == [("api", "api", 2, 1.0, 0), ("root", "api", 2, 2.0, 2)]


def test_trace_path_cap_drops_the_trace():
    spans = [("t", "0", None, "root", 1.0, False)] + [("t", str(i), "0", f"s{i}", 1.0, False) for i in range(1, 258)]
    assert traces.trace_paths(spans) == []
    assert len(traces.trace_paths(spans[:-1])) == 256


def test_purge_keeps_concepts_that_still_occur(spark):
    c = spark.createDataFrame
    out = store.purge(
        c([("f1",), ("f2",)], "path string"), c([("a", "f1"), ("b", "f2"), ("k", None), ("l", None)], "id string, path string"),
        c([("e1", "b", "k", ["v2"]), ("e2", "a", "k", ["v1"])], "id string, subject string, object string, evidence array<string>"),
        c([("v1", "f1"), ("v2", "f2")], "id string, path string"), c([("k", "f1"), ("k", "f2"), ("l", "f1")], "concept string, path string"), c([("f1",)], "path string"),
    )
    assert sorted((r["id"], tuple(r["sources"])) for r in out["entities"].collect()) == [("b", ("f2",)), ("k", ("f2",))]
    assert [r["id"] for r in out["edges"].collect()] == ["e1"]


def test_longest_prefix_and_default(spark):
    dirs = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, name string")
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    got = resolve.longest_prefix(paths, "path", dirs, "dir", "name", F.lit("root"))
    assert {r["path"]: r["name"] for r in got.collect()} == {"a/b/c": "B", "a/x": "A", "z": "root"}


@given(st.text(max_size=40))
@settings(max_examples=20, deadline=None)
def test_percent_encoding_round_trip(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(X.encode_component(F.col("t")).alias("e")).select("e", X.decode_component(F.col("e")).alias("d")).first()
    assert got["d"] == text and all(c.isascii() and (c.isalnum() or c in "/._-%") for c in got["e"])


def test_stems_and_slugs(spark):
    words = spark.createDataFrame([("normalization",), ("running",), ("get",)], "w string").select("w", X.stem_variants(F.col("w")).alias("s"))
    got = {r["w"]: r["s"] for r in words.collect()}
    assert "normalize" in got["normalization"] and {"run", "runn"} <= set(got["running"]) and got["get"] == ["get"]
    slug = spark.createDataFrame([("My_File--Name!/x.py",), ("___",)], "w string").select(X.sanitize_key(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in slug] == ["my-file-name-/x.py", "unnamed"]
