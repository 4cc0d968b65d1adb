"""Runtime traces: edges between services, path signatures and reconciliation of edge sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a trace of more distinct root-to-leaf paths gives no signature.
PATHS = 256

OTLP_SCHEMA = (
    "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,"
    "scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,startTimeUnixNano:string,"
    "endTimeUnixNano:string,status:struct<code:string>>>>>>>"
)
_CLOCK = 1e6  # nanoseconds in a millisecond


def spans(payloads: DataFrame, body: str) -> DataFrame:
    """(trace, span, parent, service, latency_ms, error) of OTLP/JSON payloads; malformed payloads give no rows."""
    rows = payloads.select(F.from_json(body, OTLP_SCHEMA).alias("p")).select(F.explode("p.resourceSpans").alias("r"))
    names = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    rows = rows.select(F.coalesce(F.try_element_at(names, F.lit(1))["value"]["stringValue"], F.lit("unknown")).alias("service"), F.explode("r.scopeSpans").alias("s"))
    rows = rows.select("service", F.explode("s.spans").alias("s"))
    start, end = F.expr("try_cast(s.startTimeUnixNano as bigint)"), F.expr("try_cast(s.endTimeUnixNano as bigint)")
    error = F.coalesce(F.upper("s.status.code").isin("2", "STATUS_CODE_ERROR", "ERROR"), F.lit(False))
    parent = F.when(F.col("s.parentSpanId") != "", F.col("s.parentSpanId"))
    return rows.select(F.col("s.traceId").alias("trace"), F.col("s.spanId").alias("span"), parent.alias("parent"), "service", F.coalesce((end - start) / _CLOCK, F.lit(0.0)).alias("latency_ms"), error.alias("error"))


def service_edges(rows: DataFrame, root: str = "root") -> DataFrame:
    """(source, target, count, sum_ms, errors) of spans; a span without a known parent comes from ``root``. Sums, so batches can be added."""
    parents = rows.select(F.col("trace").alias("t"), F.col("span").alias("p"), F.col("service").alias("from"))
    joined = rows.join(parents, (rows["trace"] == parents["t"]) & (rows["parent"] == parents["p"]), "left")
    return edge_sums(joined.select(F.coalesce("from", F.lit(root)).alias("source"), F.col("service").alias("target"), "latency_ms", "error"))


def edge_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "target").agg(F.count("*").alias("count"), F.sum("latency_ms").alias("sum_ms"), F.sum(F.col("error").cast("long")).alias("errors"))


def simple_edges(payloads: DataFrame, body: str) -> DataFrame:
    """Edge sums of ``[{source, target, count}]`` payloads; a missing count is 1, no latency or error is known."""
    rows = payloads.select(F.explode(F.from_json(body, "array<struct<source:string,target:string,count:bigint>>")).alias("e"))
    return rows.groupBy("e.source", "e.target").agg(F.sum(F.coalesce("e.count", F.lit(1))).alias("count"), F.lit(0.0).alias("sum_ms"), F.lit(0).cast("long").alias("errors"))


def add_edges(*parts: DataFrame) -> DataFrame:
    """Merge edge sums; the count-weighted mean latency is sum_ms / count."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("source", "target").agg(F.sum("count").alias("count"), F.sum("sum_ms").alias("sum_ms"), F.sum("errors").alias("errors"))


def with_mean(edges: DataFrame) -> DataFrame:
    return edges.withColumn("mean_ms", F.try_divide("sum_ms", "count"))


def path_signatures(rows: DataFrame, most: int = PATHS) -> DataFrame:
    """(signature, count, mean_ms, errors): root-to-leaf service paths of each trace, distinct by labels, merged over traces.

    A trace is gathered in one task; one with more than ``most`` distinct paths gives none.
    """

    names = ["trace", "span", "parent", "service", "latency_ms", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))], names=["signature", "ms", "errors"])
        for _, own in groupby(each, key=lambda r: r[0]):
            out += trace_paths(list(own), most)
            if len(out) > 10_000:
                yield batch()
                out = []
        yield batch()

    dealt = rows.select(*names).repartition("trace").sortWithinPartitions("trace", "span")
    paths = dealt.mapInArrow(run, "signature string, ms double, errors long")
    return paths.groupBy("signature").agg(F.count("*").alias("count"), F.avg("ms").alias("mean_ms"), F.sum("errors").alias("errors"))


def trace_paths(spans_of_trace: list[tuple], most: int = PATHS) -> list[tuple[str, float, int]]:
    """(signature, latency, errors) of the root-to-leaf paths of one trace, distinct by labels; none beyond ``most``."""
    known = {r[1] for r in spans_of_trace}
    children: dict = {}
    for r in spans_of_trace:
        children.setdefault(r[2] if r[2] in known else None, []).append(r)
    found: dict[str, tuple[float, int]] = {}
    stack = [(r, (r[3],), r[4], int(r[5]), frozenset([r[1]])) for r in children.get(None, [])]
    while stack:
        r, labels, ms, errors, met = stack.pop()
        below = [c for c in children.get(r[1], []) if c[1] not in met]
        if not below:
            found.setdefault(" > ".join(labels), (ms, errors))
            if len(found) > most:
                return []
        stack += [(c, (*labels, c[3]), ms + c[4], errors + int(c[5]), met | {c[1]}) for c in below]
    return [(k, ms, e) for k, (ms, e) in sorted(found.items())]


def reconcile(observed: DataFrame, static: DataFrame, declared: DataFrame) -> DataFrame:
    """(source, target, observed, static, declared, finding, severity) of three edge sets in one aggregation.

    Observed but neither declared nor static: undeclared, HIGH. Declared but never
    observed: MEDIUM. Static but never observed: LOW. The rest agree.
    """
    flag = lambda df, name: df.select("source", "target", *[F.lit(int(n == name)).alias(n) for n in ("observed", "static", "declared")])
    rows = flag(observed, "observed").union(flag(static, "static")).union(flag(declared, "declared"))
    sets = rows.groupBy("source", "target").agg(*[(F.max(n) == 1).alias(n) for n in ("observed", "static", "declared")])
    o, s, d = F.col("observed"), F.col("static"), F.col("declared")
    finding = F.when(o & ~s & ~d, "observed_undeclared").when(d & ~o, "declared_unobserved").when(s & ~o, "static_unobserved").otherwise("match")
    severity = F.when(o & ~s & ~d, "HIGH").when(d & ~o, "MEDIUM").when(s & ~o, "LOW")
    return sets.withColumn("finding", finding).withColumn("severity", severity)


def new_findings(found: DataFrame, open_findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that no open finding already says, once each."""
    return found.join(open_findings.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def consecutive(rows: DataFrame, group: list[str], order: Column, step: str) -> DataFrame:
    """(group, source, target) of neighbouring steps."""
    from pyspark.sql import Window

    nxt = F.lead(step).over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumn("target", nxt).filter("target is not null").select(*group, F.col(step).alias("source"), "target")
