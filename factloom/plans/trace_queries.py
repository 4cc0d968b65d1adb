"""Trace aggregation, signatures and reconciliation over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import derive, traces
from factloom.plans import binding as B
from factloom.plans.registry import Tables, query

_EDGES = "SELECT coalesce(parent_service, 'root') AS source, service AS target, CAST(count(*) AS BIGINT) AS count, round(sum(latency_ms) / count(*), 6) AS mean_ms, CAST(sum(CAST(error AS INT)) AS BIGINT) AS errors FROM spans GROUP BY 1, 2"


def _edges(t: Tables) -> DataFrame:
    return traces.with_mean(traces.service_edges(B.transitions(t)))


@query(f"WITH {B.SPANS_SQL} {_EDGES}")
def trace_edges(t: Tables) -> DataFrame:
    return _edges(t).select("source", "target", "count", F.round("mean_ms", 6).alias("mean_ms"), "errors")


@query(f"WITH {B.SPANS_SQL}, e AS ({_EDGES}) SELECT source, target, count * 2 AS count, mean_ms, errors * 2 AS errors FROM e")
def trace_edges_replayed(t: Tables) -> DataFrame:
    one = traces.service_edges(B.transitions(t))
    return traces.with_mean(traces.add_edges(one, one)).select("source", "target", "count", F.round("mean_ms", 6).alias("mean_ms"), "errors")


@query(f"""WITH {B.SPANS_SQL}, j AS (SELECT trace, string_agg(service, ' > ' ORDER BY ts, event_id) AS signature, sum(latency_ms) AS ms, sum(CAST(error AS INT)) AS errors FROM spans GROUP BY 1)
SELECT signature, CAST(count(*) AS BIGINT) AS count, round(avg(ms), 8) AS mean_ms, CAST(sum(errors) AS BIGINT) AS errors FROM j GROUP BY 1""")
def trace_signatures(t: Tables) -> DataFrame:
    return traces.path_signatures(B.transitions(t)).select("signature", "count", F.round("mean_ms", 8).alias("mean_ms"), "errors")


_OBS = "obs AS (SELECT DISTINCT parent_service AS source, service AS target FROM spans WHERE parent IS NOT NULL AND event_id % 3 = 0)"
_STATIC = "st AS (SELECT parent_service AS source, service AS target FROM spans WHERE parent IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT trace) >= 3)"
_DECL = "de AS (SELECT * FROM (VALUES ('view', 'click'), ('click', 'purchase'), ('login', 'logout'), ('signup', 'error')) v(source, target))"


def _three(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    spans = B.transitions(t)
    parents = spans.select(F.col("trace").alias("t"), F.col("span").alias("p"), F.col("service").alias("source"))
    pairs = spans.join(parents, (F.col("trace") == F.col("t")) & (F.col("parent") == F.col("p"))).select("source", F.col("service").alias("target"), "trace", "event_id")
    observed = pairs.filter("event_id % 3 = 0").select("source", "target").distinct()
    static = pairs.groupBy("source", "target").agg(F.count_distinct("trace").alias("n")).filter("n >= 3")
    declared = t.spark.createDataFrame([("view", "click"), ("click", "purchase"), ("login", "logout"), ("signup", "error")], "source string, target string")
    return observed, static, declared


@query(f"""WITH {B.SPANS_SQL}, {_OBS}, {_STATIC}, {_DECL}, u AS (SELECT source, target, true AS o, false AS s, false AS d FROM obs UNION ALL SELECT source, target, false, true, false FROM st UNION ALL SELECT source, target, false, false, true FROM de),
g AS (SELECT source, target, bool_or(o) AS observed, bool_or(s) AS static, bool_or(d) AS declared FROM u GROUP BY 1, 2)
SELECT *, CASE WHEN observed AND NOT static AND NOT declared THEN 'observed_undeclared' WHEN declared AND NOT observed THEN 'declared_unobserved' WHEN static AND NOT observed THEN 'static_unobserved' ELSE 'match' END AS finding,
CASE WHEN observed AND NOT static AND NOT declared THEN 'HIGH' WHEN declared AND NOT observed THEN 'MEDIUM' WHEN static AND NOT observed THEN 'LOW' END AS severity FROM g""")
def reconcile(t: Tables) -> DataFrame:
    return traces.reconcile(*_three(t))


_LOUD = "(SELECT parent_service || ' > ' || service AS pair, count(*) AS n FROM spans WHERE parent_service IS NOT NULL AND latency_ms > 20 GROUP BY 1)"


@query(f"WITH {B.SPANS_SQL} SELECT 'slow_edge' AS kind, 'slow_edge: ' || pair AS message FROM {_LOUD} WHERE pair <> 'click > view'")
def persist_findings(t: Tables) -> DataFrame:
    """Findings on pairs of services with slow calls that weren't known before."""
    s = B.transitions(t)
    parents = s.select(F.col("span").alias("parent"), F.col("service").alias("source"))
    found = s.filter("latency_ms > 20").join(parents, "parent").select(F.concat_ws(" > ", "source", "service").alias("pair"))
    found = found.distinct().select(F.lit("slow_edge").alias("kind"), F.concat(F.lit("slow_edge: "), "pair").alias("message"))
    known = t.spark.createDataFrame([("slow_edge", "slow_edge: click > view")], "kind string, message string")
    return traces.new_findings(found, known, ["kind", "message"])


@query("SELECT conv_id, role AS source, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations QUALIFY target IS NOT NULL")
def consecutive_pairs(t: Tables) -> DataFrame:
    return traces.consecutive(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], F.col("turn"), "role")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations")
def preceding_boundary(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    return derive.carry_forward(rows, ["conv_id"], F.col("turn"), F.when(F.col("role") == "user", F.col("text")), "asked").select("conv_id", "turn", "asked")


@query("SELECT role, min_by(turn, turn) AS first_turn, conv_id FROM conversations GROUP BY role, conv_id")
def lexical_order(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role", "conv_id").agg(F.min("turn").alias("first_turn"))


@query("SELECT user_id AS target, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def occurrence_producer(t: Tables) -> DataFrame:
    return derive.mode(t.events.select(F.col("user_id").alias("target"), F.col("event_type").alias("mode")), "target", "mode")


@query("SELECT event_type AS kind, CAST(sum(n) AS BIGINT) AS count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type, user_id) GROUP BY 1")
def simple_edge_counts(t: Tables) -> DataFrame:
    body = F.to_json(F.array(F.struct(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("target"))))
    return traces.simple_edges(t.events.select(body.alias("body")), "body").groupBy(F.col("source").alias("kind")).agg(F.sum("count").alias("count"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_totals(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", F.round("s", 6).alias("total"))


@query("SELECT event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def runtime_status(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.unix_micros(F.min("ts").cast("timestamp_ltz")).alias("first_us"), F.unix_micros(F.max("ts").cast("timestamp_ltz")).alias("last_us"), F.count_distinct("user_id").alias("users"))
