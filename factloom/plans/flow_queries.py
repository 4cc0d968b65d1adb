"""Flows, surfaces and streams over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scoring as S
from factloom.operators import flows, surface
from factloom.plans.registry import Tables, query
from factloom.session import shared_folder
from factloom.streaming import epochs, traces


def _paths(t: Tables) -> DataFrame:
    """Conversations as paths: an entry for each, its roles and turns as nodes."""
    node = F.concat(F.lit("symbol:"), "role", F.lit("#"), F.col("turn").cast("string"))
    rows = t.conversations.select(F.col("conv_id").cast("string").alias("entry"), "turn", node.alias("node")).groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("turn", "node"))).alias("x"))
    return rows.select("entry", F.lit(0).alias("ordinal"), F.transform("x", lambda e: e["node"]).alias("path"))


def _calls(t: Tables) -> DataFrame:
    pairs = _paths(t).select(F.posexplode("path").alias("pos", "dst"), "path").filter("pos > 0").select(F.get("path", F.col("pos") - 1).alias("src"), "dst").distinct()
    return pairs.withColumn("provenance", F.when(F.col("dst").contains("user"), "RESOLVED").otherwise("EXTRACTED")).withColumn("evidence", F.array("src")).withColumn("block", F.when(F.col("dst").endswith("#1"), "branch"))


_N = "n AS (SELECT CAST(conv_id AS VARCHAR) AS flow, turn, role, 'symbol:' || role || '#' || turn AS node, lag('symbol:' || role || '#' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations)"


@query(f"""WITH {_N} SELECT flow, CAST(row_number() OVER (PARTITION BY flow ORDER BY turn) AS INT) AS "order", role AS actor, CAST(turn AS VARCHAR) AS operation,
CASE WHEN src IS NULL THEN NULL WHEN contains(node, 'user') THEN 'RESOLVED' ELSE 'EXTRACTED' END AS provenance, coalesce(src, '') AS evidence FROM n""")
def compile_flows(t: Tables) -> DataFrame:
    out = flows.compile_flows(_paths(t), _calls(t))
    return out.withColumn("evidence", F.array_join("evidence", ","))


@query(f"""WITH {_N} SELECT DISTINCT src AS "from", node AS "to", CASE WHEN turn = 1 THEN 'branch_true' ELSE 'next' END AS kind, CASE WHEN contains(node, 'user') THEN 'RESOLVED' ELSE 'EXTRACTED' END AS provenance FROM n WHERE src IS NOT NULL""")
def flow_graph_edges(t: Tables) -> DataFrame:
    return flows.flow_graph(_paths(t), _calls(t))["edges"].select("from", "to", "kind", "provenance")


_SIGNALS = "s AS (SELECT DISTINCT o_orderpriority AS component, CASE o_orderstatus WHEN 'F' THEN 'Order.complete' WHEN 'P' THEN 'mark_partial' ELSE CASE WHEN o_totalprice > 250000 THEN 'Order.move_to' WHEN o_totalprice > 150000 THEN 'resume' ELSE 'closeOrder' END END AS name FROM orders UNION SELECT DISTINCT o_orderpriority, 'Priority' || o_orderpriority || 'State' FROM orders WHERE o_orderpriority > '2')"


@query(f"""WITH {_SIGNALS}, g AS (SELECT component, name, CASE WHEN name = 'mark_partial' THEN 'event' WHEN name = 'Order.move_to' THEN 'transition' WHEN name = 'Order.complete' THEN 'terminal outcome' ELSE 'state' END AS condition FROM s WHERE name <> 'closeOrder'),
k AS (SELECT component FROM g GROUP BY 1 HAVING count(*) >= 2)
SELECT component, CAST(1 + row_number() OVER (PARTITION BY component ORDER BY name) AS INT) AS "order", name AS operation, condition FROM g WHERE component IN (SELECT component FROM k) UNION ALL SELECT component, 1, component, NULL FROM k""")
def compile_lifecycles(t: Tables) -> DataFrame:
    """Statuses and prices of orders as methods, priorities as components with a class that holds their state."""
    name = F.when(F.col("o_orderstatus") == "F", "Order.complete").when(F.col("o_orderstatus") == "P", "mark_partial").when(F.col("o_totalprice") > 250000, "Order.move_to").when(F.col("o_totalprice") > 150000, "resume").otherwise("closeOrder")
    methods = t.orders.select(F.col("o_orderpriority").alias("component"), name.alias("name"), F.lit("method").alias("kind")).distinct()
    classes = t.orders.filter("o_orderpriority > '2'").select("o_orderpriority", F.concat(F.lit("Priority"), "o_orderpriority", F.lit("State")), F.lit("class")).distinct()
    return flows.lifecycles(methods.union(classes).withColumn("signature", F.lit(None).cast("string")))


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS writes, count(*) FILTER (o_orderstatus = 'P') AS flows FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'public' WHEN coalesce(writes, 0) > 0 THEN 'state' WHEN c_mktsegment = 'BUILDING' THEN 'contract' WHEN coalesce(flows, 0) > 0 THEN 'flow' WHEN c_nationkey = 3 THEN 'types' ELSE 'core' END AS kind FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def surface_kinds(t: Tables) -> DataFrame:
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("int"))
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(n("F").alias("writes"), n("P").alias("flows"))
    rows = t.customer.join(orders, "c_custkey", "left").na.fill(0, ["writes", "flows"])
    row = {"exported": F.col("c_acctbal") > 9000, "writes": F.col("writes"), "contract": F.col("c_mktsegment") == "BUILDING", "flows": F.col("flows"), "symbol_kind": F.when(F.col("c_nationkey") == 3, "class").otherwise("function")}
    return rows.select("c_custkey", surface.quota_kind(row).alias("kind"))


@query("""WITH c AS (SELECT l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS callers FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size > 37 THEN p_name ELSE p_type || ' — ' || p_brand || CASE WHEN p_size <= 25 THEN chr(10) || '  ' || p_name || '.' ELSE '' END || CASE WHEN p_size <= 12 AND callers IS NOT NULL THEN chr(10) || '  callers: ' || callers ELSE '' END END AS text
FROM part LEFT JOIN c ON p_partkey = l_partkey""")
def render_levels(t: Tables) -> DataFrame:
    """Parts by size at four levels of compression, called by the suppliers of large lines."""
    callers = t.lineitem.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("callers"))
    rows = t.part.join(callers, "p_partkey", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))
    level = F.when(F.col("p_size") > 37, 3).when(F.col("p_size") > 25, 2).when(F.col("p_size") > 12, 1).otherwise(0)
    doc = F.concat("p_name", F.lit(". More of it."))
    return rows.select("p_partkey", surface.render_entry(level, F.col("p_name"), F.col("p_brand"), F.col("p_type"), doc, F.col("callers")).alias("text"))


@query("SELECT p_type AS subclass, array_to_string(list_sort(list(DISTINCT 'b' || p_brand)), ',') AS consumers FROM part GROUP BY 1")
def merge_contracts(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_type").alias("subclass"), F.array(F.lit("op")).alias("operations"), F.array(F.concat(F.lit("b"), "p_brand")).alias("consumers"), F.array(F.col("p_name")).alias("evidence"))
    return surface.merge_contracts(rows).select("subclass", F.array_join("consumers", ",").alias("consumers"))


@query("SELECT event_type AS source, CAST(user_id % 5 AS VARCHAR) AS target, CAST(count(*) AS BIGINT) AS count, round(sum(value), 6) AS sum_ms, CAST(sum(CAST(event_type = 'error' AS INT)) AS BIGINT) AS errors FROM events GROUP BY 1, 2")
def stream_edge_totals(t: Tables) -> DataFrame:
    """Events as a file stream in micro-batches, merged batch by batch."""
    folder = shared_folder(t.spark, "stream")
    rows = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{t.folder}/events.parquet*")
    edges = rows.select(F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("string").alias("target"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"))
    traces.stream_edges(edges, f"{folder}/edges", f"{folder}/checkpoint").awaitTermination()
    return traces.read_edges(t.spark, f"{folder}/edges").select("source", "target", "count", F.round("sum_ms", 6).alias("sum_ms"), "errors")


@query("SELECT CAST(count(DISTINCT event_id) FILTER (event_type = 'view') AS BIGINT) AS source, CAST(count(DISTINCT event_id) FILTER (event_type = 'click') AS BIGINT) AS semantic FROM events")
def model_epoch(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "source").when(F.col("event_type") == "click", "semantic")
    return epochs.generations(t.events.select(kind.alias("kind"), F.col("event_id").alias("batch"))).select("source", "semantic")


@query("""WITH f AS (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_suppkey) AS components, count(*) FILTER (l_returnflag = 'R') AS contracts, count(*) FILTER (l_discount > 0.09) AS invariants, CAST(sum(l_quantity) AS BIGINT) AS budget FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN invariants > 0 OR contracts > 2 THEN 'HIGH' WHEN contracts > 0 OR components > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CAST(100 * budget + greatest(ceil(100 * budget * 0.2), 500) AS BIGINT) AS most FROM f""")
def risk_and_hard_max(t: Tables) -> DataFrame:
    """Risk of a change of each order by what it touches, and the hard limit over its quantity as a budget."""
    n = lambda c: F.sum(F.col(c).cast("int")) if isinstance(c, str) else F.sum(c.cast("int"))
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("components"), n(F.col("l_returnflag") == "R").alias("contracts"), n(F.col("l_discount") > 0.09).alias("invariants"), F.sum("l_quantity").cast("long").alias("budget"))
    return f.select("o_orderkey", S.risk_class(F.col("components"), F.col("contracts"), F.col("invariants")).alias("risk"), S.hard_max(100 * F.col("budget")).cast("long").alias("most"))
